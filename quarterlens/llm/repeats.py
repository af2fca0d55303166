"""Repeated byte windows by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, slices, spread, stored, table, tidy

#: Bytes of a window, and of the grams of which the least in a window is its anchor.
LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: Bytes that are worked on at a time. Longer texts are cut with an overlap; a cut only makes more work for later passes.
SLICE = 2 << 20
#: Most windows that are sorted at a time.
WINDOWS = 1 << 20
#: The windows of an anchor with more different stretches than this are dealt to tasks one by one, by their digests.
HOT = 1 << 20
_NULL_ID = -(1 << 63)

_rng = np.random.default_rng(31_337)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xA0761D6478BD642F)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes x in its own place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _sums(values: np.ndarray, data: np.ndarray, power: np.ndarray, out: np.ndarray) -> None:
    """Running sums of the bytes' values times powers of the base, after a 0."""
    terms = values[data]
    terms *= power[: len(data)]
    out[0] = 0
    np.cumsum(terms, out=out[1:])


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        a, b = np.full(n, _BASE), np.full(n, _BACK)
        a[0] = b[0] = 1
        np.cumprod(a, out=a)
        np.cumprod(b, out=b)
        _powers[:] = [a, b]
    return _powers[0], _powers[1]


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts texts (ends: where each ends in data) into stretches of consecutive windows with the same anchor.

    The anchor of a window is the gram of least hash in it, the leftmost of equals, so it depends on the window's bytes only, and equal
    windows have equal anchors in equal places. Returns for each stretch: text, start within data, number of windows, the
    anchor's hash, and the hash of all its bytes.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    power, back = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    _sums(_BYTE, data, power, sums)
    grams = sums[GRAM:] - sums[:-GRAM]
    grams *= back[: len(data) - GRAM + 1]
    _mix(grams)
    low = np.uint64((1 << 24) - 1)
    least = grams & ~low
    least |= np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: -(SPAN - width)], least[SPAN - width :])
    anchor = (least & low).astype(np.int64)
    starts = np.append(0, ends[:-1])
    owner = np.repeat(np.arange(len(ends)), ends - starts)[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= ends[owner]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    first = np.flatnonzero(new[at] | (np.diff(at, prepend=-2) != 1))
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    stop = begin + count + LENGTH - 1
    whole = _mix((sums[stop] - sums[begin]) * back[begin] + count.astype(np.uint64) * _BASE)
    _sums(_BYTE2, data, power, sums)
    whole = _mix(whole + ((sums[stop] - sums[begin]) * back[begin]))
    return owner[begin], begin, count, grams[anchor[begin]], whole


def merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals: sorted, overlapping and touching ones joined."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > stops[:-1]
    first = np.flatnonzero(new)
    return starts[first], stops[np.append(first[1:] - 1, len(stops) - 1)]


def _by_document(doc: np.ndarray, alt: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Intervals as one merged list for each document."""
    order = np.lexsort((start, alt, doc))
    doc, alt, start, stop = doc[order], alt[order], start[order], stop[order]
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(alt) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
        if b > a:
            x, y = merge(start[a:b], stop[a:b])
            yield int(doc[a]), int(alt[a]), np.stack([x, y], 1).astype("<i4").tobytes()


_ROW = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("alt", "<i4"), ("start", "<i4"), ("n", "u1")])


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches equal as a whole: those that are removals, and the earliest of each. The same place twice (a row
    that comes twice) is no repeat."""
    rows = rows[np.lexsort((rows["start"], rows["alt"], rows["doc"], rows["whole"], rows["gram"]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows["gram"][1:] == rows["gram"][:-1]) & (rows["whole"][1:] == rows["whole"][:-1])
    first = rows[np.maximum.accumulate(np.where(again, 0, np.arange(len(rows))))]
    same = (rows["doc"] == first["doc"]) & (rows["alt"] == first["alt"]) & (rows["start"] == first["start"])
    return rows[again & ~same], rows[~again]


_MOVED = "kind int, bucket int, doc_id long, alt int, data binary"
_FIELDS = ["kind", "bucket", "doc_id", "alt", "data"]
_STRETCH, _REMOVE, _COMPARE, _WINDOW = 0, 1, 2, 3


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_FIELDS)


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All stretches, packed by bucket. Of equal ones in a slice only the earliest goes on; the others are removals."""
        for batch in batches:
            for a, b in slices(batch, SLICE, 2):
                part = batch.slice(a, b - a)
                docs, alts = part.column(0).to_numpy(), part.column(1).to_numpy()
                texts = part.column(2).to_pylist()
                jobs = [(docs, alts, np.zeros(len(docs), np.int64), texts)]
                if len(texts) == 1 and len(texts[0]) > SLICE:
                    step = SLICE - LENGTH + 1
                    jobs = [(docs, alts, np.array([i]), [texts[0][i : i + SLICE]]) for i in range(0, len(texts[0]) - LENGTH + 1, step)]
                for job_docs, job_alts, base, some in jobs:
                    ends = np.cumsum([len(t) for t in some])
                    owner, begin, count, gram, whole = stretches(np.frombuffer(b"".join(some), np.uint8), ends)
                    if not len(owner):
                        continue
                    rows = np.zeros(len(owner), _ROW)
                    rows["gram"], rows["whole"], rows["n"] = gram, whole, count
                    rows["doc"], rows["alt"] = job_docs[owner], job_alts[owner]
                    rows["start"] = begin - np.append(0, ends)[owner] + base[owner]
                    gone, rows = _settle(rows)
                    out = []
                    stop = gone["start"].astype(np.int64) + gone["n"] + LENGTH - 1
                    for doc, alt, data in _by_document(gone["doc"], gone["alt"], gone["start"].astype(np.int64), stop):
                        out.append((_REMOVE, hash((doc, alt)) % buckets, doc, alt, data))
                    where = (rows["gram"] % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(where, kind="stable")
                    rows, where = rows[order], where[order]
                    cuts = np.flatnonzero(np.diff(where)) + 1
                    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                        out.append((_STRETCH, int(where[x]), None, None, rows[x:y].tobytes()))
                    yield _batch(out)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Of rows sorted by bucket and kind: kind and data of each bucket's rows; removals as they are."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] == _REMOVE:
                yield _REMOVE, [row]
                continue
            if row[:2] != key and held:
                yield key[0], held
                held = []
            key = row[:2]
            held.append(row[4])
    if held:
        yield key[0], held


def _first_pass(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first digit is the anchor. An anchor met once is done. Of stretches equal as a whole, all but the earliest
        are removals; where an anchor has different stretches, the earliest of each is to be compared window by window, with a
        mark if there are more than `hot`."""
        out: list[tuple] = []
        for kind, group in _groups(batches):
            if kind == _REMOVE:
                out += group
            else:
                rows = np.frombuffer(b"".join(group), _ROW)
                grams, where, n = np.unique(rows["gram"], return_inverse=True, return_counts=True)
                rows = rows[n[where] > 1]
                gone, rows = _settle(rows)
                stop = gone["start"].astype(np.int64) + gone["n"] + LENGTH - 1
                for doc, alt, data in _by_document(gone["doc"], gone["alt"], gone["start"].astype(np.int64), stop):
                    out.append((_REMOVE, 0, doc, alt, data))
                grams, where, n = np.unique(rows["gram"], return_inverse=True, return_counts=True)
                rows["n"] |= np.where(n[where] > hot, _MARK, 0).astype(np.uint8)
                rows = rows[n[where] > 1]
                rows = rows[np.lexsort((rows["start"], rows["alt"], rows["doc"]))]
                cuts = np.flatnonzero((np.diff(rows["doc"]) != 0) | (np.diff(rows["alt"]) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                    if b > a:
                        some = rows[a:b]
                        out.append((_COMPARE, 0, int(some["doc"][0]), int(some["alt"][0]), some[["gram", "start", "n"]].tobytes()))
            if len(out) > 5_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


#: Beside a number of windows (SPAN at most): the anchor has very many different stretches.
_MARK = 128
_ASKED = np.dtype({"names": ["gram", "start", "n"], "formats": ["<u8", "<i4", "u1"], "offsets": [0, 28, 32], "itemsize": _ROW.itemsize})
_HEAD = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("alt", "<i4"), ("start", "<i4"), ("n", "u1")])
_PLACED = np.dtype([("digest", "<u8", 2), ("doc", "<i8"), ("alt", "<i4"), ("start", "<i4")])


def _contents(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the stretches that are to be compared, packed by bucket of their anchors. Marked ones go on as 128-bit
        digests of single windows, packed by bucket of these; of equal ones met here only the earliest goes on, the others are
        removals."""
        held: dict[int, list[bytes]] = {}
        single: dict[bytes, tuple[int, int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = [(_COMPARE, k, None, None, b"".join(v)) for k, v in sorted(held.items())]
            if single:
                rows = np.zeros(len(single), _PLACED)
                rows["digest"] = np.frombuffer(b"".join(single), np.uint64).reshape(-1, 2)
                for f, x in zip(("doc", "alt", "start"), zip(*single.values(), strict=True), strict=True):
                    rows[f] = x
                where = (rows["digest"][:, 0] % np.uint64(buckets)).astype(np.int64)
                rows, where = rows[np.argsort(where, kind="stable")], np.sort(where)
                cuts = np.flatnonzero(np.diff(where)) + 1
                out += [(_WINDOW, int(where[x]), None, None, rows[x:y].tobytes()) for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True)]
            if gone:
                doc, alt, start = (np.array(x, np.int64) for x in zip(*gone, strict=True))
                out += [(_REMOVE, hash((d, a)) % buckets, d, a, data) for d, a, data in _by_document(doc, alt, start, start + LENGTH)]
            held.clear()
            single.clear()
            gone.clear()
            size = 0
            return _batch(out)

        for batch in batches:
            for i in range(batch.num_rows):
                doc, alt, text = (batch.column(c)[i].as_py() for c in range(3))
                for data in batch.column(3)[i].as_py():
                    asked = np.frombuffer(data, _ASKED)
                    head = np.zeros(len(asked), _HEAD)
                    for f in ("gram", "start", "n"):
                        head[f] = asked[f]
                    head["doc"], head["alt"] = doc, alt
                    for h, gram, start, n in zip(head, head["gram"].tolist(), head["start"].tolist(), head["n"].tolist(), strict=True):
                        if n < _MARK:
                            piece = h.tobytes() + text[start : start + n + LENGTH - 1]
                            held.setdefault(gram % buckets, []).append(piece)
                            size += len(piece)
                            continue
                        for at in range(start, start + n - _MARK):
                            place, name = (doc, alt, at), hashlib.blake2b(text[at : at + LENGTH], digest_size=16).digest()
                            first = single.setdefault(name, place)
                            if first == place:
                                size += LENGTH // 10
                            else:
                                single[name] = min(first, place)
                                gone.append(max(first, place))
                        if size > SLICE:
                            yield flush()
                if size > SLICE:
                    yield flush()
        yield flush()

    return run


def repeated_windows(group: np.ndarray, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over windows (places `at` in data) that begin in groups.

    Each pass orders every group by the next eight bytes and splits it; windows left alone in a group are done. After the last
    pass, which reaches LENGTH bytes and no further, equal groups are exactly the repeated windows. Returns the indices of the
    windows in these and their groups.
    """
    index = np.arange(len(at))
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    for depth in [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]:
        if not len(index):
            break
        digit = view[at[index] + depth].copy().view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        new = np.ones(len(index), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        index, group = index[many], group[many]
    return index, group


def _later_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window by window, within each anchor's stretches: all but the earliest of equal windows are removals."""
    for kind, group in _groups(batches):
        if kind == _REMOVE:
            yield _batch(group)
            continue
        raw = b"".join(group)
        if kind == _WINDOW:
            rows = np.frombuffer(raw, _PLACED)
            rows = rows[np.lexsort((rows["start"], rows["alt"], rows["doc"], rows["digest"][:, 1], rows["digest"][:, 0]))]
            later = np.zeros(len(rows), bool)
            later[1:] = (rows["digest"][1:] == rows["digest"][:-1]).all(1)
            first = rows[np.maximum.accumulate(np.where(later, 0, np.arange(len(rows))))]
            rows = rows[later & (rows[["doc", "alt", "start"]] != first[["doc", "alt", "start"]])]
            start = rows["start"].astype(np.int64)
            yield _batch([(_REMOVE, 0, d, x, data) for d, x, data in _by_document(rows["doc"], rows["alt"], start, start + LENGTH)])
            continue
        data = np.frombuffer(raw + b"\0" * 8, np.uint8)
        heads, places, at = [], [], 0
        while at < len(raw):
            n = raw[at + _HEAD.itemsize - 1]
            heads.append(raw[at : at + _HEAD.itemsize])
            places.append(at + _HEAD.itemsize)
            at += _HEAD.itemsize + n + LENGTH - 1
        head, place = np.frombuffer(b"".join(heads), _HEAD), np.array(places, np.int64)
        order = np.lexsort((head["start"], head["alt"], head["doc"], head["gram"]))
        head, place = head[order], place[order]
        new = np.ones(len(head), bool)
        new[1:] = head[1:] != head[:-1]  # a row that comes twice sends its bytes twice
        head, place = head[new], place[new]
        bounds = np.append(np.flatnonzero(np.diff(head["gram"], prepend=head["gram"][:1] + np.uint64(1))), len(head))
        total = np.append(0, np.cumsum(head["n"].astype(np.int64)))
        lo = 0
        while lo < len(bounds) - 1:  # whole anchors, up to WINDOWS windows at a time
            hi = lo + 1
            while hi < len(bounds) - 1 and total[bounds[hi + 1]] - total[bounds[lo]] <= WINDOWS:
                hi += 1
            some = slice(bounds[lo], bounds[hi])
            h, n = head[some], head["n"][some].astype(np.int64)
            owner = np.repeat(np.arange(len(h)), n)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            grams = np.unique(h["gram"], return_inverse=True)[1]
            index, same = repeated_windows(grams[owner], place[some][owner] + step, data)
            if len(index):
                doc, alt = h["doc"][owner[index]], h["alt"][owner[index]]
                start = h["start"][owner[index]].astype(np.int64) + step[index]
                order = np.lexsort((start, alt, doc, same))
                doc, alt, start, same = doc[order], alt[order], start[order], same[order]
                later = np.zeros(len(same), bool)
                later[1:] = same[1:] == same[:-1]
                rows = [(_REMOVE, 0, d, x, data_) for d, x, data_ in _by_document(doc[later], alt[later], start[later], start[later] + LENGTH)]
                yield _batch(rows)
            lo = hi


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            missing, text, parts = (batch.column(c)[i].as_py() for c in (2, 3, 4))
            spans = np.frombuffer(b"".join(parts or []), "<i4").reshape(-1, 2).astype(np.int64)
            x, y = merge(spans[:, 0], spans[:, 1])
            kept, last = hashlib.sha256(), 0
            pieces = []
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                pieces.append(text[last:a])
                last = b
            pieces.append(text[last:])
            clean = b"".join(pieces)
            kept.update(clean)
            rows.append((None if missing else batch.column(0)[i].as_py(), len(text), int((y - x).sum()), len(x), kept.hexdigest(), clean))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Removes every byte that a window of LENGTH bytes covers which also starts earlier in the corpus (in a document of smaller
    doc_id, or before in the same one); windows overlap and are judged on the input. Returns digests and the kept bytes.

    Suffixes are ordered through LENGTH bytes only, by most-significant-digit passes, and what is alone in its group drops out
    after each. The first digit is a window's anchor, so runs of windows that share one move as one packed row of 33 bytes, about one for
    forty bytes of text. Stretches that are equal as a whole are settled there; only where an anchor has different
    stretches do their bytes move, and the later passes order their windows by eight bytes at a time. Equal stretches within a
    slice of the scan are settled before anything moves, so a passage that a third of all documents hold arrives once for each slice.
    An anchor with more than `hot` different stretches is split: its windows go to tasks by their 128-bit digests, equal ones of
    a slice once.

    The texts move once, by doc_id, for fetching those bytes and for the removal (one exchange, used twice).

    Null texts count as empty; texts shorter than a window are kept whole. A null doc_id comes before all others. Rows that repeat
    a doc_id and a text are one document, and each gets its result; texts that share a doc_id are ordered by their hash. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    raw = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)).alias("doc_id"),
        docs["doc_id"].isNull().alias("missing"),
        F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"),
    )
    repeated = raw.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        numbered = raw.select("doc_id", F.lit(0).alias("alt"), "text", "missing")
    else:
        hashed = raw.withColumn("h", F.sha2("text", 256))
        own = hashed.join(repeated, "doc_id", "left_semi").select("doc_id", "missing", "h").distinct()
        # missing ids come before real ones, also before the one that stands for them
        own = own.withColumn("alt", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("missing"), "h")) - 1)
        own = own.select(F.col("doc_id").alias("d"), F.col("missing").alias("m"), F.col("h").alias("g"), "alt")
        own = stored(spark, own, "repeats-alts")
        on = (F.col("doc_id") == F.col("d")) & (F.col("missing") == F.col("m")) & (F.col("h") == F.col("g"))
        numbered = hashed.join(own, on, "left").select("doc_id", F.coalesce("alt", F.lit(0)).alias("alt"), "text", "missing")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    settled = (
        spread(numbered)
        .mapInArrow(tidy(_cut(buckets)), _MOVED)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "kind")
        .mapInArrow(tidy(_first_pass(hot)), _MOVED)
    )
    settled = stored(spark, settled, "repeats-first")

    by_doc = numbered.repartition(parts, "doc_id", "alt")
    asked = (
        settled.filter(F.col("kind") == _COMPARE).groupBy("doc_id", "alt").agg(F.collect_list("data").alias("asked"))
    )
    compared = (
        by_doc.join(asked.hint("shuffle_merge"), ["doc_id", "alt"])
        .select("doc_id", "alt", "text", "asked", "missing")  # the columns of the join below, so that one exchange serves both
        .mapInArrow(tidy(_contents(buckets)), _MOVED)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "kind")
        .mapInArrow(tidy(_later_passes), _MOVED)
    )
    removals = (
        settled.filter(F.col("kind") == _REMOVE)
        .unionByName(compared)
        .groupBy("doc_id", "alt")
        .agg(F.collect_list("data").alias("spans"))
    )
    return (
        by_doc.join(removals.hint("shuffle_merge"), ["doc_id", "alt"], "left")
        .select("doc_id", "alt", "missing", "text", "spans")
        .mapInArrow(
            tidy(_remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        )
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: By listing every window of every text, as hexadecimal digits: for small tables.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, h[2 * p + 1:2 * p + 200] AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
runs AS (
  SELECT doc_id, p, sum(CASE WHEN p <= coalesce(before, -1000) + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)
), spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY 1, 2),
per AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM spans GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1),
    lambda i: h[2 * coalesce(stops[i], 0) + 1:2 * coalesce(starts[i + 1], len(h) // 2)]), '') END)) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""
