"""MinHash near-duplicates, with odd sketches between the bands and the exact check."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, flagged, release, row_ids, ship, slices, spread, stored, table, text_bytes, texts, tidy, without
from .links import components

SLICE = 1 << 19
WORDS = 5
#: A link: 100 * intersection >= percent * union. PERCENT is the query's, STAGE_PERCENT that of a pipeline's stage.
PERCENT, STAGE_PERCENT = 85, 80
#: Values of a band, and the most probable miss of a pair at the threshold, which gives the number of bands (19 at 85, 27 at 80).
ROWS, MISS, MOST_BANDS = 4, 1e-6, 256
#: Most samples that an odd sketch folds, and its bits.
SAMPLES, BITS = 512, 1024
#: Pairs of two components in a bucket that the first round of the cross check takes; each round takes so many times more.
FIRST, MORE = 4, 16
#: Pairs of sketches that are compared at a time, and shingles that a task keeps for further checks.
BLOCK, HELD = 1 << 20, 1 << 22

#: Members of a bucket that one task compares with as many others.
CHUNK = 1_024

_rng = np.random.default_rng(9_041)
_MUL = _rng.integers(0, 1 << 63, MOST_BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, MOST_BANDS * ROWS, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, (WORDS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.arange(1, MOST_BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class _Digests(dict):
    """128-bit digests of words (BLAKE2b); those of short words are remembered."""

    def __missing__(self, word: bytes) -> bytes:
        out = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = out
        return out


_digests = _Digests()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of all words of the texts, as rows of two numbers, and the number of words of each text."""
    # Arrow's ASCII kernels change A-Z only, and part at \x20 and \x09-\x0D
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    per_doc = pc.list_value_length(lists).to_numpy().astype(np.int64)
    codes = pc.list_flatten(lists).dictionary_encode()
    data, ends = text_bytes(codes.dictionary)
    raw, ends = data.tobytes(), ends.tolist()
    names = [raw[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905
    if b"" in names:  # a text without words comes as one empty word
        bare = pc.binary_length(pc.ascii_trim_whitespace(texts)).to_numpy() == 0
        per_doc[bare] = 0
        codes = codes.filter(pc.not_equal(codes.indices, pa.scalar(names.index(b""), pa.int32())))
    digests = np.frombuffer(b"".join(map(_digests.__getitem__, names)), np.uint64).reshape(-1, 2)
    return digests[codes.indices.to_numpy()], per_doc


def shingles(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles, one text after the other: sorted 64-bit hashes, their counts, and 64 more bits of each.

    Words are known by 128-bit digests, and a shingle by two sums over its words' digests, so that neither chance nor words
    made to share a hash bring different shingles together.
    """
    return _shingles(*words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).view(pa.string())))


def _shingles(digests: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(digests)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    first, last = max(0, n - WORDS + 1), min(n, WORDS - 1)
    lanes = []
    short = np.flatnonzero((per_doc > 0) & (per_doc < WORDS))
    begin = (np.cumsum(per_doc) - per_doc)[short]
    whole = doc[:first] == doc[last:] if first else np.zeros(0, bool)
    for k in range(2):
        column = np.ascontiguousarray(digests[:, k])
        sums = np.zeros(first, np.uint64)
        for j in range(WORDS if first else 0):
            sums += column[j : first + j] * _PLACE[j, k]
        extra = per_doc[short].astype(np.uint64) * _SHORT[k]
        for j in range(WORDS - 1):
            has = per_doc[short] > j
            extra[has] += column[begin[has] + j] * _PLACE[j, k]
        lanes.append(_mix(np.concatenate([sums[whole], extra])))
    owner = np.concatenate([doc[:first][whole], short])
    hashes, more = lanes
    order = np.lexsort((hashes, owner))
    again = _repeats(owner[order], hashes[order])
    if (again & (np.diff(more[order], prepend=0) != 0)).any():  # hashes that clash are told apart by the other bits
        order = np.lexsort((more, hashes, owner))
        again = _repeats(owner[order], hashes[order], more[order])
    hashes, more, owner = hashes[order][~again], more[order][~again], owner[order][~again]
    return hashes, np.bincount(owner, minlength=len(per_doc)).astype(np.int64), more


def _repeats(*columns: np.ndarray) -> np.ndarray:
    """Which rows are equal to the row before."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = True
        for c in columns:
            out[1:] &= c[1:] == c[:-1]
    return out


def set_keys(hashes: np.ndarray, counts: np.ndarray, more: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each whole set; None for an empty one."""
    raw, rest, at, out = memoryview(hashes.tobytes()), memoryview(more.tobytes()), 0, []
    for n in counts.tolist():
        h = hashlib.blake2b(raw[8 * at : 8 * (at + n)], digest_size=16)
        h.update(rest[8 * at : 8 * (at + n)])
        out.append(h.digest() if n else None)
        at += n
    return out


def shared_count(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The size of the intersection of two sets (sorted hashes and the bits beside them)."""
    (x, x2), (y, y2) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    if not len(y):
        return 0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int(((x[at] == y) & (x2[at] == y2)).sum())


def bands_for(percent: int) -> int:
    """So many bands that a pair at the threshold shares none with a probability below MISS."""
    n = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))
    if n > MOST_BANDS:
        raise ValueError(f"a threshold of {percent} per cent takes more than {MOST_BANDS} bands")
    return n


def band_keys(hashes: np.ndarray, counts: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each set that is not empty."""
    full = counts[counts > 0]
    starts = np.cumsum(full) - full
    keys = np.zeros((len(full), bands), np.uint64)
    for k in range(bands * ROWS):
        least = np.minimum.reduceat(_mix_light(hashes * _MUL[k] + _ADD[k]), starts) if len(full) else np.zeros(0, np.uint64)
        keys[:, k // ROWS] = _mix(keys[:, k // ROWS] + least + _SALT[k])
    return keys


def _mix_light(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(32))


def levels(n: np.ndarray) -> np.ndarray:
    """How often a set's samples are halved: to SAMPLES or fewer, as expected."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / SAMPLES))).astype(np.int64)


def odd_sketches(hashes: np.ndarray, counts: np.ndarray, further: int = 0) -> np.ndarray:
    """Odd sketches of the sets that are not empty, as rows of 64-bit words.

    A set's MinHash samples are its least hashes, those below a bound that halves with each level; small sets are
    sampled whole. The sketch holds for every bit the parity of the samples that fall on it, so the XOR of two
    sketches of one level is the sketch of the samples that the sets don't share, and its population count is at most
    their number. Sets of like size differ by one level at most; further = 1 gives the sketch of the next level.
    """
    full = counts[counts > 0]
    owner = np.repeat(np.arange(len(full)), full)
    level = (levels(full) + further).astype(np.uint64)[owner]
    kept = (hashes >> np.uint64(1)) < (np.uint64(1 << 63) >> level)
    samples, owner = hashes[kept], owner[kept]
    bit = (_mix(samples) % np.uint64(BITS)).astype(np.int64)
    parity = (np.bincount(owner * BITS + bit, minlength=len(full) * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(full), BITS), axis=1).view(np.uint64)


def unshared(percent, na, nb, a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    """Population counts of the XOR of pairs of sketches, and the most that a link allows.

    Sets that link at 85 per cent leave at most 15 of 185 of their elements unshared. For sets sampled whole the count can't exceed the number of
    unshared elements, so no link is lost; otherwise six standard deviations of the sampling are added (a link is lost with a
    probability of 1e-9, less than by the bands).
    """
    la, lb = levels(na), levels(nb)
    level = np.maximum(la, lb)
    x = np.where((la == level)[:, None], a0, a1)
    y = np.where((lb == level)[:, None], b0, b1)
    odd = np.bitwise_count(x ^ y).sum(-1).astype(np.int64)
    most = (na + nb) * (100 - percent) / (100 + percent)
    p = 0.5**level
    return odd, np.where(level == 0, most, p * most + 6 * np.sqrt(p * (1 - p) * most) + 2)


def _sign(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, 4 * SLICE):  # words are numbered for several slices at once
                large = batch.slice(a, b - a)
                digests, per_doc = words_of(large.column(1))
                first = np.append(0, np.cumsum(per_doc))
                for x, y in slices(large, SLICE):
                    yield _signed(large.slice(x, y - x), bands, *_shingles(digests[first[x] : first[y]], per_doc[x:y]))
                release()
        _digests.clear()

    return run


def _signed(part: pa.RecordBatch, n_bands: int, hashes: np.ndarray, counts: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    full = np.flatnonzero(counts)
    bands = band_keys(hashes, counts, n_bands)
    sketches, nexts = odd_sketches(hashes, counts), odd_sketches(hashes, counts, 1)
    band_rows, sketch_rows, next_rows = ([None] * len(counts) for _ in range(3))
    for i, j in enumerate(full.tolist()):
        band_rows[j], sketch_rows[j] = bands[i].view(np.int64), sketches[i].tobytes()
        next_rows[j] = nexts[i].tobytes()
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(counts, pa.int64()),
            pa.array(set_keys(hashes, counts, more), pa.binary()),
            pa.array(band_rows, pa.list_(pa.int64())),
            pa.array(sketch_rows, pa.binary()),
            pa.array(next_rows, pa.binary()),
            pa.array([hashlib.sha256(r).digest() for r in part.column(1).cast(pa.binary()).to_pylist()], pa.binary()),
        ],
        names=["doc_id", "n_shingles", "key", "bands", "sketch", "next", "sha"],
    )


_SIGNED = "doc_id long, n_shingles long, key binary, bands array<long>, sketch binary, next binary, sha binary"


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def _screen(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of candidate pairs (a, b, sizes, sketches): those that their sketches let pass."""
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(i).to_numpy() for i in (2, 3)]
                odd, most = unshared(percent, *sizes, *[_words(batch.column(i)) for i in (4, 5, 6, 7)])
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(odd <= most))

    return run


def _check(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs (keys, nodes, both whole texts): the nodes of those whose full sets link."""
        kept: dict[bytes, tuple] = {}
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            for lo, hi in slices(batch, SLICE, 4):
                part = batch.slice(lo, hi - lo)
                ka, kb = part.column(0).to_pylist(), part.column(1).to_pylist()
                missing: dict[bytes, bytes] = {}
                for keys, column in ((ka, 4), (kb, 5)):
                    values = part.column(column).cast(pa.binary())
                    for i, k in enumerate(keys):
                        if k not in kept and k not in missing:
                            missing[k] = values[i].as_py()
                if sum(len(x) for x, _ in kept.values()) > HELD:
                    kept = {k: kept[k] for k in {*ka, *kb} if k in kept}
                names = list(missing)
                for a in range(0, len(names), 200):
                    some = names[a : a + 200]
                    hashes, counts, more = shingles([missing[k] for k in some])
                    for k, e, n in zip(some, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                        kept[k] = hashes[e - n : e].copy(), more[e - n : e].copy()
                good = []
                for a, b in zip(ka, kb, strict=True):
                    x, y = kept.get(a, none), kept.get(b, none)
                    both = shared_count(x, y)
                    good.append(both > 0 and 100 * both >= percent * (len(x[0]) + len(y[0]) - both))
                yield pa.RecordBatch.from_arrays(part.columns[2:4], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _across(budget: int, percent: int):
    """From members sorted by group (a bucket, or the meeting of two of its chunks): pairs of different components that sizes
    and sketches let pass, of each two components in a block of comparisons the `budget` nearest by their sketches. A row
    of nulls says that there are more. No more than a group and the pairs of a block are held."""

    def pairs(rows: list[list]) -> Iterator[pa.RecordBatch]:
        keys = [k for r in rows for k in r[0]]
        comp, n, side, within = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 5, 6))
        own, after = (np.concatenate([r[i] for r in rows]) for i in (3, 4))
        by_key = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        by_size = by_key[np.argsort(n[by_key], kind="stable")]  # partners of a set are at most so much larger
        comp, n, own, after, side, within = (x[by_size] for x in (comp, n, own, after, side, within))
        last = np.searchsorted(n, n * 100 // percent, side="right")
        more = False
        i = 0
        while i < len(n):
            j = i + 1
            while j < len(n) and (j + 1 - i) * (last[j] - i) <= BLOCK:
                j += 1
            right = np.arange(i, last[j - 1])
            ok = (comp[i:j, None] != comp[None, right]) & (right[None, :] > np.arange(i, j)[:, None])
            ok &= (side[i:j, None] != side[None, right]) | (within[i:j, None] & within[None, right])
            ok &= 100 * n[i:j, None] >= percent * n[None, right]
            x, y = np.nonzero(ok)
            x, y = x + i, right[y]
            found = []
            for a in range(0, len(x), BLOCK // 16):
                u, v = x[a : a + BLOCK // 16], y[a : a + BLOCK // 16]
                odd, most = unshared(percent, n[u], n[v], own[u], after[u], own[v], after[v])
                good = odd <= most
                found.append((u[good], v[good], (odd / np.maximum(most, 1))[good]))
            i = j
            if not sum(len(f[0]) for f in found):
                continue
            x, y, far = (np.concatenate([f[k] for f in found]) for k in range(3))
            low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
            order = np.lexsort((y, x, far, high, low))
            x, y, low, high = x[order], y[order], low[order], high[order]
            new = ~_repeats(low, high)
            few = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)) < budget
            more |= not few.all()
            ends = [[keys[k] for k in by_size[v[few]]] for v in (x, y)]
            a, b = ([pick(p) for p in zip(*ends, strict=True)] for pick in (min, max))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary())] * 2, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids)) if len(ids) else []
            lo = 0
            for hi in cuts:
                part = batch.slice(lo, hi - lo)
                if ids[lo] != group and rows:
                    yield from pairs(rows)
                    rows = []
                group = ids[lo]
                rows.append([
                    part.column(1).to_pylist(), part.column(2).to_numpy(), part.column(3).to_numpy(),
                    _words(part.column(4)), _words(part.column(5)), part.column(6).to_numpy(), part.column(7).to_numpy(False),
                ])
                lo = hi
        if rows:
            yield from pairs(rows)

    return run


def _meetings(where: DataFrame, placed: DataFrame) -> DataFrame:
    """Members (bucket, key, component) of the buckets that hold several components, dealt into groups in which any two of
    different components meet.

    A bucket of up to CHUNK members is one group. Of a larger one, the members of its commonest component, which need not
    meet each other, and the rest form chunks by hash; each chunk of the rest meets every chunk, in a group of its own.
    So no task holds more than two chunks, however common a bucket is.
    """
    sizes = (
        where.groupBy("bucket", "component").count()
        .groupBy(F.col("bucket").alias("of"))
        .agg(F.count("*").alias("components"), F.sum("count").alias("all"), F.max(F.struct("count", "component")).alias("main"))
        .filter("components > 1")
        .withColumn("mains", F.ceil(F.col("main.count") / CHUNK))
        .withColumn("others", F.ceil((F.col("all") - F.col("main.count")) / CHUNK))
    )
    meeting = "named_struct('i', {i}, 'j', {j}, 'side', {side}, 'within', {within})"
    alone = meeting.format(i="0L", j="0L", side="0", within="true")
    mains = meeting.format(i="own", j="d", side="0", within="false")
    others = meeting.format(i="d", j="own", side="1", within="false")
    among = meeting.format(i="-1 - least(d, own)", j="greatest(d, own)", side="int(own > d)", within="own = d")
    groups = (
        f"case when all <= {CHUNK} then array({alone})"
        f" when is_main then transform(sequence(0L, others - 1), d -> {mains})"
        f" else concat(transform(sequence(0L, mains - 1), d -> {others}), transform(sequence(0L, others - 1), d -> {among})) end"
    )
    dealt = (
        where.join(sizes, where["bucket"] == sizes["of"])
        .withColumn("is_main", F.col("component") == F.col("main.component"))
        .withColumn("own", F.pmod(F.xxhash64("key", "bucket"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
        .select("bucket", "key", F.explode(F.expr(groups)).alias("m"))
    )
    return dealt.join(placed, "key").select(
        F.xxhash64("bucket", "m.i", "m.j").alias("bucket"), "key", "component", "n", "sketch", "next", "m.side", "m.within"
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document: size of its shingle set, the least doc_id of its component, and whether that is its own.

    1. One scan of the texts gives each document a digest of its set, band keys of its MinHash values and an odd sketch.
       Equal sets become one class, so copies cost no further work.
    2. In every band's bucket each class is paired with one leader, the class with the most company over all bands (mostly
       the text that the others were made from). Pairs that sizes and sketches let pass are checked on the full sets of both
       whole texts, and components are formed.
    3. In buckets that hold several components, members of different ones are compared by size and sketch in blocks; large
       buckets are split (see _meetings). Of each two components the nearest few pairs that pass are checked on full sets, and
       components are formed again. Rounds with growing numbers follow until nothing is left to check. So every pair that
       shares a bucket is in the end within a component, or too far apart by its sketches, or checked, and pairs within
       a group are never listed.

    A link at the threshold is missed by the bands with a probability below 1e-6, and by the sketches of sets over SAMPLES
    shingles with 1e-9. Words and shingles are known by 128-bit digests.

    Null texts, empty texts and texts of white space have empty sets and link with nothing. Rows that repeat a doc_id count as
    one document of several texts: each row is returned, and what one text links is linked for the doc_id. Null doc_ids
    get their text's component, if a row with a doc_id has the same set, and are not kept. Other columns are ignored; an empty table gives no rows.
    """
    return _near(docs, percent)[0]


def _near(docs: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """See near_duplicates; and the stored tables that the result reads."""
    spark = docs.sparkSession
    ship(spark)
    plain = texts(docs)
    signed = stored(spark, spread(plain).mapInArrow(tidy(_sign(bands_for(percent))), _SIGNED), "near-signed")
    classes = stored(
        spark,
        signed.filter("key is not null and doc_id is not null")
        .groupBy("key")
        .agg(
            F.min(F.struct("doc_id", "sha")).alias("least"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
            F.first("next").alias("next"),
            F.first("bands").alias("bands"),
        )
        .select("key", F.col("least.doc_id").alias("node"), F.col("least.sha").alias("sha"), "n", "sketch", "next", "bands"),
        "near-classes",
    )
    light = classes.select("key", "node", "sha", "n", "sketch", "next")
    members = classes.select("key", F.posexplode("bands").alias("band", "b")).select(
        "key", F.xxhash64("band", "b").alias("bucket")
    )
    sizes = members.groupBy("bucket").count().filter("count > 1")
    shared = stored(spark, members.join(sizes, "bucket"), "near-buckets")
    company = shared.groupBy("key").agg(F.sum("count").alias("company"))
    ranked = shared.join(company, "key").select("bucket", "key", F.struct("company", "key").alias("rank"))
    leaders = ranked.groupBy("bucket").agg(F.max("rank").alias("lead"))
    stars = (
        shared.join(leaders, "bucket")
        .select(F.col("key").alias("a"), F.col("lead.key").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    screened = stored(spark, _screened(stars, light, percent), "near-stars")
    links = stored(spark, _linked(screened, light, plain, percent), "near-links")
    final = components(links)

    tried, budget, done = screened.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), FIRST, [screened]
    while True:
        placed = light.join(final, "node", "left").select(
            "key", "n", "sketch", "next", F.coalesce("component", "node").alias("component")
        )
        placed = stored(spark, placed, "near-placed")
        where = stored(spark, shared.select("bucket", "key").join(placed.select("key", "component"), "key"), "near-where")
        crossing = (
            _meetings(where, placed)
            .repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(tidy(_across(budget, percent)), "a binary, b binary")
            .distinct()
        )
        crossing = stored(spark, crossing, "near-crossing")
        discard(placed, where)
        fresh = stored(spark, crossing.filter("a is not null").join(tried, ["a", "b"], "left_anti"), "near-fresh")
        done.append(fresh)
        if fresh.isEmpty():
            if crossing.filter("a is null").isEmpty():
                break
        else:
            more = stored(spark, _linked(fresh, light, plain, percent), "near-more")
            done.append(more)
            if not more.isEmpty():
                links = links.union(more)
                discard(final)
                final = components(links)
            tried = tried.union(fresh)
        discard(crossing)
        budget *= MORE
    discard(shared, crossing, *done)

    # nodes without a link stand for themselves
    named = classes.select("key", "node").join(final, "node", "left").select(
        "key", F.coalesce("component", "node").alias("component")
    )
    rows = signed.select("doc_id", "n_shingles", F.col("key").alias("k"))
    out = rows.join(named, rows["k"] == named["key"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), [signed, classes]


def _screened(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and odd sketches let them link."""
    side = lambda k: light.select(F.col("key").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "sketch", "next")])
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits)
    return both.select("a", "b", "n_a", "n_b", "sketch_a", "next_a", "sketch_b", "next_b").mapInArrow(tidy(_screen(percent)), "a binary, b binary")


def _named(plain: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of plain whose doc_id may be among the nodes; most others are held back at the scan."""
    return flagged(plain, "doc_id", nodes, "may").filter("may").select("doc_id", "text")


def _linked(pairs: DataFrame, light: DataFrame, plain: DataFrame, percent: int) -> DataFrame:
    """Links (as node ids) among pairs, by the full sets of both texts. Only texts that a pair names leave the scan (see
    _named), once for both sides of the pairs; of a doc_id with several texts, the one that has the key's digest."""
    side = lambda k: light.select(F.col("key").alias(k), F.col("node").alias(f"node_{k}"), F.col("sha").alias(f"sha_{k}"))
    named = stored(pairs.sparkSession, pairs.join(side("a"), "a").join(side("b"), "b"), "near-named")
    nodes = named.select(F.col("node_a").alias("node")).union(named.select("node_b"))
    whole = (
        _named(plain, nodes)
        .select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
        .groupBy("doc_id", "sha")  # a row that comes twice is one text
        .agg(F.max("text").alias("text"))
    )
    for k in "ab":
        text = whole.select(F.col("doc_id").alias(f"node_{k}"), F.col("sha").alias(f"sha_{k}"), F.col("text").alias(f"text_{k}"))
        named = named.join(text.hint("shuffle_merge"), [f"node_{k}", f"sha_{k}"])
    good = named.select("a", "b", "node_a", "node_b", "text_a", "text_b").mapInArrow(tidy(_check(percent)), "a long, b long")
    return good.distinct()


def keep_one(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of docs that stay (one row of each component), with docs' columns. A stage of a pipeline links from a similarity of
    0.8 on.

    Rows are compared by their own ids: rows with a null doc_id, or with a doc_id that others have too, are kept or dropped like
    all others. Of a component the row with the least doc_id stays; in a table with such rows, the first one.
    """
    rows, own = row_ids(docs)
    result, read = _near(rows.select(F.col(own).alias("doc_id"), "text"), percent)
    gone = stored(docs.sparkSession, result.filter("not kept").select("doc_id"), "near-gone")
    discard(*read)
    return without(rows, own, gone).select(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact, by joining all documents on their shingles: for small tables.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh
  FROM d
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT i, j FROM p WHERE 100 * c >= 85 * (na + nb - c)),
g AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT g.j, r.c FROM r JOIN g ON r.doc_id = g.i)
SELECT s.doc_id, len(sh) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON s.doc_id = m.doc_id
"""
