"""Byte-level BPE in numpy: pre-split, matrix merges, hashed lookups, encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, slices, spread, table, texts, tidy
from .tokens import segments

SLICE = 1 << 20
#: Pieces of more bytes than this are merged with a heap instead of a matrix row.
WIDEST = 256
#: Most cells of a matrix; most pieces that a worker caches, and most characters of these.
CELLS = 1 << 20
CACHED, CACHED_CHARS = 1 << 18, 1 << 21

_SPACE, _LETTER, _NUMBER, _OTHER, _END = 0, 1, 2, 3, 4
_SENTINEL = 0x110000
#: The code points with Unicode's White_Space property.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NONE = np.iinfo(np.int32).max

_tables: tuple | None = None
_encoders: dict = {}


def _unicode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random 64-bit value of every code point."""
    global _tables
    if _tables is None:
        kinds = np.full(_SENTINEL + 1, _OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = _LETTER
            elif k == "N":
                kinds[c] = _NUMBER
        kinds[_WHITE] = _SPACE
        kinds[_SENTINEL] = _END
        codes = np.random.default_rng(77).integers(0, 1 << 63, _SENTINEL + 1, dtype=np.uint64)
        _tables = kinds, codes * np.uint64(2) + np.uint64(1)
    return _tables


def piece_starts(cps: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the split pattern begins a piece, for texts that are each followed by the sentinel.

    A piece is a run of letters, of numbers or of other characters with one blank before it; a contraction; or
    white space, of which the last character stands apart if text follows.
    """
    k = kinds[cps]
    white = k == _SPACE
    before = np.empty_like(k)
    before[0], before[1:] = _END, k[:-1]
    after = np.empty_like(k)
    after[-1], after[:-1] = _END, k[1:]
    blank = np.empty(len(cps), bool)
    blank[0], blank[1:] = False, cps[:-1] == 32
    start = np.where(
        white,
        (before != _SPACE) | ((after != _SPACE) & (after != _END)),
        (k != before) & ~blank | (k == _END),
    )
    quote = np.flatnonzero((cps == 39) & start & (after == _LETTER))
    if len(quote):
        second, third = cps[quote + 1], cps[np.minimum(quote + 2, len(cps) - 1)]
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = (second == ord("r")) & (third == ord("e")) | (second == ord("v")) & (third == ord("e"))
        two |= (second == ord("l")) & (third == ord("l"))
        for at, n in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            start[at + n - 1] = False
            start[at[(k[at + n] != _SPACE)] + n] = True
    return np.flatnonzero(start)


class PairTable:
    """Open-addressed table from a pair of ids to the merged id, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        get = ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        self.probes = 1
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at[rest]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            take = rest[free]
            _, first = np.unique(at[take], return_index=True)
            take = take[first]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; _NONE for what never merges (negative ids are padding)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        rest = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


def apart(a: np.ndarray, starts_a: np.ndarray, b: np.ndarray, starts_b: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of the runs a[starts_a : starts_a + counts] and b[starts_b : starts_b + counts] hold different values."""
    unlike = np.flatnonzero(a[ragged(starts_a, counts)] != b[ragged(starts_b, counts)])
    out = np.zeros(len(counts), bool)
    out[np.searchsorted(np.cumsum(counts), unlike, side="right")] = True
    return out


class PieceCache:
    """The pieces met so far, with their ids: an open-addressed table from a piece's 64-bit hash into one pool of ids and one
    of characters. A hash only says where to look: `same` compares the piece itself."""

    BITS = 19

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.index = np.zeros(1 << self.BITS, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.int32)
        self.char_starts = np.zeros(1 << 16, np.int64)
        self.char_counts = np.zeros(1 << 16, np.int64)
        self.chars = np.zeros(1 << 18, np.uint32)
        self.n, self.used, self.used_chars = 0, 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, or -1."""
        mask = np.uint64((1 << self.BITS) - 1)
        at = (keys >> np.uint64(20)) & mask
        found = self.keys[at]
        out = np.where(found == keys, self.index[at], -1)
        rest = np.flatnonzero((found != keys) & (found != 0))
        while len(rest):
            at[rest] = (at[rest] + np.uint64(1)) & mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.index[at[rest[hit]]]
            rest = rest[~hit & (found != 0)]
        return out

    def same(self, entries: np.ndarray, cps: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Which entries hold exactly the pieces cps[start:stop]."""
        counts = stops - starts
        out = self.char_counts[entries] == counts
        at = np.flatnonzero(out)
        out[at] = ~apart(cps, starts[at], self.chars, self.char_starts[entries[at]], counts[at])
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Adds distinct new keys; ids and chars hold the ids and characters of all, one after the other. Returns the entries."""
        entries = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        while self.n + len(keys) > len(self.counts):
            for name in ("starts", "counts", "char_starts", "char_counts"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.used_chars + len(chars) > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.chars[self.used_chars : self.used_chars + len(chars)] = chars
        self.starts[entries] = self.used + np.cumsum(counts) - counts
        self.counts[entries] = counts
        self.char_starts[entries] = self.used_chars + np.cumsum(lengths) - lengths
        self.char_counts[entries] = lengths
        self.n, self.used, self.used_chars = self.n + len(keys), self.used + len(ids), self.used_chars + len(chars)
        mask = np.uint64((1 << self.BITS) - 1)
        at, rest = (keys >> np.uint64(20)) & mask, np.arange(len(keys))
        while len(rest):
            take = rest[self.keys[at[rest]] == 0]
            _, first = np.unique(at[take], return_index=True)
            take = take[first]
            self.keys[at[take]], self.index[at[take]] = keys[take], entries[take]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + np.uint64(1)) & mask
        return entries


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class Bpe:
    """Encoder and decoder for a file of ranks (a base64 token and its rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache = PieceCache()
        self.powers = self.inverses = np.ones(1, np.uint64)

    # -- merges --

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every row of a padded matrix (-1 beyond its end) to its end, all rows at once.

        Each round merges in every row the leftmost pair of least rank: its left cell takes the merged id, the cells right
        of it move one to the left, and only the two pairs beside it are looked up again. Rows without a pair left leave
        the matrix, which shrinks to the rows and columns in use. Returns the ids of all rows and their counts.
        """
        n, width = ids.shape
        counts = (ids >= 0).sum(1)
        out = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        ranks = np.full((n, width), _NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live = counts.copy()
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                counts[rows[done]] = live[done]
                keep = ~done
                rows, ids, ranks, live, at, best = rows[keep], ids[keep], ranks[keep], live[keep], at[keep], best[keep]
                if not len(rows):
                    break
                w = int(live.max())
                ids, ranks = ids[:, :w], ranks[:, :w]
            r, w = np.arange(len(rows)), ids.shape[1]
            moved = np.arange(w - 1)[None, :] > at[:, None]
            ids = np.concatenate([np.where(moved, ids[:, 1:], ids[:, :-1]), np.full((len(r), 1), -1, np.int32)], 1)
            ranks = np.concatenate([np.where(moved, ranks[:, 1:], ranks[:, :-1]), np.full((len(r), 1), _NONE, np.int32)], 1)
            # the last cell stays where the merge was at the end of a full row
            ids[r, at] = best
            live = live - 1
            ranks[r, at] = _NONE
            right = np.flatnonzero(at < live - 1)
            if len(right):
                ranks[right, at[right]] = self.pairs.find(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            if len(left):
                ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], ids[left, at[left]])
        mask = np.arange(width)[None, :] < counts[:, None]
        return out[mask], counts

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, with a heap of (rank, place) over a linked list."""
        ids = self.singles[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        tokens, memo = self.ranks, {}
        by_id = self.token

        def rank(a: int, b: int):
            if (a, b) not in memo:
                memo[a, b] = tokens.get(by_id(a) + by_id(b))
            return memo[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (x := rank(r, ids[after[j]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[j]]))
            if before[i] >= 0 and (x := rank(ids[before[i]], r)) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return [x for x in ids if x >= 0]

    def token(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i] + self.lengths[i]].tobytes()

    def merge_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and counts. Pieces are dealt into buckets by length (doubling), and each
        bucket into matrices of at most CELLS cells."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        counts = np.zeros(len(pieces), np.int64)
        parts, order = [], []
        low = 0
        for width in (1, 2, 4, 8, 16, 32, 64, 128, WIDEST):
            chosen = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for a in range(0, len(chosen), max(1, CELLS // width)):
                some = chosen[a : a + max(1, CELLS // width)]
                flat = self.singles[np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)]
                matrix = np.full((len(some), width), -1, np.int32)
                matrix[np.arange(width)[None, :] < lengths[some][:, None]] = flat
                ids, n = self.merge_rows(matrix)
                counts[some] = n
                parts.append(ids)
                order.append(some)
        for i in np.flatnonzero(lengths > WIDEST):
            ids = self.merge_long(pieces[i])
            counts[i] = len(ids)
            parts.append(np.array(ids, np.int32))
            order.append(np.array([i]))
        if not parts:
            return np.zeros(0, np.int32), counts
        order, ids = np.concatenate(order), np.concatenate(parts)
        grouped = counts[order]
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(grouped) - grouped
        return ids[ragged(starts, counts)], counts

    # -- texts --

    def _power(self, n: int) -> None:
        while len(self.powers) < n:
            base = np.uint64(0x9E3779B97F4A7C15)
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            size = max(n, 2 * len(self.powers))
            self.powers, self.inverses = np.full(size, base), np.full(size, inverse)
            self.powers[0] = self.inverses[0] = 1
            np.cumprod(self.powers, out=self.powers)
            np.cumprod(self.inverses, out=self.inverses)

    @staticmethod
    def _pieces(cps: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
        return [cps[a:b].tobytes().decode("utf-32-le").encode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text.

        Pieces are looked up in the cache by hash and compared with what it holds there. Pieces that share a hash with
        others are merged anew each time.
        """
        kinds, codes = _unicode_tables()
        if self.cache.n > CACHED or self.cache.used_chars > CACHED_CHARS:
            self.cache.clear()
        cps = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cps[ends] = _SENTINEL
        starts = piece_starts(cps, kinds)
        stops = np.append(starts[1:], len(cps))
        self._power(len(cps) + 1)
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(codes[cps] * self.powers[: len(cps)], out=sums[1:])
        real = cps[starts] != _SENTINEL
        starts, stops = starts[real], stops[real]
        keys = (sums[stops] - sums[starts]) * self.inverses[starts]
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys[keys == 0] = 1
        entries = self.cache.find(keys)
        hit = np.flatnonzero(entries >= 0)
        clash = hit[~self.cache.same(entries[hit], cps, starts[hit], stops[hit])]
        new = np.flatnonzero(entries < 0)
        if len(new):
            distinct, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            lead = new[first]
            lengths = stops[lead] - starts[lead]
            ids, counts = self.merge_pieces(self._pieces(cps, starts[lead], stops[lead]))
            entries[new] = self.cache.add(distinct, ids, counts, cps[ragged(starts[lead], lengths)], lengths)[inverse]
            clash = np.concatenate([clash, new[~self.cache.same(entries[new], cps, starts[new], stops[new])]])
        counts = self.cache.counts[entries]
        places, pool = self.cache.starts[entries], self.cache.pool
        if len(clash):
            ids, n = self.merge_pieces(self._pieces(cps, starts[clash], stops[clash]))
            pool = np.concatenate([pool[: self.cache.used], ids])
            counts[clash], places[clash] = n, self.cache.used + np.cumsum(n) - n
        ids = pool[ragged(places, counts)]
        total = np.zeros(len(entries) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        bounds = total[np.searchsorted(starts, ends)]
        return ids, np.diff(bounds, prepend=0)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids one after the other, and the number of bytes of each id."""
        counts = self.lengths[ids]
        return self.bytes[ragged(self.offsets[ids], counts)], counts


def bpe(path: str) -> Bpe:
    """The worker's encoder for a file of ranks; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Bpe(path)
    return _encoders[path]


def encode_whole(enc: Bpe, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Like Bpe.encode, for texts of any length: long ones go through it as segments that end at safe boundaries."""
    if max(map(len, rows), default=0) <= SLICE:
        return enc.encode(rows)
    parts, counts = [], []
    for text in rows:
        cut = [enc.encode([s])[0] for s in segments(text, SLICE)]
        parts += cut
        counts.append(sum(map(len, cut)))
    return np.concatenate(parts), np.array(counts, np.int64)


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        for batch in batches:
            for a, b in slices(batch, SLICE):
                part = batch.slice(a, b - a)
                ids, counts = encode_whole(enc, part.column(1).to_pylist())
                data, sizes = enc.decode(ids)
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                ends = np.cumsum(counts)
                size_sums = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(sizes, out=size_sums[1:])
                id_shas, text_shas = [], []
                for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    id_shas.append(hashlib.sha256(raw[4 * i : 4 * j]).hexdigest())
                    text_shas.append(hashlib.sha256(text[size_sums[i] : size_sums[j]]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(id_shas), pa.array(text_shas)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        for batch in batches:
            for a, b in slices(batch, SLICE):
                part = batch.slice(a, b - a)
                ids, counts = encode_whole(enc, part.column(1).to_pylist())
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "ids"]
                )

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                out.append(enc.decode(np.array(ids or [], np.int64))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def encode_texts(docs: DataFrame, ranks: str) -> DataFrame:
    """Each document's ids. Null and empty texts have none; every row is returned once; other columns are ignored."""
    ship(docs.sparkSession)
    return spread(texts(docs)).mapInArrow(tidy(_encode(ranks)), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """The texts of (doc_id, ids); null ids give an empty text, and bytes that are no UTF-8 the replacement character."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decode(ranks)), "doc_id long, text string")


def round_trips(docs: DataFrame, ranks: str) -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns digests of both.

    Texts are split as the split pattern splits them, by array operations over code points. Each distinct piece that a
    worker hasn't met is merged in length-bucketed matrices (Bpe.merge_rows); pieces met before come from its cache.
    Null and empty texts have no ids; every row is returned once, repeated ones too; other columns are ignored; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return spread(texts(docs)).mapInArrow(tidy(_round_trip(ranks)), schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
