"""Packing documents into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe, encode_whole
from .common import ship, slices, spread, stored, table, texts, tidy
from .tokens import encoder

SLICE = 1 << 19
CAPACITY = 2048
END_ID = 1
#: Leftovers are cut to this many tokens at most, and so many of their tokens are dealt into windows at a time.
PIECE, BLOCK = 512, 64 * CAPACITY
#: Blocks' worth of what tasks could not fill a block with, that one task of the second pass deals out.
LAST = 8
#: Sequences of the second pass have numbers from here on.
SECOND = 1 << 62

_packers: dict = {}


class LibraryBpe(Bpe):
    """Bpe's splitting and piece cache over a tokenizer's .json file; pieces not met before go to the library."""

    def __init__(self, vocabulary: str):
        from .bpe import PieceCache

        self.library = encoder(vocabulary)
        self.special = {s: self.library.encode_single_token(s) for s in self.library.special_tokens_set}
        self.cache = PieceCache()
        self.powers = self.inverses = np.ones(1, np.uint64)

    def merge_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        one = self.library.encode_ordinary
        ids = [one(p.decode()) for p in pieces]
        return np.array([x for y in ids for x in y], np.int32), np.array([len(x) for x in ids], np.int64)

    def encode_special(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their counts, with special strings in texts as their tokens."""
        found = [any(s in t for s in self.special) for t in rows]
        if not any(found):
            return encode_whole(self, rows)
        parts, counts = [], []
        for text, mixed in zip(rows, found, strict=True):
            own = [self.library.encode(text, allowed_special="all")] if mixed else [encode_whole(self, [text])[0]]
            parts += [np.asarray(x, np.int32) for x in own]
            counts.append(len(parts[-1]))
        return np.concatenate(parts), np.array(counts, np.int64)


def packer(vocabulary: str) -> LibraryBpe:
    if vocabulary not in _packers:
        _packers[vocabulary] = LibraryBpe(vocabulary)
    return _packers[vocabulary]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: deals items into `windows` groups of near-equal sums.

    Every item begins as a partial partition: one group with the item, the others empty. The two partial partitions with
    the largest spreads between their greatest and least sums are merged, the greatest sum of one with the least of the
    other and so on, until one is left. Ties fall to the item that came first.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, [i])]))  # groups by falling sum; empty ones are left out
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= windows:
            merged = a + b
        else:  # the greatest sums meet empty groups, so that those which share a group are the least of both
            merged = a[: windows - len(b)] + b[: windows - len(a)]
            for (s, x), (t, y) in zip(a[windows - len(b) :], b[windows - len(a) :][::-1], strict=True):
                merged.append((s + t, x + y))
        merged.sort(key=lambda g: -g[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], count, merged))
        count += 1
    groups = [g for _, g in heap[0][2]] if heap else []
    return groups


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, counting up from what the sum needs, for which differencing keeps to the capacity."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, n)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        n += max(1, n // 64)


class Windows:
    """Gathers pieces (their row, with the length at its third place) and deals them into sequences, a block at a time."""

    def __init__(self, capacity: int, serial: int):
        self.capacity, self.serial, self.waiting, self.tokens = capacity, serial, [], 0

    def full(self, row: tuple) -> tuple:
        """A piece that is a sequence by itself."""
        self.serial += 1
        return (*row, self.serial - 1, 0)

    def add(self, row: tuple) -> Iterator[tuple]:
        self.waiting.append(row)
        self.tokens += row[2]
        if self.tokens >= BLOCK:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for group in windows_for([w[2] for w in self.waiting], self.capacity) if self.waiting else []:
            offset = 0
            for i in group:
                yield (*self.waiting[i], self.serial, offset)
                offset += self.waiting[i][2]
            self.serial += 1
        self.waiting, self.tokens = [], 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _pack(vocabulary: str, capacity: int, piece: int, end_id: int):
    """Pieces in their sequences; those that were left when the task ended have none (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        windows = Windows(capacity, (context.partitionId() if context else 0) << 33)
        enc = packer(vocabulary)
        rows: list[tuple] = []
        tail = end_id.to_bytes(4, "little")
        for batch in batches:
            for a, b in slices(batch, SLICE):
                part = batch.slice(a, b - a)
                ids, counts = enc.encode_special(part.column(1).to_pylist())
                raw = memoryview(ids.astype("<u4").tobytes())
                at = 0
                for doc_id, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    total, start = n + 1, 0
                    while start < total:
                        left = total - start
                        length = capacity if left >= capacity else left if left <= piece else piece
                        stop = start + length
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + min(stop, n))])
                        if stop == total:
                            crc = zlib.crc32(tail, crc)
                        row = (doc_id, start, length, crc, total)
                        if length == capacity:
                            rows.append(windows.full(row))
                        else:
                            rows.extend(windows.add(row))
                        start = stop
                    at += n
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
        rows += [(*w, -1, -1) for w in windows.waiting]
        yield _batch(rows)

    return run


def _pack_left(capacity: int):
    """Pieces that are left from the first pass, in sequences of their own numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        windows = Windows(capacity, SECOND + ((context.partitionId() if context else 0) << 33))
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                rows.extend(windows.add(row))
            yield _batch(rows)
        yield _batch(list(windows.flush()))

    return run


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """Deals all tokens (each document's ids and the end id) into sequences of at most `capacity` tokens.

    A document gives as many full sequences as it has in it. What is left, cut to `piece` tokens at most, waits until a block
    of about 64 sequences' worth has gathered in the task, and is then dealt into windows of near-equal sums by
    differencing; if a window exceeds the capacity, the window count rises and the block is dealt again. What a task has left at
    its end, less than a block, is dealt out by a second pass of far fewer tasks (one for each LAST blocks' worth), so that
    sequences are as full on many partitions as on few. Only these pieces (six numbers each) are shuffled; texts only in a
    table of fewer partitions than cores, whose rows are dealt out and then sorted within each task.

    Sequence ids hold the partition's number. The first pass is written as a table that all later steps read, so ids stay what they are
    if an executor is lost later on, in whatever order an exchange before it gave the rows.

    Null and empty texts are documents of one token. Every row is packed, repeated ones too; other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = ", ".join(f"{n} long" for n in _NAMES)
    first = spread(texts(docs)).mapInArrow(tidy(_pack(vocabulary, capacity, piece, end_id)), schema)
    first = stored(spark, first, "packing-pieces")
    left = first.filter("sequence_id < 0")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (LAST * BLOCK)))
    dealt = left.repartition(tasks, "doc_id", "start").sortWithinPartitions(*_NAMES)
    return first.filter("sequence_id >= 0").unionByName(dealt.mapInArrow(tidy(_pack_left(capacity)), schema))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
