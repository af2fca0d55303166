"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, row_ids, ship, slices, spread, stored, table, text_bytes, texts, tidy, without

SLICE = 2 << 20
SEEN = 100_000
LEAST, MASK_BITS, MOST = 512, 11, 16_384

_GEAR = np.random.default_rng(20_240_607).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text (bytes between offsets) the ends of its chunks, from the text's start.

    The rolling hash spans 32 bytes. A chunk ends where its top bits are all set, from LEAST bytes on and at MOST bytes.
    As LEAST exceeds 32, no cut depends on what precedes the text.
    """
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero(h >= np.uint32((1 << 32) - (1 << (32 - MASK_BITS)))) + 1
    lows = np.searchsorted(marks, offsets[:-1])
    highs = np.searchsorted(marks, offsets[1:], side="right")
    out = []
    for i in range(len(offsets) - 1):
        start, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
        cuts, last = [], 0
        if n > LEAST:
            for mark in (marks[lows[i] : highs[i]] - start).tolist():
                while mark - last > MOST:
                    last += MOST
                    cuts.append(last)
                if mark - last >= LEAST and mark < n:
                    cuts.append(mark)
                    last = mark
        while n - last > MOST:
            last += MOST
            cuts.append(last)
        if n > last or not n:
            cuts.append(n)
        out.append(cuts)
    return out


def _name(chunk: bytes, bits: int) -> bytes:
    """A chunk's short name. Fewer bits make names clash; tests use this to reach the verification."""
    d = hashlib.blake2b(chunk, digest_size=8).digest()
    return (int.from_bytes(d, "big") >> (64 - bits)).to_bytes(8, "big")


def _cut(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: a recipe for each document, and each chunk that this task hasn't sent before."""
        seen: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            for a, b in slices(batch, SLICE):
                part = batch.slice(a, b - a)
                data, offsets = text_bytes(part.column(1))
                lowered = data.tobytes().lower()  # bytes.lower() changes A-Z only
                recipes, shas, lengths, names, chunks = [], [], [], [], []
                for i, cuts in enumerate(cut_points(np.frombuffer(lowered, np.uint8), offsets)):
                    text = lowered[offsets[i] : offsets[i + 1]]
                    recipe, last = [], 0
                    for end in cuts:
                        chunk = text[last:end]
                        last = end
                        name = _name(chunk, bits)
                        recipe.append(name)
                        mark = (name, hashlib.blake2b(chunk, digest_size=16).digest())
                        if mark not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(mark)
                            names.append(name)
                            chunks.append(chunk)
                    recipes.append(b"".join(recipe))
                    shas.append(hashlib.sha256(text).hexdigest())
                    lengths.append(len(text))
                n, m = b - a, len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.column(0).to_pylist() + [None] * m, pa.int64()),
                        pa.array(recipes + [None] * m, pa.binary()),
                        pa.array(shas + [None] * m, pa.string()),
                        pa.array(lengths + [None] * m, pa.int64()),
                        pa.array(part.column(2).to_pylist() + [None] * m, pa.int64()),
                        pa.array([None] * n + names, pa.binary()),
                        pa.array([None] * n + chunks, pa.binary()),
                    ],
                    names=["doc_id", "recipe", "text_sha256", "n_bytes", "row", "name", "chunk"],
                )

    return run


_CUT = "doc_id long, recipe binary, text_sha256 string, n_bytes long, row long, name binary, chunk binary"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks sorted by name: the names under which different bytes came."""
    name, first, clash, out = None, None, False, []
    for batch in batches:
        for key, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != name:
                name, first, clash = key, chunk, False
            elif not clash and chunk != first:
                clash = True
                out.append(key)
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["name"])


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Groups texts that are identical after lower-casing A-Z; the row with the largest doc_id stays.

    Each text is cut into content-defined chunks, once. Only chunks move: every distinct one once for each task
    that holds it, so boilerplate and copies aren't sent again, and a document travels on as its recipe, the
    ordered list of its chunks' names. Chunks that share a name are compared byte by byte; names that
    clash become a table, and recipes that use one are told apart by the text's SHA-256 as well. Recipes are then
    compared as whole lists.

    The group's size and its largest doc_id are summed within each task before any row moves, and the join back
    holds light rows only, which adaptive execution splits if one recipe is very common.

    Null texts count as empty; empty texts form one group. Rows that repeat a doc_id and a text are told apart: of
    rows that tie on the largest doc_id, exactly one is kept. A null doc_id counts as the smallest. An empty table gives no rows.
    """
    return _duplicates(texts(docs).withColumn("row", F.lit(None).cast("long")), bits)[0].drop("row")


def _duplicates(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """Of (doc_id, text, row): see exact_duplicates; and the stored tables that the result reads. row: an id of each row, by which ties
    on the doc_id are decided; where it's null, rows are numbered here."""
    spark = rows.sparkSession
    ship(spark)
    cut = stored(spark, spread(rows).mapInArrow(tidy(_cut(bits)), _CUT), "exact-cut")
    recipes = cut.filter("recipe is not null").select("doc_id", "recipe", "text_sha256", "n_bytes", "row")
    clashes = stored(
        spark,
        cut.filter("name is not null")
        .select("name", "chunk")
        .repartition("name")
        .sortWithinPartitions("name")
        .mapInArrow(tidy(_verify), "name binary"),
        "exact-clashes",
    )
    recipes = recipes.withColumn("row", F.coalesce("row", F.monotonically_increasing_id()))
    keyed = recipes.withColumn("apart", F.lit(""))
    if not clashes.isEmpty():
        names = F.expr("transform(sequence(0, int(length(recipe) / 8) - 1), i -> substring(recipe, i * 8 + 1, 8))")
        hit = (
            recipes.select("row", F.explode(names).alias("name"))
            .join(clashes, "name", "left_semi")
            .select("row")
            .distinct()
            .withColumn("hit", F.lit(True))
        )
        keyed = (
            recipes.join(hit, "row", "left")
            .withColumn("apart", F.when(F.col("hit"), F.col("text_sha256")).otherwise(""))
            .drop("hit")
        )
    groups = keyed.groupBy(F.col("recipe").alias("r"), F.col("apart").alias("a")).agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
    )
    joined = keyed.join(groups, (keyed["recipe"] == groups["r"]) & (keyed["apart"] == groups["a"]))
    result = joined.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        "row",
    )
    return result, [cut, clashes]


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns: of equal texts the row with the largest doc_id (null counts as the
    smallest), and of rows that tie on it the last one in the order of the table."""
    rows, own = row_ids(docs)
    result, read = _duplicates(texts(rows.select("doc_id", "text", own), own).withColumnRenamed(own, "row"))
    gone = stored(docs.sparkSession, result.filter("not kept").select("row"), "exact-gone")
    discard(*read)
    return without(rows, own, gone).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
