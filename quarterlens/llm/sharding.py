"""Contiguous, byte-balanced shards from global prefix sums (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 40
OVERHEAD = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """Cuts the rows, in doc_id order, into `shards` contiguous ranges of nearly equal bytes.

    A row's size is the UTF-8 length of its text (null: 0) plus `overhead`. Rows are range-partitioned; each
    partition's total gives its offset; a running sum within the partition gives every row's global
    prefix, and the row goes to the shard in whose equal share of the total its midpoint lies. So a
    boundary is off its target by half a row at most.

    Only (doc_id, size, crc32) is sorted, never a text. Repeated doc_ids follow each other in an order that is
    fixed once (a row number taken at the scan), so identical rows get different slots. Null doc_ids
    sort first. An empty table gives no rows. Every row is kept.
    """
    spark = docs.sparkSession
    raw = docs["text"].cast("binary")
    sized = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = stored(spark, sized, "sharding-sizes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.repartitionByRange(parts, "doc_id", "row").withColumn("part", F.spark_partition_id())
    ranged = stored(spark, ranged, "sharding-ranges")

    # One row for each partition: the only thing that is summed in one place.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("doc_id", "row")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        # as many rows as range partitions: a count that is fixed by the setting
        ranged.join(F.broadcast(bases), "part")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(running))
        .withColumn("place", F.col("rows_before") + F.row_number().over(within) - 1)
        .withColumn(
            "shard",
            F.expr(f"int(least({shards - 1}, ((2 * end - size) * {shards}) div (2 * total)))"),
        )
    )
    placed = stored(spark, placed.select("doc_id", "size", "text_crc32", "shard", "place"), "sharding-places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The checksum goes over the text's bytes by a table that is made here too.
OP10_SQL = """
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
  lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS t),
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, k),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS e, sum(size) OVER () AS total FROM c),
s AS (SELECT doc_id, size, text_crc32, least(39, ((2 * e - size) * 40) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""
