"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of a filter of ids, and of each of its parts.
FILTER, FILTER_PART = 1 << 25, 1 << 15
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, through Spark's own reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and text (and other columns that are named) only, so that the rest is pruned at the scan; a null text counts as empty."""
    text = F.coalesce(docs["text"], F.lit("")).alias("text")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text, *others)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only where the cluster names none (tests, a
    laptop) is one made, and then Spark must run in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quarterlens-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back. This cuts the lineage: a lost executor
    costs a reread of the table, and values that depend on partition numbers stay as they were."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = out, path
    return out


_places: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no later step and no result reads. Others, not written by `stored`, stay as they are."""
    for df in tables:
        _, path = _places.pop(id(df), (None, None))
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a long id of each row in a further column, and that column's name.

    Where every row has its own doc_id, that is the id. Otherwise rows are numbered, and written once, so that the numbers stay.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    own = docs.withColumn(name, docs["doc_id"].cast("long"))
    counts = own.groupBy(name).count()
    if counts.filter(F.col(name).isNull() | (F.col("count") > 1)).isEmpty():
        return own, name
    return stored(docs.sparkSession, docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _free(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name in map(str.lower, df.columns):
        name += "_"
    return name


def flagged(df: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """df with a further column: false where df's column is surely not among ids (a table of one column), true where it may be.

    A filter of FILTER bits, built by partial aggregation, tells them apart at the scan, before any exchange. It's as large as that at
    most, so it may be broadcast; the more ids there are, the more rows are true.
    """
    place, part, bits = (_free(df, x) for x in ("_place", "_part", "_bits"))
    placed = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    held = (
        ids.select(placed(ids[ids.columns[0]]).alias("p"))
        .groupBy(F.expr(f"p div {FILTER_PART}").alias(part))
        .agg(F.bitmap_construct_agg(F.col("p") % FILTER_PART).alias(bits))
    )
    at = F.col(place) % FILTER_PART
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn(place, placed(df[column]))
        .withColumn(part, F.expr(f"{place} div {FILTER_PART}"))
        .join(F.broadcast(held), part, "left")  # FILTER / FILTER_PART rows of FILTER_PART / 8 bytes at most
        .withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
        .drop(place, part, bits)
    )


def without(rows: DataFrame, own: str, gone: DataFrame) -> DataFrame:
    """rows but those whose id, in the column own and never null, is among gone (a table of one column). Only rows that a filter can't
    tell from those (see flagged) leave the scan, and are compared with all of gone."""
    flag = _free(rows, "_may")
    told = flagged(rows, own, gone, flag)
    doubtful = told.filter(F.col(flag)).drop(flag)
    named = gone.toDF(_free(rows, "_gone"))
    stay = doubtful.join(named, doubtful[own] == named[named.columns[0]], "left_anti")
    return told.filter(~F.col(flag)).drop(flag).union(stay)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor, and keeps their Arrow batches to 2 MB (or to what the
    session says, if that is not Spark's own default of 64 MB): executor and worker each hold some of them beside the heap."""
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "2m")
    sc = spark.sparkContext
    if getattr(sc, "_quarterlens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quarterlens-zip-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/quarterlens.zip", "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(f"{folder}/quarterlens.zip")
    sc._quarterlens_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """For a table that comes as fewer partitions than there are cores: deals its rows out, whatever ids they have. Rows are
    sorted within each task, as the order in which they arrive is not fixed, so a task that runs again sees them alike."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores).sortWithinPartitions(*df.columns)
    return df


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: Arrow's, and (with the GNU library) the allocator's. Idle
    workers otherwise keep the most that any task took, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches that releases memory when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def slices(batch: pa.RecordBatch, most: int, column: int = 1) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose text column holds about `most` bytes each; one longer row stands alone."""
    offsets = text_offsets(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = start + 1
        while end < n and offsets[end + 1] - offsets[start] <= most:
            end += 1
        yield start, end
        start = end


def text_offsets(column: pa.Array):
    """Byte offsets of a string or binary array (n + 1 of them), whatever the width of its offsets is."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array):
    """The bytes between the first and the last offset of a string array as uint8, and offsets from 0."""
    import numpy as np

    offsets = text_offsets(column)
    data = column.buffers()[2] if len(column) else None
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
