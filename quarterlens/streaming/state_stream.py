"""Idempotent ingestion as a stream: state by key in Spark's state store."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.versioned import VersionedTable

STATE = "sha256 string, published string, processing_count long"


def decided(arrivals: DataFrame, key: str, order: str) -> DataFrame:
    """Of a stream of (key, order, sha256, published): the new state of each key that a micro-batch changes.

    A key's arrivals are taken in order. One with the hash that the state holds, or with an earlier date than the state's, is
    skipped; any other one becomes the state and is counted. The state is three values a key, kept by Spark's state store,
    so a micro-batch touches the keys that it holds and no others. A key's arrivals of one micro-batch are sorted in memory.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sha, published, n = state.get if state.exists else (None, None, 0)
        before = n
        rows = pd.concat(list(frames)).sort_values(order)
        for s, p in zip(rows["sha256"], rows["published"], strict=True):
            older = bool(published) and p is not None and p < published
            if sha is None or (s != sha and not older):
                sha, published, n = s, p, n + 1
        if n > before:
            state.update((sha, published, n))
            yield pd.DataFrame({key: [k[0]], "sha256": [sha], "published": [published], "processing_count": [n]})

    out = f"{key} {arrivals.schema[key].dataType.simpleString()}, {STATE}"
    return arrivals.groupBy(key).applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.NoTimeout)


def stream_upsert(spark: SparkSession, arrivals: DataFrame, folder: str, key: str, order: str) -> DataFrame:
    """Runs a stream of (key, order, sha256, published) to its end and returns the state of each key after it.

    Each micro-batch puts the states that it changed into a versioned table, with its number: a batch that runs again is known by
    it and changes nothing. The table merges its folders as they grow, so a read costs what the number of keys does, however
    many batches there were.
    """
    states = VersionedTable(spark, f"{folder}/states", key)

    def write(batch: DataFrame, number: int) -> None:
        # a batch runs to its end, once, also if its number is known, as Spark commits its own state with it
        batch.write.mode("overwrite").parquet(f"{folder}/batch")
        changed = spark.read.schema(batch.schema).parquet(f"{folder}/batch")
        states.put(changed, ["processing_count"], writer="stream", number=number)

    query = (
        decided(arrivals, key, order)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .queryName(f"state-{uuid.uuid4().hex[:8]}")
        .start()
    )
    query.awaitTermination()
    return current(spark, folder, key, arrivals.schema[key].dataType.simpleString())


def current(spark: SparkSession, folder: str, key: str, kind: str = "long") -> DataFrame:
    """The state of each key as of the last batch."""
    states = VersionedTable(spark, f"{folder}/states", key)
    if states.empty():
        return spark.createDataFrame([], f"{key} {kind}, {STATE}")
    return states.read().select(key, "sha256", "published", "processing_count")
