"""State by key: whether to process an arrival, and what the state is after it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decision(sha: Column, published: Column, state_sha: Column, state_published: Column) -> list[Column]:
    """(process, reason) of an arrival against the state it meets; dates are compared as text."""
    older = (F.coalesce(state_published, F.lit("")) != "") & (published < state_published)
    short = F.concat(F.substring(sha, 1, 8), F.lit("..."))
    process = F.when(state_sha.isNull(), True).when(sha == state_sha, False).otherwise(~F.coalesce(older, F.lit(False)))
    reason = (
        F.when(state_sha.isNull(), "No previous state found")
        .when(sha == state_sha, F.concat(F.lit("Same SHA256 already processed: "), short))
        .when(older, F.concat(F.lit("Older report (published "), published, F.lit(" vs "), state_published, F.lit(")")))
        .otherwise(F.concat(F.lit("New report to process (SHA256: "), short, F.lit(")")))
    )
    return [process.alias("process"), reason.alias("reason")]


def decide(arrivals: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Decisions for a batch against a state table of (key, sha256, published)."""
    s = state.select(F.col(key).alias("_k"), F.col("sha256").alias("_sha"), F.col("published").alias("_pub"))
    joined = arrivals.join(s, F.col(key) == F.col("_k"), "left")
    return joined.select(*arrivals.columns, *decision(F.col("sha256"), F.col("published"), F.col("_sha"), F.col("_pub")))


def replay(arrivals: DataFrame, key: str, order: str) -> DataFrame:
    """Decisions for a log of arrivals, each against the state that the accepted ones before it left.

    A decision depends on the last accepted arrival, so keys are replayed in order: a key's arrivals are one sequence, and one
    task's. Rows come sorted by key and order and are streamed in Arrow batches: what is held is one state, however many
    arrivals a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, sha, pub = None, None, None
        for batch in batches:
            out = []
            for k, s, p in zip(batch["k"], batch["sha256"], batch["published"], strict=True):
                if k != who:
                    who, sha, pub = k, None, None
                go = sha is None or (s != sha and not (pub and p < pub))
                if go:
                    sha, pub = s, p
                out.append(go)
            yield pd.DataFrame({"k": batch["k"], "o": batch["o"], "process": out})

    rows = arrivals.select(F.col(key).alias("k"), F.col(order).alias("o"), "sha256", "published")
    dealt = rows.repartition("k").sortWithinPartitions("k", "o")
    schema = f"k {arrivals.schema[key].dataType.simpleString()}, o {arrivals.schema[order].dataType.simpleString()}, process boolean"
    return dealt.mapInPandas(run, schema).withColumnsRenamed({"k": key, "o": order})


def upserted(arrivals: DataFrame, key: str, order: str) -> DataFrame:
    """The state after all arrivals: the last one of each key, and how many there were. One partial aggregation."""
    last = F.max(F.struct(F.col(order), "sha256", "published")).alias("last")
    return arrivals.groupBy(key).agg(last, F.count("*").alias("processing_count")).select(
        key, "last.sha256", "last.published", "processing_count"
    )


def after_skips(arrivals: DataFrame, key: str, order: str) -> DataFrame:
    """The state after all arrivals, each of which is skipped if the state that it meets says so: the last accepted one of each
    key, and how many were accepted."""
    went = replay(arrivals, key, order).filter("process").select(key, order)
    return upserted(arrivals.join(went, [key, order], "left_semi"), key, order)


def overview(state: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row: how many keys were asked for, and how many have a state."""
    found = wanted.select(key).distinct().join(state.select(key, F.lit(1).alias("has")), key, "left")
    return found.agg(F.count("*").alias("total"), F.count("has").alias("processed"))


def kept_states(state: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Whether each key that cleaning asks for has a state; states hold one version, so nothing is removed."""
    return wanted.select(key).distinct().join(state.select(key, F.lit(True).alias("has")), key, "left").select(key, F.coalesce("has", F.lit(False)).alias("kept"))


def older_than_seen(arrivals: DataFrame, key: str, order: str, span: int = 100_000) -> DataFrame:
    """Arrivals published before something that came earlier.

    A key's arrivals are dealt into spans of `order`, so that no task sorts more than one span of a key; what came before a span
    is the greatest of the earlier spans' newest dates, one row for each key and span."""
    dealt = arrivals.withColumn("_span", F.floor(F.col(order) / span))
    whole = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(key, "_span").agg(F.max("published").alias("_top"))
    tops = tops.select(key, "_span", F.max("_top").over(whole).alias("_before"))
    within = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("_seen", F.max("published").over(within)).join(tops, [key, "_span"])
    newest = F.greatest("_seen", "_before").alias("newest_before")  # nulls are left out
    return seen.select(*arrivals.columns, newest).filter(F.col("published") < F.col("newest_before"))


def histogram(state: DataFrame) -> DataFrame:
    return state.groupBy("processing_count").agg(F.count("*").alias("n"))
