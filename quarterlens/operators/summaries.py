"""Summaries of runs and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus(df: DataFrame, ticker: str, period: str, size: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_reports"),
        F.array_join(F.array_sort(F.collect_set(ticker)), ",").alias("tickers"),
        F.array_join(F.array_sort(F.collect_set(period)), ",").alias("periods"),
        F.round(F.sum(F.col(size).cast("double")) / (1024 * 1024), 2).alias("total_size_mb"),
    )


def corpus_totals(df: DataFrame, ticker: str, period: str, tables: str, images: str, size: str) -> DataFrame:
    """One row over the reports of a corpus: how many, of how many tickers and periods, and what they hold."""
    return df.agg(
        F.count("*").alias("total_reports"), F.count_distinct(ticker).alias("unique_tickers"), F.count_distinct(period).alias("unique_periods"),
        F.sum(tables).alias("total_tables"), F.sum(images).alias("total_images"),
        F.round(F.sum(F.col(size).cast("double")) / (1024 * 1024), 2).alias("total_size_mb"),
    )


def failed_rows(df: DataFrame, error: str, order: str, most: int = 5) -> DataFrame:
    """The first failures in order, each with its last error, how often it was tried, and its category (what precedes the first
    colon of the error)."""
    bad = df.filter(F.col(error).isNotNull()).groupBy("company").agg(
        F.max_by(error, order).alias("last_error"), F.count("*").alias("total_attempts"), F.min(order).alias("first")
    )
    category = F.trim(F.split_part("last_error", F.lit(":"), F.lit(1)))
    return bad.withColumn("category", category).orderBy("first").limit(most).select("company", "last_error", "total_attempts", "category")


def pipeline(df: DataFrame, stages: dict[str, str], confidence: str) -> DataFrame:
    """How many rows passed each stage, and the mean confidence of those that passed the first (missing counts as 0)."""
    first = F.expr(next(iter(stages.values())))
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.expr(e)).alias(n) for n, e in stages.items()],
        F.round(F.avg(F.when(first, F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)))), 3).alias("avg_confidence"),
    )


def run_totals(df: DataFrame, ok: str, seconds: str, elapsed: float) -> DataFrame:
    """Counts, success rate in per cent, mean time, speed-up over one worker, and the verdict (half must succeed)."""
    n, good = F.count("*"), F.count_if(F.expr(ok))
    return df.agg(
        n.alias("total"), good.alias("succeeded"), (n - good).alias("failed"), F.round(100 * good / n, 4).alias("rate"),
        F.round(F.avg(seconds), 6).alias("avg_seconds"), F.round(F.avg(seconds) * n / elapsed, 6).alias("speed_up"),
        (2 * good >= n).alias("passed"),
    )


def failures(df: DataFrame, error: str, most: int = 5) -> DataFrame:
    """The commonest errors."""
    return df.filter(F.col(error).isNotNull()).groupBy(error).agg(F.count("*").alias("n")).orderBy(F.desc("n"), error).limit(most)


def outcomes(df: DataFrame, key: str, ok: str) -> DataFrame:
    """Successes and failures by key, as uploads, downloads and parses report them."""
    good = F.count_if(F.expr(ok))
    return df.groupBy(key).agg(F.count("*").alias("total"), good.alias("successful"), (F.count("*") - good).alias("failed"))
