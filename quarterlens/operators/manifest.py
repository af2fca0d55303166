"""Manifest entries and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import keep_first


def entry(**fields: Column) -> Column:
    """A manifest entry as a struct, its fields in the order given."""
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def full_entry(e: Column, root: str, parser: str, model: str) -> Column:
    """The manifest entry of a report as a struct of all its fields. e: ticker, period, published, report_type, source_url, sha256,
    filename, and, where the report was parsed or a record drawn from it, pages, tables, version, confidence; notes.

    The file's place follows from ticker, period and name; pages and tables are 0 where nothing was parsed, and the parser is
    named only where there's a version; a record's place and confidence are given only where there's one."""
    parsed, drawn = e["version"].isNotNull(), e["confidence"].isNotNull()
    folder = F.concat_ws("/", F.lit(root), F.lit("parsed"), e["ticker"], e["period"])
    return F.struct(
        *[e[n].alias(n) for n in ("ticker", "period", "published", "report_type", "source_url")],
        F.concat_ws("/", F.lit(root), F.lit("raw"), e["ticker"], e["period"], e["filename"]).alias("pdf_path"),
        e["sha256"].alias("sha256"), e["filename"].alias("filename"),
        F.when(parsed, F.coalesce(e["pages"], F.lit(0))).otherwise(0).alias("pages"),
        F.when(parsed, F.coalesce(e["tables"], F.lit(0))).otherwise(0).alias("tables"),
        F.when(parsed, F.struct(F.lit(parser).alias("engine"), e["version"].alias("version"))).alias("parser"),
        F.when(
            drawn,
            F.struct(
                F.lit("guided").alias("engine"), F.lit(model).alias("model"), F.concat(folder, F.lit("/structured.json")).alias("path"),
                e["confidence"].alias("confidence"),
            ),
        ).alias("structured"),
        F.coalesce(e["notes"], F.array().cast("array<string>")).alias("notes"),
    )


def latest(df: DataFrame, key: str, published: str, order: str) -> DataFrame:
    """The latest entry of each key; a missing date is the earliest, and of equal dates the first in order counts."""
    return keep_first(df, [key], F.desc(F.coalesce(F.col(published), F.lit(""))), order)


def known(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (such as ticker and hash) the manifest already has."""
    return df.join(seen.select(*keys).distinct(), keys, "left_semi")


def summary(df: DataFrame, ticker: str, confidence: str) -> DataFrame:
    """One row: how many entries and tickers, and the mean confidence of those that have one (0 if none has)."""
    return df.agg(
        F.count("*").alias("total_reports"),
        F.count_distinct(ticker).alias("unique_tickers"),
        F.coalesce(F.round(F.avg(confidence), 3), F.lit(0.0)).alias("avg_confidence"),
        F.count(confidence).alias("confidence_samples"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))
