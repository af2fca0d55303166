"""Document texts: hashes, heads, truncation, lists, tables and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, py_strip
from .ranking import keep_first


def digests(text: Column) -> list[Column]:
    raw = text.cast("binary")
    return [F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"), F.octet_length(raw).cast("long").alias("n_bytes")]


def dedup_by_hash(df: DataFrame, text: str, keys: list[str], order: str) -> DataFrame:
    """The first row of each text within a key. Only the hash is compared and moved."""
    return keep_first(df.withColumn("md5", F.md5(F.col(text).cast("binary"))).drop(text), [*keys, "md5"], order)


def duplicate_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count("*").alias("total"), F.count_distinct(F.md5(F.col(text).cast("binary"))).alias("extracted"))
    return per.withColumn("duplicates", F.col("total") - F.col("extracted"))


def extraction_totals(per: DataFrame, n_files: int | None = None) -> DataFrame:
    """One row over files with their counts (see duplicate_counts; files without an image may be left out or have 0)."""
    some = F.col("extracted") > 0
    added = lambda c: F.coalesce(F.sum(F.when(some, F.col(c))), F.lit(0))
    files = F.count("*") if n_files is None else F.lit(n_files)
    return per.agg(
        files.cast("long").alias("processed"), F.count_if(some).alias("with_images"), added("extracted").alias("unique_images"),
        added("duplicates").alias("duplicate_images"), (added("extracted") + added("duplicates")).alias("total_images"),
    )


def head_lines(text: Column, n: int = 20) -> Column:
    return F.slice(F.split(text, "\n", -1), 1, n)


def report_type(name: Column, text: Column) -> Column:
    """From the file's name, then from the first lines of the text; `press` if neither tells."""
    n = F.lower(name)
    head = F.lower(F.array_join(F.transform(head_lines(text), py_strip), "\n"))
    return (
        F.when(contains_any(n, ["presentation", "slides", "deck"]), "presentation")
        .when(contains_any(n, ["supplemental", "supplement"]), "supplemental")
        .when(contains_any(head, ["earnings call", "conference call"]), "presentation")
        .otherwise("press")
    )


def title_of(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" "))


def truncated(text: Column, most: int = 100_000, mark: str = "\n[TRUNCATED]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def first_parts(df: DataFrame, key: str, order: str, name: Column, text: Column, most: int = 5) -> DataFrame:
    """The first parts of each key as one text, each under its name, in order. Later parts never leave their task."""
    from .ranking import top_k

    few = top_k(df.withColumn("_part", F.concat(F.lit("TABLE: "), name, F.lit("\n"), text)), [key], most, order)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("_part").alias("p"))))
    return few.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s["p"]), "\n\n").alias("content"))


def markdown_to_csv(md: Column) -> Column:
    """A Markdown table as CSV: rule lines and empty cells go, every cell is quoted."""
    lines = F.filter(F.transform(F.split(md, "\n", -1), py_strip), lambda x: (x != "") & ~x.startswith("|--"))
    cells = F.transform(
        lines, lambda x: F.filter(F.transform(F.split(x, r"\|", -1), py_strip), lambda c: c != "")
    )
    rows = F.transform(
        F.filter(cells, lambda r: F.size(r) > 0),
        lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ","),
    )
    return F.array_join(rows, "\n")


def table_export(frame: Column, direct: Column, other: Column, md: Column) -> Column:
    """struct(method, csv) of the first way of exporting a table that gives anything: as a frame with rows, as CSV, as another
    frame with rows, or from Markdown; null if none does. A frame is CSV with a line for its header."""
    rows = lambda c: F.when(F.contains(py_strip(c), F.lit("\n")), c)
    tried = [("dataframe", rows(frame)), ("csv", direct), ("to_dataframe", rows(other)), ("markdown", F.nullif(markdown_to_csv(md), F.lit("")))]
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("method"), c.alias("csv"))) for n, c in tried])


def clean_json(text: Column) -> Column:
    """Model output without code fences, from the first { to the last }."""
    s = py_strip(F.regexp_replace(F.regexp_replace(text, r"```json\s*", ""), r"```\s*$", ""))
    start = F.instr(s, "{")
    s = F.when(~s.startswith("{") & (start > 0), F.substring(s, start, F.length(s))).otherwise(s)
    end = F.length(s) - F.instr(F.reverse(s), "}") + 1
    return F.when(~s.endswith("}") & F.contains(s, F.lit("}")), F.substring(s, F.lit(1), end)).otherwise(s)


RECORD = (
    "ticker string, period string, published string, report_type string, revenue struct<value:double,unit:string,scale:string>, "
    "eps_diluted double, guidance_summary string, key_highlights array<string>, fields_missing array<string>, confidence double"
)


def parsed_record(text: Column, ticker: Column, period: Column, published: Column, kind: Column) -> Column:
    """The record in a model's output with the known keys put over it; a record of confidence 0 if it can't be read."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    r = F.from_json(clean_json(text), schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(clean_json(text)).isNotNull() & r["confidence"].isNotNull()
    known = {"ticker": ticker, "period": period, "published": published, "report_type": kind}
    lost = {
        "revenue": F.struct(F.lit(None).cast("double").alias("value"), F.lit("USD").alias("unit"), F.lit("null").alias("scale")),
        "eps_diluted": F.lit(None).cast("double"),
        "guidance_summary": F.lit("Extraction failed - see error log"),
        "key_highlights": F.array().cast("array<string>"),
        "fields_missing": F.array(*[F.lit(x) for x in ("revenue", "eps_diluted", "guidance_summary", "key_highlights")]),
        "confidence": F.lit(0.0),
    }
    fields = [known[n].alias(n) if n in known else F.when(ok, r[n]).otherwise(lost[n]).alias(n) for n in schema.names]
    return F.struct(*fields, ok.alias("extracted"))
