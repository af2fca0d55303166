"""Validators that gather all errors of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P

from ..functions.text import contains_any, py_strip
from ..params import CONTENT_TERMS


def messages(*cases: tuple[Column, Column | str]) -> Column:
    """The messages of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in cases]))


def text_outputs(text: Column, n_tables: Column) -> Column:
    """Errors of an extraction: a text that is missing, short or off the subject. As a message about a text begins with a
    capital, a poor text does not count as missing beside the tables."""
    s = py_strip(text)
    return messages(
        (text.isNull(), "Text file not found"),
        (F.length(s) < 100, F.concat(F.lit("Text file too short: "), F.length(s).cast("string"), F.lit(" chars"))),
        ((F.length(s) >= 100) & ~contains_any(F.lower(s), CONTENT_TERMS), "Text file does not appear to contain earnings content"),
        (text.isNull() & (n_tables == 0), "Neither meaningful text nor tables found - extraction may have failed"),
    )


def table_outputs(tables: Column) -> Column:
    """Errors of an extraction's tables, an array of (name, content): missing ones (null) and those that hold next to nothing."""
    bad = F.transform(
        tables,
        lambda t: F.when(t["content"].isNull(), F.concat(F.lit("Table file not found: "), t["name"])).when(
            F.length(py_strip(t["content"])) < 10, F.concat(F.lit("Table file too small: "), t["name"])
        ),
    )
    return F.coalesce(F.array_compact(bad), F.array().cast("array<string>"))


def extraction(text: Column, tables: Column) -> Column:
    """All errors of an extraction: of its text, of text and tables together, and of each table."""
    return F.concat(text_outputs(text, F.coalesce(F.size(tables), F.lit(0))), table_outputs(tables))


def objects(present: Column, required: list[str], paths: Column, known: list[str]) -> Column:
    """Errors of a report's stored objects. paths: struct of the place of each known kind; present: the places that exist."""
    return messages(
        *[
            (F.lit(True), f"Unknown object type: {n}") if n not in known
            else (~F.array_contains(present, paths[n]), F.concat(F.lit("Missing GCS object: "), paths[n]))
            for n in required
        ]
    )


def structured_json(json: Column, ticker: Column, period: Column) -> Column:
    """Errors of a structured record as JSON text, those of the wrong kind of value included."""
    v = F.try_parse_json(json)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = lambda path: kind(path).rlike(r"^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    text = lambda path: F.try_variant_get(v, path, "string")
    given = lambda path: F.try_variant_get(v, path, "variant").isNotNull() & (kind(path) != "VOID")
    shown = lambda path: F.coalesce(text(path), F.lit("None"))
    told = lambda s, *cols: F.format_string(s, *cols)
    conf = F.when(F.try_variant_get(v, "$.confidence", "variant").isNull(), 0.0).when(number("$.confidence"), F.try_variant_get(v, "$.confidence", "double"))
    # what is empty, zero or false counts as absent
    empty = F.to_json(F.try_variant_get(v, "$.revenue", "variant")).isin('""', "0", "0.0", "false", "{}", "[]")
    revenue = given("$.revenue") & ~F.coalesce(empty, F.lit(True))
    record = revenue & F.coalesce(kind("$.revenue").startswith("OBJECT"), F.lit(False))
    value = F.try_variant_get(v, "$.revenue.value", "double")
    scale = text("$.revenue.scale")
    missing = ("ticker", "period", "published", "report_type", "confidence")
    return messages(
        *[(F.try_variant_get(v, f"$.{n}", "variant").isNull(), f"Missing required field: {n}") for n in missing],
        (~text("$.ticker").eqNullSafe(ticker), told("Ticker mismatch: expected %s, got %s", ticker, shown("$.ticker"))),
        (~text("$.period").eqNullSafe(period), told("Period mismatch: expected %s, got %s", period, shown("$.period"))),
        (~F.coalesce(conf.between(0, 1), F.lit(False)), told("Invalid confidence value: %s", shown("$.confidence"))),
        (conf.between(0, 1) & (conf < 0.1), F.concat(F.lit("Very low confidence: "), F.coalesce(text("$.confidence"), F.lit("0")))),
        (revenue & ~record, "Revenue should be a dictionary"),
        (record & given("$.revenue.value") & ~number("$.revenue.value"), "Revenue value should be numeric"),
        (record & number("$.revenue.value") & (value < 0), "Revenue value is negative"),
        (record & ~text("$.revenue.unit").eqNullSafe("USD"), told("Unexpected revenue unit: %s", shown("$.revenue.unit"))),
        (record & (scale != "") & ~scale.isin("B", "M", "K", "null"), told("Invalid revenue scale: %s", scale)),
        (given("$.eps_diluted") & ~number("$.eps_diluted"), "EPS should be numeric or null"),
        (F.try_variant_get(v, "$.key_highlights", "variant").isNotNull() & ~kind("$.key_highlights").startswith("ARRAY"), "Key highlights should be a list"),
        (F.size(F.try_variant_get(v, "$.key_highlights", "array<variant>")) > 5,
         told("Too many key highlights: %s (max 5)", F.size(F.try_variant_get(v, "$.key_highlights", "array<variant>")).cast("string"))),
    )


def structured(r: Column, ticker: Column, period: Column) -> Column:
    """Errors of a structured record."""
    missing = [
        (r[n].isNull(), f"Missing required field: {n}") for n in ("ticker", "period", "published", "report_type", "confidence")
    ]
    told = lambda s, *cols: F.format_string(s, *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])
    conf, rev = F.coalesce(r["confidence"], F.lit(0.0)), r["revenue"]
    return messages(
        *missing,
        (~r["ticker"].eqNullSafe(ticker), told("Ticker mismatch: expected %s, got %s", ticker, r["ticker"])),
        (~r["period"].eqNullSafe(period), told("Period mismatch: expected %s, got %s", period, r["period"])),
        (~conf.between(0, 1), "Invalid confidence value"),
        (conf.between(0, 1) & (conf < 0.1), "Very low confidence"),
        (rev["value"] < 0, "Revenue value is negative"),
        (rev.isNotNull() & ~rev["unit"].eqNullSafe("USD"), told("Unexpected revenue unit: %s", rev["unit"])),
        ((rev["scale"] != "") & ~rev["scale"].isin("B", "M", "K", "null"), told("Invalid revenue scale: %s", rev["scale"])),
        (F.size(r["key_highlights"]) > 5, told("Too many key highlights: %s (max 5)", F.size(r["key_highlights"]))),
    )


def manifest_entry(e: Column, confidence: Column) -> Column:
    """Errors of a manifest entry."""
    text = lambda n: F.coalesce(e[n], F.lit(""))
    required = ("ticker", "period", "published", "report_type", "source_url", "sha256", "filename")
    ticker = text("ticker")
    upper = (F.upper(ticker) == ticker) & (F.lower(ticker) != ticker)
    return messages(
        *[(text(n) == "", f"Missing or empty required field: {n}") for n in required],
        (F.length(text("sha256")) != 64, F.concat(F.lit("Invalid SHA256 length: "), F.length(text("sha256")).cast("string"))),
        (~upper | (F.length(ticker) > 5), F.concat(F.lit("Invalid ticker format: "), ticker)),
        (~text("pdf_path").startswith("gs://"), F.concat(F.lit("Invalid GCS PDF path: "), text("pdf_path"))),
        (~confidence.between(0, 1), "Invalid structured confidence"),
    )


def required_objects(present: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(x) for x in required]), present)


def combined(**checks: Column) -> Column:
    """struct(checks, overall_passed, error_count): each check's verdict and errors, and all together."""
    each = [F.struct(F.lit(n).alias("name"), (F.size(c) == 0).alias("passed"), c.alias("errors")) for n, c in checks.items()]
    total = sum((F.size(c) for c in checks.values()), F.lit(0))
    return F.struct(F.array(*each).alias("checks"), (total == 0).alias("overall_passed"), total.alias("error_count"))


def first_error(errors: Column) -> Column:
    return F.try_element_at(errors, F.lit(1))


def config_problems(companies: Column, workers: Column, as_of: Column) -> Column:
    """What is wrong with a run's settings, all of it: companies (an array of tickers) that aren't known, too few workers, no ISO date."""
    known = F.array(*[F.lit(c[0]) for c in P.COMPANIES])
    unknown = F.transform(F.array_except(companies, known), lambda c: F.concat(F.lit("unknown company: "), c))
    few = F.when(workers < 1, "workers must be at least 1")
    undated = F.when(F.length(as_of) != 10, "as_of must be an ISO date")
    return F.concat(unknown, F.array_compact(F.array(few, undated)))
