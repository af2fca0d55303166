"""Fiscal periods (YYYY-Q#) from titles, dates and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nullif_empty, py_strip

_WORDS = {"first": "1", "second": "2", "third": "3", "fourth": "4"}


def _period(year: Column, quarter: Column) -> Column:
    """The period if both parts are in range: two-digit years pivot at 50, years run from 2000 to 2030."""
    full = F.when(
        F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 50, "20").otherwise("19"), year)
    ).otherwise(year)
    ok = full.try_cast("int").between(2000, 2030) & quarter.try_cast("int").between(1, 4)
    return F.when(ok, F.concat(full, F.lit("-Q"), quarter))


def period_from_title(title: Column) -> Column:
    """The first of the known spellings that gives a valid period. Number words count in lower case only, `2024 q1` and
    `1q24` likewise; spellings that name a month's end give none."""
    t = py_strip(title)
    part = lambda p, g: nullif_empty(F.regexp_extract(t, p, g))
    q_year = r"(?i)q([1-4])\s+(\d{4})"
    words = r"(?i)(first|second|third|fourth)\s+quarter\s+(\d{4})"
    year_q = r"(\d{4})\s+q([1-4])"
    fiscal = r"(?i)fy(\d{2,4})\s+q([1-4])"
    short = r"([1-4])q(\d{2,4})"
    number = None
    for w, n in _WORDS.items():
        number = F.when(part(words, 1) == w, n) if number is None else number.when(part(words, 1) == w, n)
    fiscal_year = F.when(F.length(part(fiscal, 1)) == 4, part(fiscal, 1))
    return F.coalesce(
        _period(part(q_year, 2), part(q_year, 1)),
        _period(part(words, 2), number),
        _period(part(year_q, 1), part(year_q, 2)),
        _period(fiscal_year, part(fiscal, 2)),
        _period(part(short, 2), part(short, 1)),
    )


def period_from_date(iso: Column) -> Column:
    day = F.split_part(iso, F.lit("T"), F.lit(1))
    d = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def infer_period(title: Column, published: Column) -> Column:
    """From the title, else from the date; null where neither tells."""
    return F.coalesce(period_from_title(title), period_from_date(published))


def normalize_period(s: Column) -> Column:
    """Canonical form: a valid one as it is, else the first four digits with the next digit from 1 to 4; else null."""
    u = F.upper(py_strip(s))
    loose = r"(\d{4}).*?([1-4])"
    year, quarter = (nullif_empty(F.regexp_extract(u, loose, g)) for g in (1, 2))
    return F.when(u.rlike(r"^\d{4}-Q[1-4]$"), u).otherwise(F.concat(year, F.lit("-Q"), quarter))


def ticker_from_filename(name: Column) -> Column:
    return F.coalesce(nullif_empty(F.regexp_extract(name, r"^([A-Z]{2,5})", 1)), F.lit("UNKNOWN"))


def period_from_filename(name: Column, default: str = "2025-Q4") -> Column:
    pattern = r"(\d{4})[_\-]?Q?([1-4])"
    year, quarter = (nullif_empty(F.regexp_extract(name, pattern, g)) for g in (1, 2))
    return F.coalesce(F.concat(year, F.lit("-Q"), quarter), F.lit(default))


def expected_quarter(as_of: Column) -> Column:
    """struct(target_year, target_quarter, fallback_year, fallback_quarter): the latest quarter reported by a date."""
    y, m = F.year(as_of), F.month(as_of)
    pick = lambda a, b, c, d, e: F.when(m >= 11, a).when(m == 10, b).when(m >= 8, c).when(m >= 5, d).otherwise(e)
    return F.struct(
        pick(y, y, y, y, y - 1).alias("target_year"),
        pick(F.lit(3), F.lit(3), F.lit(2), F.lit(1), F.lit(4)).alias("target_quarter"),
        (y - 1).alias("fallback_year"),
        pick(F.lit(2), F.lit(2), F.lit(1), F.lit(4), F.lit(3)).alias("fallback_quarter"),
    )
