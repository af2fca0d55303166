"""Classification and scores of links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .rules import chart_or_summary
from .text import combined, contains_any, let, points, weighted_first


def _chain(cases: list[tuple[Column, object]], otherwise) -> Column:
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def classification(text: Column, url: Column, base_year: int = 2025) -> Column:
    """struct(priority, year, type, extracted_year, extracted_quarter, is_latest_expected), null if it is no report."""
    c = combined(text, url)
    annual_word = contains_any(c, ["annual", "10-k"])
    quarterly = contains_any(c, ["10-q", "q1", "q2", "q3", "quarterly"])
    parts = {
        "year": _chain([(c.contains(str(y)), y) for y in P.YEARS], base_year),
        "quarter": _chain([(contains_any(c, w), q) for q, w in P.QUARTER_WORDS] + [(annual_word, 4)], F.lit(None).cast("int")),
        "kind": _chain([(quarterly, "quarterly"), (annual_word, "annual")], "quarterly"),
    }
    return F.when(contains_any(c, P.REPORT_WORDS), let(lambda x: _class_of(x["year"], x["quarter"], x["kind"], base_year), **parts))


def _class_of(year: Column, quarter: Column, kind: Column, base_year: int) -> Column:
    first = _chain([(quarter == 4, 1.0), (quarter == 3, 1.1), (quarter == 2, 1.2), (quarter == 1, 1.3)], 10.0)
    priority = _chain(
        [(year >= base_year, first), (year == base_year - 1, 2.0 + (4 - F.coalesce(quarter, F.lit(4))) * 0.1)], 5.0
    ) + F.when(kind == "annual", 0.5).otherwise(0.0)
    latest = (year >= base_year) & F.coalesce(quarter.isin(3, 4), F.lit(False))
    y = year.cast("string")
    label = F.concat(
        F.when(quarter.isNull(), F.concat(y, F.lit("_latest")))
        .when((quarter == 4) & (kind == "annual"), F.concat(y, F.lit("_Q4_Annual")))
        .otherwise(F.concat(y, F.lit("_Q"), quarter.cast("string"))),
        F.when(latest, "_LATEST_EXPECTED").otherwise(""),
    )
    return F.struct(
        priority.alias("priority"), label.alias("year"), kind.alias("type"), year.alias("extracted_year"),
        quarter.alias("extracted_quarter"), latest.alias("is_latest_expected"),
    )


def date_info(c: Column) -> Column:
    """struct(year, quarter, is_earnings, is_annual) of a lower-case text."""
    year = _chain([(c.contains(str(y)), y) for y in (2025, 2024, 2023)], F.lit(None).cast("int"))
    quarter = _chain([(c.rlike(p), q) for p, q in P.LEGACY_QUARTERS], F.lit(None).cast("int"))
    return F.struct(
        year.alias("year"), quarter.alias("quarter"), contains_any(c, P.LEGACY_EARNINGS).alias("is_earnings"),
        contains_any(c, ["annual", "10-k"]).alias("is_annual"),
    )


def legacy_classification(text: Column, url: Column) -> Column:
    """The older table of priorities: struct(priority, year, type), null if it isn't about earnings."""
    d = date_info(combined(text, url))
    year, quarter, annual = d["year"], d["quarter"], d["is_annual"]
    step = (4 - quarter) * 0.1
    q = quarter.cast("string")
    has = quarter.isNotNull()
    now, last = F.coalesce(year == 2025, F.lit(False)), F.coalesce(year == 2024, F.lit(False))
    closing = F.coalesce(quarter == 4, F.lit(False)) | annual
    cases = [
        (now & has, 1 + step, F.concat(F.lit("2025_Q"), q), F.lit("quarterly")),
        (now & annual, F.lit(2.0), F.lit("2025_annual"), F.lit("annual")),
        (now, F.lit(3.0), F.lit("2025"), F.lit("quarterly")),
        (last & closing, F.lit(4.0), F.lit("2024_Q4_annual"), F.lit("annual")),
        (last & has, 5 + step, F.concat(F.lit("2024_Q"), q), F.lit("quarterly")),
        (last, F.lit(6.0), F.lit("2024"), F.lit("quarterly")),
    ]
    old = F.coalesce(year.cast("string"), F.lit("older"))
    kind = F.when(annual, "annual").otherwise("quarterly")
    made = F.struct(
        _chain([(a, b) for a, b, _, _ in cases], 8.0).alias("priority"),
        _chain([(a, b) for a, _, b, _ in cases], old).alias("year"),
        _chain([(a, b) for a, _, _, b in cases], kind).alias("type"),
    )
    return F.when(d["is_earnings"], made)


def content_bonus(c: Column) -> Column:
    return _chain([(contains_any(c, P.SUPER_STRONG), 0.5), (contains_any(c, P.STRONG), 0.3), (contains_any(c, P.MEDIUM), 0.1)], 0.0)


def quarter_priority(c: Column) -> Column:
    """How much a text speaks of a quarter of the current fiscal years."""
    # the weights fall, so the first one that holds is the greatest
    base = _chain(
        [
            (~contains_any(c, P.FISCAL_YEARS), 0.0),
            (chart_or_summary(c), 0.05),
            *[(contains_any(c, words), w * 0.8) for words, w in P.QUARTER_WEIGHTS],
            (contains_any(c, ["earning", "quarterly", "10-q"]), 0.6),
        ],
        0.2,
    )
    # only a named quarter or an earnings word (0.4 and more) earns the bonus
    return let(lambda x: x["base"] + F.when(x["base"] > 0.3, x["bonus"]).otherwise(0.0), base=base, bonus=content_bonus(c))


def _later_date(c: Column, after: tuple[int, int, int]) -> Column:
    """Whether the text names a valid date of that year after it."""
    year, last = after[0], after[1] * 100 + after[2]
    days = lambda m: F.when(m == 2, 28).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = lambda m, d: m.between(1, 12) & (d >= 1) & (d <= days(m)) & (m * 100 + d > last)
    month = F.when(c.contains("oct"), 10).when(c.contains("nov"), 11).otherwise(12)
    # a search for the word comes first: it's far cheaper than the expression, and mostly fails
    found = [
        c.contains(word) & F.exists(F.regexp_extract_all(c, F.lit(rf"{w}\s+(\d{{1,2}}),?\s+{year}"), F.lit(1)), lambda d: ok(month, d.cast("int")))
        for word, w in (("oct", "oct(?:ober)?"), ("november", "november"), ("december", "december"))
    ]
    pair = rf"(\d{{1,2}}/\d{{1,2}})/{year}"
    found.append(
        c.contains(f"/{year}")
        & F.exists(
            F.regexp_extract_all(c, F.lit(pair), F.lit(1)),
            lambda x: ok(F.split_part(x, F.lit("/"), F.lit(1)).cast("int"), F.split_part(x, F.lit("/"), F.lit(2)).cast("int")),
        )
    )
    return found[0] | found[1] | found[2] | found[3]


def availability(c: Column, score: Column, year: int = 2025, month: int = 10, after: tuple[int, int, int] = (2025, 10, 9)) -> Column:
    """The score, lowered if the report can't be out yet, is a calendar entry or an event page, or is old. First rule counts."""
    has = c.contains
    closed = contains_any(c, ["q4", "fourth quarter", "10-k", "annual"])
    return score * _chain(
        [
            (_later_date(c, after), 0.1),
            (has("q3") & has("2025") & contains_any(c, ["conference", "call"]), 0.2),
            (contains_any(c, [".ics", "calendar"]), 0.3),
            (has("q4") & has(str(year)) & F.lit(month <= 10), 0.95),
            (contains_any(c, ["earnings-call", "conference-call", "webcast", "event-details"]) & has("event"), 0.3),
            (has("2024") & closed, 0.7),
            (has("2024"), 0.4),
        ],
        1.0,
    )


def comprehensive_score(text: Column, url: Column, year: int = 2025, month: int = 10, after=(2025, 10, 9)) -> Column:
    """All signs of a current report added up (the year's bonus counts twice), at most 1, then the availability rules."""
    c, u = combined(text, url), F.lower(F.coalesce(url, F.lit("")))
    bonus = weighted_first(c, [(str(year), 0.5), (str(year - 1), 0.2), (str(year - 2), 0.05)])
    total = (
        quarter_priority(c) + bonus + bonus
        + weighted_first(c, P.quarter_patterns(month)) * 0.2
        + _chain([(contains_any(c, ["earning", "quarterly", "10-q"]), 0.3), (contains_any(c, ["10-k", "annual"]), 0.15)], 0.0)
        + _chain([(u.contains(".pdf"), 0.1), (contains_any(u, [".xlsx", ".xls"]), 0.05)], 0.0)
        + points(contains_any(c, ["latest", "recent", "current", "new"]), 0.2)
        + points(c.contains(str(year)[-2:]), 0.25)
    )
    return availability(c, F.least(total, F.lit(1.0)), year, month, after)


def final_score(score: Column, strategy: Column, priority: Column) -> Column:
    named = F.coalesce(strategy, F.lit("comprehensive_scan"))
    bonus = _chain([(named == s, b) for s, b in P.STRATEGY_BONUS], 0.0)
    rank = F.greatest(F.lit(0.0), (6 - F.coalesce(priority, F.lit(5.0))) * 0.1)
    return F.least(score + bonus + rank, F.lit(1.0))


def keyword_score(text: Column, url: Column) -> Column:
    t, u = F.lower(text), F.lower(url)
    return 0.8 + points(t.contains("2025") | u.contains("2025"), 0.1) + points(u.contains("pdf"), 0.1)


def ir_confidence(text: Column, url: Column) -> Column:
    t, u = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    total = F.lit(0.0)
    for weight, words in P.IR_CONFIDENCE:
        for w in words:
            total = total + points(t.contains(w) | u.contains(w), weight)
    return F.least(total, F.lit(1.0))


def pdf_link_score(url: Column, text: Column, ticker: Column) -> Column:
    u, t = F.lower(url), F.lower(text)
    either = lambda w: u.contains(w) | t.contains(w)
    total = points(u.contains(F.lower(ticker)), 10)
    for w in P.PDF_TERMS:
        total = total + points(either(w), 5)
    total = total + F.when(either("2025"), 3).when(either("2024"), 1).otherwise(0)
    for w in P.PDF_DOMAINS:
        total = total + points(u.contains(w), 2)
    for w in P.PDF_GENERIC:
        total = total - points(t.contains(w), 1)
    return total


def pdf_choice_score(url: Column, text: Column, ticker: Column) -> Column:
    """The scale by which one PDF of several is chosen."""
    u, t = F.lower(url), F.lower(text)
    either = lambda words: contains_any(u, words) | contains_any(t, words)
    return (
        points(u.contains(F.lower(ticker)) | contains_any(u, ["investor", "earnings"]), 3)
        + points(either(["earnings", "financial", "report", "10-q"]), 2)
        + points(either(["presentation", "press release"]), 1)
        + F.when(either(["2025"]), 2).when(either(["2024"]), 1).otherwise(0)
        + points(either(["q1", "q2", "q3", "q4", "quarterly"]), 1)
        + points(contains_any(u, ["q4cdn", "ir.", "investors."]), 1)
        - points(contains_any(t, ["download", "view", "click here"]), 1)
    )
