"""Ranking, keep-first and the cascade of search strategies, with explicit orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules, scoring
from ..functions.text import combined, contains_any, let
from ..params import EngineParams
from ..sources.files import written


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order. (dropDuplicates keeps an arbitrary one.)"""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def scored(links: DataFrame, p: EngineParams, strategy: str | Column = "comprehensive_scan", valid: bool = False) -> DataFrame:
    """Links that are reports (valid ones only, if asked for), with class, score and final score. The generator computes class and score once; filters and later
    columns refer to its output instead of holding copies of the expressions."""
    strategy = F.lit(strategy) if isinstance(strategy, str) else strategy
    made = F.struct(
        scoring.classification(F.col("text"), F.col("url"), p.base_year).alias("class"),
        scoring.comprehensive_score(F.col("text"), F.col("url"), p.year, p.month, p.future_after).alias("score"),
        (rules.valid_report_link(F.col("url"), F.col("text"), p.year) if valid else F.lit(True)).alias("valid"),
    )
    rows = links.withColumn("strategy", strategy).select(
        "*", F.inline(F.filter(F.array(made), lambda m: m["class"].isNotNull() & m["valid"]))
    )
    rows = rows.drop("valid")
    return rows.withColumn("final_score", scoring.final_score(F.col("score"), F.col("strategy"), F.col("class.priority")))


def best_report(links: DataFrame, p: EngineParams, key: str = "company_id", order: str = "link_id") -> DataFrame:
    """The best report of each company: highest final score, then input order. An address that comes several times can't be but once
    the best, so a partial aggregation is enough; only one row of each company and task moves."""
    ranked = scored(links, p, valid=True)
    first = F.min(F.struct((-F.col("final_score")).alias("_rank"), F.col(order).alias("_order"), F.struct(*ranked.columns).alias("row")))
    return ranked.groupBy(F.col(key).alias("_key")).agg(first.alias("best")).select("best.row.*")


def _hits(links: DataFrame, p: EngineParams, strategies: Callable[[Column], list[tuple]]) -> DataFrame:
    """A row for each link and strategy that takes it, with its class, score, and whether it's a current quarter's report."""
    text, url = F.col("text"), F.col("url")
    c = combined(text, url)
    t, u = F.lower(text), F.lower(url)
    joined = lambda c, words, change: contains_any(c, sorted({change(w) for w in words}))
    dashed = lambda w: w.replace(" ", "-")
    page_hit = contains_any(t, P.PAGE_INDICATORS) | joined(u, P.PAGE_INDICATORS, dashed) | joined(t, P.PAGE_INDICATORS, lambda w: w.replace(" ", ""))
    facts = {
        "valid": rules.valid_report_link(url, text, p.year), "score": scoring.comprehensive_score(text, url, p.year, p.month, p.future_after),
        "page": page_hit,
        "sec": rules.sec_section(url, text, p.year), "recent": rules.recent_fallback(text, url), "named": text != "",
    }

    def taken(x: Column) -> Column:
        made = [F.when(on, F.struct(F.lit(n).alias("n"), F.lit(s).alias("strategy"), v.alias("score"))) for n, s, on, v in strategies(x)]
        return F.array_compact(F.array(*made))

    made = F.struct(
        scoring.classification(text, url, p.base_year).alias("class"),
        rules.skips_event(u, scoring.quarter_priority(c)).alias("current"),
        let(taken, **facts).alias("hits"),
    )
    rows = links.select("*", F.inline(F.filter(F.array(made), lambda m: m["class"].isNotNull())))
    return rows.select("*", F.inline("hits")).drop("hits")


def _on_the_page(x: Column) -> list[tuple]:
    good = x["score"] > 0.2
    return [
        (1, "whole_page_scan", x["valid"] & x["page"], F.lit(0.95)),
        (4, "comprehensive_scan", x["valid"], x["score"]),
        (6, "dynamic_discovery", x["valid"] & good, x["score"]),
        (7, "sec_filings", x["sec"], F.lit(None).cast("double")),
        (8, "fallback_search", x["recent"], F.lit(0.7)),
    ]


def _searched(found: DataFrame, n: int, strategy: str) -> DataFrame:
    """Reports that a search has found, as hits of a strategy."""
    url = F.lower("url")
    now = rules.skips_event(url, scoring.quarter_priority(combined(F.col("text"), F.col("url"))))
    return found.select("*", F.lit(n).alias("n"), F.lit(strategy).alias("strategy"), now.alias("current"))


def _on_other_pages(x: Column) -> list[tuple]:
    return [(5, "navigation_paths", x["valid"] & x["named"], F.lit(0.9))]


def navigation_links(bases: DataFrame, pages: DataFrame, links: DataFrame, key: str = "company_id", most: int = 30) -> DataFrame:
    """The first `most` links of the usual pages under each company's investor page, by path and place, as often as they come.

    bases: key and url; pages: url and title, of which those that are not there are left out by their titles; links: page (its
    address), ord, text, url. One equi-join on addresses: the paths are a literal array."""
    base = F.rtrim(F.col("url"), F.lit("/"))
    tried = bases.select(key, F.posexplode(F.transform(F.array(*[F.lit(x) for x in P.NAVIGATION_PATHS]), lambda x: F.concat(base, x))).alias("path_ord", "page"))
    there = pages.filter(~contains_any(F.lower(F.coalesce(F.col("title"), F.lit(""))), P.NAVIGATION_FAILED)).select(F.col("url").alias("page")).distinct()
    found = tried.join(there, "page").join(links.filter(F.col("ord") < most).select("page", "ord", "text", F.col("url").alias("url")), "page")
    return found.select(key, "url", "text", "path_ord", "ord")


def first_of_each(reports: DataFrame, key: str = "company_id") -> DataFrame:
    """An address of a company once: of the rows that are reports the first by path, place and text. An address may come under a text that is
    no report and then under one that is, so reports are told apart before this."""
    return keep_first(reports, [key, "url"], "path_ord", "ord", "text")


def cascade(
    links: DataFrame,
    p: EngineParams,
    key: str = "company_id",
    order: str = "link_id",
    navigation: DataFrame | None = None,
    last_resort: DataFrame | None = None,
) -> DataFrame:
    """All strategies over one scan of the links, cut where the cascade stops for each company.

    Strategies are tried in order; their hits gather. It stops after a scan with two hits or more of which one is a current
    quarter's report, or after any with three. Rows of strategies beyond that are dropped. Hits are written once and read
    twice: for the stops, which are one row for each company and strategy, and for the result. The second strategy is
    searches.keyword_search (a company's own keywords need links to have its ticker), the third searches.learned_reports.

    navigation: links of other pages (see navigation_links), with the columns of links; without it strategy 5 has none.
    last_resort: key, order and url of addresses found in a page's text (see fallback_reports); they count for companies that no
    other link of the last strategy is found for.
    """
    from . import searches  # which takes keep_first from here

    rows = _hits(links, p, _on_the_page)
    named = links if "ticker" in links.columns else links.withColumn("ticker", F.lit(None).cast("string"))
    first = written(searches.first_links(named, key, order))  # a few hundred rows a company
    second = _searched(searches.keyword_search(first, p, key, order), 2, "enhanced_keyword_search")
    third = _searched(searches.learned_reports(first, p, key, order), 3, "learned_patterns")
    for found in (second, third):
        rows = rows.unionByName(found.select(*[c for c in rows.columns if c in found.columns]), allowMissingColumns=True)
    if navigation is not None:
        rows = rows.unionByName(_hits(navigation.select(*[c for c in links.columns if c in navigation.columns]), p, _on_other_pages), allowMissingColumns=True)
    rows = written(rows)
    rows = rows.filter("n <> 7").unionByName(keep_first(rows.filter("n = 7"), [key], order))  # that strategy ends with its first
    if last_resort is not None:
        none = last_resort.join(rows.filter("n = 8").select(key).distinct(), key, "left_anti")
        label = {"priority": F.lit(5.0), "year": F.lit(f"{p.year}_fallback"), "type": F.lit("fallback")}
        kind = rows.schema["class"].dataType
        made = F.struct(*[label.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        none = none.select(
            *[c for c in links.columns if c in none.columns], made.alias("class"), F.lit(False).alias("current"), F.lit(8).alias("n"),
            F.lit("fallback_search").alias("strategy"), F.lit(0.3).alias("score"),
        )
        rows = rows.unionByName(none, allowMissingColumns=True)
    per = rows.groupBy(key, "n").agg(F.count("*").alias("hits"), F.count_if("current").alias("now"))
    stop = per.filter(((F.col("n") <= 4) & (F.col("hits") >= 2) & (F.col("now") >= 1)) | (F.col("hits") >= 3))
    last = stop.groupBy(key).agg(F.min("n").alias("stop"))
    return rows.join(last, key, "left").filter(F.col("stop").isNull() | (F.col("n") <= F.col("stop"))).drop("stop")


def best_pdf(links: DataFrame, key: str = "company_id", order: str = "link_id") -> DataFrame:
    """The best PDF of each company: of the company's own if there are any, else of all."""
    u, t = F.lower(F.col("url")), F.lower(F.col("text"))
    words = ["investor", "earnings", "q4cdn", "ir.", "financial", "quarterly"]
    ticker = F.lower(F.col("ticker"))
    mine = ~rules.third_party(F.col("url")) & (
        contains_any(u, words) | contains_any(t, words) | u.contains(ticker) | t.contains(ticker)
    )
    flagged = links.filter(u.contains(".pdf")).withColumn("own", mine)
    score = scoring.pdf_choice_score(F.col("url"), F.col("text"), F.col("ticker"))
    return keep_first(flagged.withColumn("score", score), [key], F.desc("own"), F.desc("score"), order)
