"""Searches of whole pages and of a company's links, as the strategies have them: what is looked at, in which order, and when to stop."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules, scoring
from ..functions.text import contains_any, nullif_empty
from ..functions.urls import origin, text_of_url
from ..params import EngineParams
from ..sources.files import written
from .links import CLICKABLE, may_be_clicked
from .pagetree import PAGE, fitting, near_addresses, page_tree, step
from .ranking import keep_first
from .textscan import words_in

#: Where a page's reports tend to be, in the order in which they are looked at, and how many elements of each.
DISCOVERY = {
    **{f"div[class*={w}]": [step("div", any_case=("class", w))] for w in ("report", "filing", "earning")},
    **{f"section[class*={w}]": [step("section", any_case=("class", w))] for w in ("financial", "investor")},
    "table tr td a": [step("table"), step("tr"), step("td"), step("a")], "ul li a": [step("ul"), step("li"), step("a")],
    "dl dd a": [step("dl"), step("dd"), step("a")], **{f".{c} a": [step(cls=c), step("a")] for c in ("content", "main", "primary")},
    "#main a": [step(id="main"), step("a")],
}
LOOKED = 50
_DISCOVERY_TAGS = frozenset("div section table tr td ul li dl dd a".split())


def _address(value: Column, page: Column) -> Column:
    """An address as a browser gives it: what begins with / under the page's origin; null for what is no address."""
    return F.when(value.startswith("/"), F.concat(origin(page), value)).when(value.startswith("http"), value)


def _reports(rows: DataFrame, p: EngineParams, valid: Column | None = None, scored: bool = False) -> DataFrame:
    """The rows (url, text) that are reports, with their class and, if asked for, their score; valid: other than whether address and text
    make a valid link. A generator holds the expressions once; filters and later columns refer to what it makes."""
    valid = rules.valid_report_link(F.col("url"), F.col("text"), p.year) if valid is None else valid
    parts = [scoring.classification(F.col("text"), F.col("url"), p.base_year).alias("class"), valid.alias("_valid")]
    if scored:
        parts.append(scoring.comprehensive_score(F.col("text"), F.col("url"), p.year, p.month, p.future_after).alias("score"))
    good = lambda m: m["class"].isNotNull() & m["_valid"] & (m["score"] > 0.2 if scored else F.lit(True))
    return rows.select("*", F.inline(F.filter(F.array(F.struct(*parts)), good))).drop("_valid")


def dynamic_discovery(pages: DataFrame, p: EngineParams, most: int = LOOKED) -> DataFrame:
    """Reports among the first `most` elements of each selector of DISCOVERY, as often as selectors find them: page_id, rank, selector,
    place (from 1, among the selector's), url, text, class, score. Elements without an address count as looked at, and are no reports."""

    def needed(tag: str, attributes: dict[str, str], *_) -> bool:
        return tag in _DISCOVERY_TAGS or "class" in attributes or "id" in attributes

    found = fitting(page_tree(pages, keep=needed, texts=["a"]), DISCOVERY)
    place = F.row_number().over(Window.partitionBy("page_id", "rank").orderBy("pre"))
    first = found.withColumn("place", place).filter(F.col("place") <= most)
    linked = first.select("page_id", "rank", "selector", "place", _address(F.col("attrs")["href"], F.col("url")).alias("url"), "text").filter("url IS NOT NULL")
    return _reports(linked, p, scored=True)


def _indicators() -> list[list[str]]:
    return [[w, w.replace(" ", "")] for w in P.PAGE_INDICATORS]


def page_scan(pages: DataFrame, p: EngineParams) -> DataFrame:
    """Reports among everything on a page that can be clicked, an address once: page_id, url, text, pass, matched, place, class, score.

    Pass 1: elements whose text has one of the indicators that the page's body has (or has it without blanks), or whose address has it
    with dashes; `matched` is the first of these in list order. Pass 2: elements whose own text has a date of this year, and whose
    address, or that of the element around them, is a report: the first five elements of each spelling; `matched` is the
    spelling. Elements are taken in the order of selectors, spellings and places in the page.
    """
    dates = re.compile("|".join(P.PAGE_DATES))

    def dated(own: str | None) -> bool:
        return dates.search((own or "").lower()) is not None

    def told(tag: str, attributes: dict[str, str], own: str | None) -> bool:
        return may_be_clicked(tag, attributes) or dated(own)

    # one parse, written as what it leaves of the pages, which is read for each pass
    tree = written(page_tree(pages, keep=told, texts=told, own=True, page=True))
    # pass 1
    texts = tree.filter(F.col("tag") == PAGE).select("page_id", words_in(F.col("text"), [[w] for w in P.PAGE_INDICATORS]).alias("on_page"))
    tree = tree.filter(F.col("tag") != PAGE)
    click = F.coalesce(nullif_empty(F.col("attrs")["href"]), F.col("attrs")["onclick"], F.lit(""))
    elements = tree.withColumn("address", click).filter("address != ''")
    elements = elements.filter(F.col("address").startswith("/") | F.col("address").startswith("http"))
    dashed = [[w.replace(" ", "-")] for w in P.PAGE_INDICATORS]
    met = elements.withColumn("met", F.array_union(words_in(F.col("text"), _indicators()), words_in(F.col("address"), dashed))).filter(F.size("met") > 0)
    gated = met.join(texts.filter(F.size("on_page") > 0), "page_id").withColumn("which", F.array_min(F.array_intersect("met", "on_page"))).filter("which IS NOT NULL")
    names = F.array(*[F.lit(w) for w in P.PAGE_INDICATORS])
    clicked = fitting(gated, CLICKABLE).select(
        "page_id", _address(F.col("address"), F.col("url")).alias("url"), "text", F.lit(1).alias("pass"), F.element_at(names, F.col("which") + 1).alias("matched"),
        F.struct("rank", F.lit(0).alias("first"), "pre").alias("place"), F.lit(0.95).alias("score"),
    )
    # pass 2
    near = near_addresses(tree).filter("address IS NOT NULL")
    own = F.lower("own")
    spelled = F.flatten(F.array(*[F.transform(F.array_distinct(F.regexp_extract_all(own, F.lit(d), F.lit(0))), lambda x, i=i: F.struct(F.lit(i).alias("rank"), x.alias("matched"))) for i, d in enumerate(P.PAGE_DATES)]))
    hits = tree.filter("own IS NOT NULL").select("page_id", "pre", F.inline(spelled))
    by_spelling = Window.partitionBy("page_id", "rank", "matched")
    hits = hits.withColumn("nth", F.row_number().over(by_spelling.orderBy("pre"))).filter("nth <= 5").withColumn("first", F.min("pre").over(by_spelling))
    near = near.select("page_id", "pre", "text", _address(F.col("address"), F.col("url")).alias("url")).filter("url IS NOT NULL")
    beside = hits.join(near, ["page_id", "pre"]).select(
        "page_id", "url", "text", F.lit(2).alias("pass"), "matched", F.struct("rank", "first", "pre").alias("place"), F.lit(0.9).alias("score")
    )
    by_address = rules.valid_report_link(F.col("url"), F.lit(""), p.year)
    both = _reports(clicked, p).unionByName(_reports(beside, p, by_address))
    return keep_first(both, ["page_id", "url"], "pass", "place.rank", "place.first", "place.pre", "matched")


def date_hits(pages: DataFrame, levels: int = 1) -> DataFrame:
    """Elements whose own text has a date of this year, with the closest address at most `levels` elements further out: page_id, pre,
    tag, own, address, above (how far out it is; both null where there is none)."""
    dates = re.compile("|".join(P.PAGE_DATES))
    tree = page_tree(
        pages, own=True, keep=lambda tag, attributes, own: bool(attributes.keys() & {"href", "onclick"}) or dates.search((own or "").lower()) is not None
    )
    found = near_addresses(tree, levels).filter(reduce(or_, [F.lower("own").rlike(d) for d in P.PAGE_DATES]))
    return found.select("page_id", "pre", "tag", "own", "address", "above")


def _search_words() -> tuple[list[str], dict[str, list[int]]]:
    """The keywords of all companies, and by ticker the numbers of those that are a company's own."""
    words, own = list(P.HIGH_KEYWORDS), {}
    for ticker, names in P.TICKER_KEYWORDS.items():
        own[ticker] = list(range(len(words), len(words) + 2 * len(names)))
        words += [f"{w} earnings" for w in names] + [f"{w} quarterly" for w in names]
    return words, own


def first_links(links: DataFrame, key: str = "company_id", order: str = "link_id", most: int = 200) -> DataFrame:
    """The first links of each company, which is all that some searches look at."""
    return links.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_place") <= most).drop("_place")


def keyword_search(links: DataFrame, p: EngineParams, key: str = "company_id", order: str = "link_id", looked: tuple[int, int] = (50, 30)) -> DataFrame:
    """Reports by keyword, an address once: key, order, url, text, tier, keyword, class, score. links: key, order, ticker, text, url.

    Each keyword, those of all and then the company's own, is looked for in the first 50 links' texts and (with dashes) addresses;
    a find scores 0.8, 0.1 more for this year and for a PDF, and one above 0.9 ends its keyword: a running maximum over the keyword's
    finds tells which come after one. Companies with fewer than two finds (an address may count twice) look for three broader
    keywords in the texts of the first 30 links; these score 0.4. A text is gone over once for all keywords.
    """
    words, own = _search_words()
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = links.select(key, order, "ticker", "text", "url").withColumn("place", place).filter(F.col("place") <= max(looked))
    named = first.filter((F.coalesce("text", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    mine = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in own.items() for x in pair])
    allowed = F.concat(F.array(*map(F.lit, range(len(P.HIGH_KEYWORDS)))), F.coalesce(mine[F.col("ticker")], F.array().cast("array<int>")))
    dashed = words_in(F.col("url"), [[w.replace(" ", "-")] for w in words])
    found = named.filter(F.col("place") <= looked[0]).withColumn("_met", F.array_union(words_in(F.col("text"), [[w] for w in words]), dashed))
    found = found.select(key, order, "place", "text", "url", F.explode(F.array_intersect("_met", allowed)).alias("word"))
    t, u = F.lower("text"), F.lower("url")
    year = F.lit(str(p.year))
    score = F.lit(0.8) + F.when(t.contains(year) | u.contains(year), 0.1).otherwise(0.0) + F.when(u.contains("pdf"), 0.1).otherwise(0.0)
    high = _reports(found, p).withColumn("score", score)
    earlier = Window.partitionBy(key, "word").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    high = high.withColumn("_over", F.coalesce(F.max(F.col("score") > 0.9).over(earlier), F.lit(False))).filter("NOT _over").drop("_over")
    enough = high.groupBy(key).agg(F.count("*").alias("n")).filter("n >= 2")
    broad = P.MEDIUM_KEYWORDS[:3]
    few = named.filter(F.col("place") <= looked[1]).join(enough.select(key), key, "left_anti")
    few = few.select(key, order, "place", "text", "url", F.explode(words_in(F.col("text"), [[w] for w in broad])).alias("word"))
    medium = _reports(few, p).withColumn("score", F.lit(0.4))
    tier = lambda df, k, names: df.withColumn("tier", F.lit(k)).withColumn("keyword", F.element_at(F.array(*map(F.lit, names)), F.col("word") + 1))
    return keep_first(tier(high, 1, words).unionByName(tier(medium, 2, broad)), [key, "url"], "tier", "word", "place").drop("word")


def learned_reports(links: DataFrame, p: EngineParams, key: str = "company_id", order: str = "link_id", looked: int = 200, most: int = 20) -> DataFrame:
    """Reports among the first `most` PDF addresses of a company's first `looked` links: key, order, url, text (from the address),
    class, score."""
    first = links.select(key, order, "url").withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_at") <= looked)
    files = first.filter(F.lower("url").contains(".pdf")).withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).filter(F.col("_nth") <= most)
    named = files.filter(rules.financial_report_url(F.col("url"))).select(key, order, "url", text_of_url(F.col("url")).alias("text"))
    return _reports(named, p, F.lit(True), scored=True)


def fixed_pages(companies: DataFrame) -> DataFrame:
    """The pages that are looked at as a last resort, by ticker: company_id, page_ord, page."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in P.FIXED_PAGES.items() for x in pair])
    return companies.select("company_id", F.posexplode(table[F.col("ticker")]).alias("page_ord", "page"))


def first_page_with_reports(tried: DataFrame, links: DataFrame, most: int = 200) -> DataFrame:
    """Of each company's pages (company_id, page_ord, page) the first on which one of the first `most` links is a recent file, with all
    that are: company_id, page_ord, ord, url, text. links: page, ord, text, url. A company's rows are its few pages'
    first links, so a window over it holds no more than these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    files = links.filter((F.col("ord") < most) & (F.coalesce("url", F.lit("")) != "")).withColumn("text", text)
    recent = contains_any(F.lower("url"), P.FALLBACK_TERMS) & contains_any(F.concat("text", "url"), ["2024", "2025"])
    hits = tried.join(files.filter(recent).select("page", "ord", "url", "text"), "page")
    first = F.min("page_ord").over(Window.partitionBy("company_id"))
    return hits.withColumn("_first", first).filter(F.col("page_ord") == F.col("_first")).drop("_first", "page")
