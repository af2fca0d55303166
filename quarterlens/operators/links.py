"""Links, clickable elements and patterns of web pages."""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import or_

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules
from ..functions.text import contains_any, nullif_empty
from ..functions.urls import origin, report_paths
from .pagetree import fitting, page_tree, parsed, select, step
from .textscan import first_hits

#: Elements that can be clicked, in the order in which they are looked for; an element that fits several comes several times.
CLICKABLE = {
    "a": [step("a")], "button": [step("button")], "div[onclick]": [step("div", has="onclick")], "span[onclick]": [step("span", has="onclick")],
    "[role=button]": [step(equal=("role", "button"))], "[class*=button]": [step(part=("class", "button"))],
    "[class*=link]": [step(part=("class", "link"))], "[href]": [step(has="href")], "[onclick]": [step(has="onclick")],
    "[class*=download]": [step(part=("class", "download"))],
}
#: Where menus are, whatever is around them.
MENUS = [step("nav"), step("header"), step(cls="navigation"), step(cls="menu"), step(cls="nav-menu")]


def may_be_clicked(tag: str, attributes: dict[str, str], *_) -> bool:
    """Whether one of CLICKABLE may fit an element: what the page tree needs to return for them."""
    of_class = attributes.get("class", "")
    return tag in ("a", "button") or not attributes.keys().isdisjoint(("onclick", "href", "role")) or any(w in of_class for w in ("button", "link", "download"))


def page_links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Anchors in document order: page_id, url, ord (from 0), href (null where an anchor has none), text. most: at most so many of
    each page."""
    rows = page_tree(pages, keep=["a"], texts=True)
    rows = rows if most is None else rows.filter(F.col("nth") < most)
    return rows.select("page_id", "url", F.col("nth").alias("ord"), nullif_empty(F.col("attrs")["href"]).alias("href"), "text")


def clickable(pages: DataFrame) -> DataFrame:
    """All clickable elements by every selector, duplicates kept: page_id, url, rank and selector, pre (the place in the page), tag,
    address (href, or else what a click does), text."""
    found = fitting(page_tree(pages, keep=may_be_clicked, texts=True), CLICKABLE)
    address = F.coalesce(nullif_empty(F.col("attrs")["href"]), F.col("attrs")["onclick"], F.lit(""))
    return found.select("page_id", "url", "rank", "selector", "pre", "tag", address.alias("address"), "text")


def absolutised(links: DataFrame) -> DataFrame:
    """Links with full addresses: those that begin with / get the page's origin, other relative ones go."""
    full = F.when(F.col("href").startswith("/"), F.concat(origin(F.col("url")), F.col("href"))).when(
        F.col("href").startswith("http"), F.col("href")
    )
    return links.withColumn("full", full).filter(F.col("full").isNotNull())


def date_strings(body: Column, most: int = 10) -> Column:
    """Date spellings in a text, the first `most` of each kind."""
    each = [F.slice(F.regexp_extract_all(body, F.lit(f"(?i){p}"), F.lit(0)), 1, most) for p in P.DATE_PATTERNS]
    return F.flatten(F.array(*each))


def latest_dates(dates: Column, most: int = 5) -> Column:
    """The greatest distinct spellings, by their text."""
    return F.slice(F.sort_array(F.array_distinct(dates), asc=False), 1, most)


def page_patterns(links: DataFrame, key: str, url: str, text: str, order: str, most: int = 200) -> DataFrame:
    """What the first `most` links of each page have in common: lists of file links, report paths, telling texts and file names,
    in the order of the links. Links beyond that number never leave their task."""
    u, t = F.lower(F.col(url)), F.lower(F.col(text))
    name = F.element_at(F.split(F.col(url), "/"), -1)
    pdf, excel = u.contains(".pdf"), contains_any(u, [".xlsx", ".xls"])
    facts = {
        "pdf_urls": F.when(pdf, F.col(url)),
        "excel_urls": F.when(~pdf & excel, F.col(url)),
        "earnings_texts": F.when(contains_any(t, ["earning", "financial", "result"]), F.col(text)),
        "date_texts": F.when(contains_any(t, ["q1", "q2", "q3", "q4", "2023", "2024", "2025"]), F.col(text)),
        "report_texts": F.when(contains_any(t, ["report", "filing", "presentation"]), F.col(text)),
        "naming_conventions": F.when((pdf | excel) & contains_any(F.lower(name), P.NAME_TERMS), name),
    }
    w = Window.partitionBy(key).orderBy(order)
    first = links.select(key, order, url, text).withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= most)
    rows = first.select(key, order, report_paths(F.col(url)).alias("report_paths"), *[c.alias(n) for n, c in facts.items()])
    listed = lambda n: F.array_compact(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(n).alias("v")))), lambda s: s["v"])
    )
    return rows.groupBy(key).agg(F.flatten(listed("report_paths")).alias("report_paths"), *[listed(n).alias(n) for n in facts])


def path_frequency(links: DataFrame, url: str) -> DataFrame:
    return links.select(F.explode(report_paths(F.col(url))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def context_urls(pages: DataFrame, words: list[str], body: str = "html", around: int = 200, most: int = 5, year: int = 2025) -> DataFrame:
    """Addresses within `around` characters of the first `most` hits of each word (in any case; Q[1-4] is any quarter), and whether each is a
    valid report link. Whole texts; each is gone over once for all words."""
    found = first_hits(pages, "page_id", body, [P.SPELLINGS.get(w, [w]) for w in words], most, around)
    names = F.array(*[F.lit(w) for w in words])
    return found.select(
        "page_id", "rank", F.element_at(names, F.col("rank") + 1).alias("word"), "hit", "place", "ord", F.col("found").alias("found_url")
    ).withColumn("valid", rules.valid_report_link(F.col("found_url"), F.lit(""), year))


def fallback_reports(pages: DataFrame, body: str = "html", year: int = 2025) -> DataFrame:
    """The last resort of a search: valid addresses near a year, a quarter or a word of reports, with the lowest score."""
    found = context_urls(pages, [str(year), str(year - 1), *P.SPELLINGS, *P.FALLBACK_WORDS], body, year=year).filter("valid")
    return found.select(
        "page_id", "rank", "place", "ord", F.col("found_url").alias("url"), F.col("hit").alias("text"), F.lit(5.0).alias("priority"),
        F.lit(f"{year}_fallback").alias("year"), F.lit("fallback").alias("type"), F.lit("fallback_search").alias("strategy"),
        F.lit(0.3).alias("score"),
    )


def pdf_candidates(pages: DataFrame) -> DataFrame:
    """Links to PDF files: those of all anchors; then those in and beside buttons, blocks and spans whose class or text speaks
    of downloads, under that element's text (its texts without white space at their ends), as often as they come. page_id, ord, pass,
    url, text. What stands in and beside an element are the anchors of its interval and of its parent's, found by bisection."""
    words = P.BUTTON_WORDS

    def full(page: str, href: str) -> str:
        return "/".join(page.split("/")[:3]) + href if href.startswith("/") else href

    def candidates(page: str, html: str) -> Iterator[tuple]:
        found, texts = parsed(html)
        starts = list(accumulate(map(len, texts), initial=0))
        anchors = [k for k, e in enumerate(found) if e[0] == "a" and "href" in e[1]]
        files = [k for k in anchors if ".pdf" in found[k][1]["href"].lower()]

        def said(e: list) -> str:
            return "".join(x.strip() for x in texts[bisect_left(starts, e[5]) : bisect_left(starts, e[6])])

        def within(k: int) -> list[int]:
            return files[bisect_right(files, k) : bisect_right(files, found[k][4])] if k >= 0 else files

        for k in files:
            if found[k][1]["href"].startswith(("/", "http")):
                yield 1, full(page, found[k][1]["href"]), said(found[k])
        for k, e in enumerate(found):
            if e[0] in ("button", "div", "span") and "class" in e[1]:
                near = [*within(k), *within(e[2])]
                text = said(e) if near else ""
                if near and any(w in " ".join(e[1]["class"].split()).lower() or w in text.lower() for w in words):
                    for a in near:
                        yield 2, full(page, found[a][1]["href"]), text or said(found[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            each = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            rows = [(i, n, *x) for i, url, html in each for n, x in enumerate(candidates(url or "", html or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "ord", "pass", "url", "text"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, ord int, pass int, url string, text string")


def area_links(pages: DataFrame) -> DataFrame:
    """Anchors with the part of the page they stand in, as `area`: nav (menus and headers, by tag or class), footer (the page's first),
    or null; in document order. An anchor comes once without an area and once for each area that it is in."""

    def needed(tag: str, attributes: dict[str, str], *_) -> bool:
        return tag in ("a", "nav", "header", "footer") or "menu" in attributes.get("class", "") or "navigation" in attributes.get("class", "")

    anchor = step("a")
    tree = page_tree(pages, keep=needed, texts=["a"])
    within = {f"_nav{i}": [menu, anchor] for i, menu in enumerate(MENUS)} | {"_footer": [step("footer", nth=0), anchor]}
    flagged = select(tree, within).filter(anchor())
    areas = F.array(
        F.struct(F.lit(True).alias("on"), F.lit(None).cast("string").alias("area")),
        F.struct(reduce(or_, [F.col(f"_nav{i}") for i in range(len(MENUS))]).alias("on"), F.lit("nav").alias("area")),
        F.struct(F.col("_footer").alias("on"), F.lit("footer").alias("area")),
    )
    return flagged.select(
        "page_id", "url", F.col("nth").alias("ord"), nullif_empty(F.col("attrs")["href"]).alias("href"), "text", F.inline(F.filter(areas, lambda a: a["on"]))
    ).drop("on")


# Functions of this module go to the workers by value, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
