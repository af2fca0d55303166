"""Finding a company's investor page: candidates by stage and place, of which the first that holds is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules, scoring, urls
from ..functions.text import contains_any

#: Stages in the order in which they are tried.
KNOWN, DEDICATED, LEARNED, TEXT, WORD, ADDRESS, MENU, FOOTER, PATH, SUBDOMAIN = range(1, 11)
#: Of the links that a word finds, so many are looked at.
_LOOKED = {TEXT: 1, WORD: 1, ADDRESS: 5}
#: Links of a page that are learned from, and how many of the surest are tried.
LEARNED_FROM, TRIED = 100, 3


def known_pages(companies: DataFrame) -> DataFrame:
    """Pages that are known beforehand, by ticker: a literal map, no join."""
    table = F.create_map(*[F.lit(x) for pair in P.IR_KNOWN.items() for x in pair])
    return companies.select("company_id", F.lit(KNOWN).alias("stage"), F.lit(0).alias("place"), table[F.col("ticker")].alias("found")).filter("found is not null")


def dedicated_pages(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """Usual addresses of investor pages that exist among the crawled pages (url, title, body) and read like one."""
    tried = companies.select("company_id", F.posexplode(urls.ir_candidates(F.col("url"))).alias("place", "found"))
    good = pages.filter(rules.valid_ir_page(F.col("title"), F.col("url"), F.col("body"))).select(F.col("url").alias("found"))
    return tried.join(good.distinct(), "found", "left_semi").select("company_id", F.lit(DEDICATED).alias("stage"), "place", "found")


def link_matches(text: Column, href: Column, area: Column) -> Column:
    """Array of (stage, word): where in the search a link with this text and address is met, and by which word."""
    t, u = F.lower(text), F.lower(href)
    rank = lambda stage, i, on: F.when(on, F.struct(F.lit(stage).alias("stage"), F.lit(i).alias("word")))
    spelled = [(3 * i + k, s) for i, w in enumerate(P.IR_LINK_WORDS) for k, s in enumerate((w.title(), w.upper(), w))]
    about = contains_any(t, P.IR_LINK_WORDS)
    return F.array_compact(
        F.array(
            rank(LEARNED, 0, (about | contains_any(u, P.IR_LINK_WORDS)) & ~href.contains("javascript:")),
            *[rank(TEXT, i, text.contains(s)) for i, s in spelled],
            *[rank(WORD, i, t.contains(w)) for i, w in enumerate(P.IR_LINK_WORDS)],
            *[rank(ADDRESS, i, href.contains(w)) for i, w in enumerate(P.IR_HREF_WORDS)],
            rank(MENU, 0, about & (area == "nav")),
            rank(FOOTER, 0, about & (area == "footer")),
        )
    )


def linked_pages(links: DataFrame) -> DataFrame:
    """Candidates among a company's links (company_id, ord, text, href, area): by what was learned of its page, by link texts, by
    words in texts and addresses, and in menus and footers. A word looks at its first few links only, whether they hold or not."""
    text, href = F.coalesce(F.col("text"), F.lit("")), F.col("href")
    met = links.filter(href.isNotNull()).select(
        "company_id", "ord", "href", rules.valid_ir_url(href).alias("valid"), scoring.ir_confidence(text, href).alias("confidence"),
        F.inline(link_matches(text, href, F.coalesce(F.col("area"), F.lit("")))),
    )
    met = met.filter((F.col("stage") != LEARNED) | (F.col("ord") < LEARNED_FROM))
    # by place in the page; what was learned, by how sure it is
    order = [F.desc(F.when(F.col("stage") == LEARNED, F.col("confidence")).otherwise(0.0)), "ord"]
    w = Window.partitionBy("company_id", "stage", "word").orderBy(*order)
    most = F.create_map(*[F.lit(x) for pair in {**_LOOKED, LEARNED: TRIED}.items() for x in pair])[F.col("stage")]
    few = met.filter(F.col("stage").isin(LEARNED, *_LOOKED)).withColumn("at", F.row_number().over(w))
    # a constant bound lets ranks be cut before rows move
    few = few.filter(F.col("at") <= max(*_LOOKED.values(), TRIED)).filter((F.col("at") <= most) & F.col("valid"))
    few = few.select("company_id", "stage", (F.col("word") * 10 + F.col("at")).alias("place"), F.col("href").alias("found"))
    areas = met.filter(F.col("stage").isin(MENU, FOOTER) & F.col("valid"))
    return few.unionByName(areas.select("company_id", "stage", F.col("ord").cast("int").alias("place"), F.col("href").alias("found")))


def usual_pages(companies: DataFrame) -> DataFrame:
    """The origin with each usual path, then the registrable domain with each usual subdomain. Nothing is asked of them, so the
    first path ends every search."""
    u = F.col("url")
    by_path = F.array(*[F.concat(urls.origin(u), F.lit(x)) for x in P.IR_PATHS])
    by_name = F.array(*[F.concat(F.lit(f"https://{x}."), urls.registrable_domain(u)) for x in P.IR_SUBDOMAINS])
    made = [companies.select("company_id", F.lit(s).alias("stage"), F.posexplode(a).alias("place", "found")) for s, a in ((PATH, by_path), (SUBDOMAIN, by_name))]
    return made[0].unionByName(made[1])


def discover(companies: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """The investor page of each company (company_id, ticker, url): company_id, stage, found. All stages' candidates are gathered
    and the first by stage and place is kept, by a partial aggregation."""
    every = known_pages(companies)
    for more in (dedicated_pages(companies, pages), linked_pages(links), usual_pages(companies)):
        every = every.unionByName(more)
    first = F.min(F.struct("stage", "place", "found")).alias("first")
    return every.groupBy("company_id").agg(first).select("company_id", "first.stage", "first.found")
