"""The registered queries: each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import periods, rules, scoring, urls
from ..functions.text import combined, nullif_empty, py_strip
from ..operators import documents, links, manifest, qc, ranking, state, summaries
from ..params import EngineParams
from ..sources import files
from ..sources.files import work_folder
from ..streaming import state_stream
from .lists import TAIL

DEFAULTS = EngineParams()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes as fewer partitions than there are cores, dealt out evenly; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def report_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links with text and address, made from orders and customers."""
    o, c = spread(table(spark, sf, "orders")), table(spark, sf, "customer").select("c_custkey")
    y = (F.year("o_orderdate") + 24).cast("string")
    q = F.quarter("o_orderdate").cast("string")
    key = F.col("o_orderkey")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Earnings Release").when(F.col("o_orderpriority") == "2-HIGH", "Form 10-Q")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Quarterly Revenue Trend")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Annual Report").otherwise("Governance Charter")
    )
    host = F.when(F.col("o_orderstatus") == "F", "s2.q4cdn.com").when(F.col("o_orderstatus") == "O", "investors.example.com").otherwise("www.example.com")
    ext = F.when(key % 4 == 0, ".pdf").when(key % 4 == 1, ".xlsx").when(key % 4 == 2, ".PDF").otherwise(".html")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        key.alias("link_id"),
        (F.col("c_custkey") % 30).alias("company_id"),
        F.concat(kind, F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" Q"), q, F.lit(" "), y))).alias("text"),
        F.concat(F.lit("https://"), host, F.lit("/"), y, F.lit("/q"), q, F.lit("/doc-"), key.cast("string"), ext).alias("url"),
    )


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column, Column]:
    df = report_links(spark, sf)
    return df, F.col("text"), F.col("url"), combined(F.col("text"), F.col("url"))


def with_ticker(df: DataFrame) -> DataFrame:
    """The company's ticker by its number in the list: a literal array, no join."""
    names = F.array(*[F.lit(c[0]) for c in P.COMPANIES])
    return df.withColumn("ticker", F.element_at(names, (F.col("company_id") + 1).cast("int")))


# -- scans --


@query
def company_scan(spark, sf):
    """The companies with how many customers' links each has; the list is broadcast, of thirty rows."""
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(P.COMPANIES)], "ord int, ticker string, name string, website string")
    found = table(spark, sf, "customer").groupBy((F.col("c_custkey") % 30).cast("int").alias("ord")).agg(F.count("*").alias("n_customers"))
    return found.join(F.broadcast(rows), "ord").select("ord", "ticker", "name", "website", "n_customers")


@query
def company_subset(spark, sf):
    return company_scan(spark, sf).filter(F.col("ticker").isin("AAPL", "MSFT", "V")).select("ticker", "website", "n_customers")


def tree_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pages, each with more elements at its end."""
    parts = TAIL.split("{i}")
    tail = F.concat(*[c for part in parts for c in (F.col("page_id").cast("string"), F.lit(part))][1:])
    return spread(table(spark, sf, "pages")).withColumn("html", F.concat("html", tail))


@query
def page_links(spark, sf):
    return links.page_links(tree_pages(spark, sf), 200).select("page_id", "ord", "href", "text")


@query
def pdf_links(spark, sf):
    found = links.page_links(tree_pages(spark, sf))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(F.lower("href").contains(".pdf")).alias("n_pdf"))


@query
def absolutised_links(spark, sf):
    return links.absolutised(links.page_links(tree_pages(spark, sf))).select("page_id", "ord", "full")


@query
def clickable_elements(spark, sf):
    return links.clickable(tree_pages(spark, sf)).drop("url")


# -- predicates --


@query
def valid_links(spark, sf):
    df, text, url, _ = _links(spark, sf)
    return df.filter(rules.valid_report_link(url, text, DEFAULTS.year)).select("link_id")


@query
def financial_report_links(spark, sf):
    df, _, url, _ = _links(spark, sf)
    made = F.when(F.col("link_id") % 3 > 0, F.replace(url, F.lit("/doc-"), F.lit("/report-"))).otherwise(url)
    return df.filter(rules.financial_report_url(made)).select("link_id")


@query
def chart_links(spark, sf):
    df, _, _, c = _links(spark, sf)
    return df.filter(rules.chart_or_summary(c)).select("link_id")


@query
def ir_url_valid(spark, sf):
    return table(spark, sf, "pages").select("page_id", rules.valid_ir_url(F.concat("url", F.lit("/investors/"), "page_id")).alias("valid"))


@query
def ir_page_valid(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", rules.valid_ir_page(title, F.col("url"), F.col("html")).alias("valid"))


@query
def calendar_reject(spark, sf):
    df, _, url, _ = _links(spark, sf)
    made = F.when(F.col("link_id") % 3 == 0, F.concat(url, F.lit("?add-to-calendar"))).otherwise(url)
    return df.filter(rules.calendar_rejected(made)).select("link_id")


@query
def direct_download(spark, sf):
    df, _, url, _ = _links(spark, sf)
    return df.filter(rules.direct_download(url)).select("link_id")


@query
def third_party_links(spark, sf):
    df, _, url, _ = _links(spark, sf)
    made = F.when(F.col("link_id") % 7 == 0, F.replace(url, F.lit("www.example.com"), F.lit("www.sec.gov"))).otherwise(url)
    return df.filter(rules.third_party(made)).select("link_id")


@query
def early_stop_hits(spark, sf):
    df, _, url, c = _links(spark, sf)
    return df.filter(rules.skips_event(F.lower(url), scoring.quarter_priority(c))).select("link_id")


@query
def fallback_links(spark, sf):
    df, text, url, _ = _links(spark, sf)
    return df.filter(rules.recent_fallback(text, url)).select("link_id")


@query
def sec_links(spark, sf):
    """The first current link of each company's filings section."""
    df, text, url, _ = _links(spark, sf)
    hits = df.filter(rules.sec_section(url, text, DEFAULTS.year))
    return hits.groupBy("company_id").agg(F.min("link_id").alias("link_id"))


@query
def file_validity(spark, sf):
    """Each document as a file: every second a .pdf, every third an .xlsx, else a .docx."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    name = F.concat(i.cast("string"), F.when(i % 2 == 0, ".pdf").when(i % 3 == 0, ".xlsx").otherwise(".docx"))
    body = F.when(i % 4 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text"))
    problem = rules.file_problem(name, F.octet_length(body), F.substring(body, 1, 2048))
    return d.select("doc_id", F.coalesce(problem, F.lit("ok")).alias("problem"))


# -- classification and scores --


@query
def classify_links(spark, sf):
    df, text, url, _ = _links(spark, sf)
    return df.select("link_id", scoring.classification(text, url, DEFAULTS.base_year).alias("c")).select(
        "link_id", F.round("c.priority", 6).alias("priority"), F.col("c.year").alias("label"), F.col("c.type").alias("type"),
        F.col("c.extracted_year").alias("year"), F.col("c.extracted_quarter").alias("quarter"), "c.is_latest_expected",
    )


@query
def classify_links_legacy(spark, sf):
    df, text, url, _ = _links(spark, sf)
    return df.select("link_id", scoring.legacy_classification(text, url).alias("c")).select(
        "link_id", F.round("c.priority", 6).alias("priority"), F.col("c.year").alias("label"), F.col("c.type").alias("type")
    )


@query
def date_info(spark, sf):
    df, _, _, c = _links(spark, sf)
    return df.select("link_id", scoring.date_info(c).alias("d")).select("link_id", "d.*")


def _score(name: str, make: Callable[[Column, Column, Column], Column]) -> None:
    def f(spark, sf):
        df, text, url, c = _links(spark, sf)
        return df.select("link_id", F.round(make(text, url, c), 6).alias("score"))

    f.__name__ = name
    query(f)


_score("quarter_priority", lambda text, url, c: scoring.quarter_priority(c))
_score("content_bonus", lambda text, url, c: scoring.content_bonus(c))
_score("availability_adjust", lambda text, url, c: scoring.availability(c, F.lit(1.0)))
_score("comprehensive_score", lambda text, url, c: scoring.comprehensive_score(text, url))
_score("keyword_score", lambda text, url, c: scoring.keyword_score(text, url))


@query
def final_score(spark, sf):
    df, text, url, _ = _links(spark, sf)
    names = F.array(*[F.lit(s) for s, _ in P.STRATEGY_BONUS], F.lit("whole_page_scan"))
    strategy = F.element_at(names, (F.col("link_id") % 5 + 1).cast("int"))
    out = ranking.scored(df, DEFAULTS, strategy)
    return out.select("link_id", "strategy", F.round("final_score", 6).alias("score"))


@query
def ir_confidence(spark, sf):
    df, text, url, _ = _links(spark, sf)
    return df.select("link_id", F.round(scoring.ir_confidence(text, url), 6).alias("score"))


@query
def pdf_link_score(spark, sf):
    df, text, url, _ = _links(spark, sf)
    df = with_ticker(df)
    return df.select(
        "link_id", scoring.pdf_link_score(url, text, F.col("ticker")).cast("long").alias("score"),
        scoring.pdf_choice_score(url, text, F.col("ticker")).cast("long").alias("choice_score"),
    )


# -- ranking --


@query
def best_report_per_company(spark, sf):
    return ranking.best_report(report_links(spark, sf), DEFAULTS).select(
        "company_id", "link_id", "url", F.col("class.year").alias("label"), F.col("class.type").alias("type"),
        F.round("score", 6).alias("score"), F.round("final_score", 6).alias("final_score"),
    )


@query
def best_pdf_per_company(spark, sf):
    return ranking.best_pdf(with_ticker(report_links(spark, sf))).select("company_id", "link_id", "own", F.col("score").cast("long").alias("score"))


@query
def top_links_per_company(spark, sf):
    """The three surest investor links of each company, then the first whose address passes."""
    df, text, url, _ = _links(spark, sf)
    df = df.withColumn("url", F.replace(url, F.lit("/doc-"), F.lit("/investors/")))
    top = ranking.top_k(df.withColumn("confidence", scoring.ir_confidence(text, url)), ["company_id"], 3, F.desc("confidence"), "link_id")
    good = top.filter(rules.valid_ir_url(F.col("url")))
    return good.groupBy("company_id").agg(F.min_by("link_id", "place").alias("link_id"), F.count("*").alias("n"))


@query
def strategy_cascade(spark, sf):
    out = ranking.cascade(with_ticker(report_links(spark, sf)), DEFAULTS)
    return out.groupBy("company_id", "strategy").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query
def dedup_url_keep_first(spark, sf):
    df = report_links(spark, sf).withColumn("place", F.regexp_replace("url", "/doc-[0-9]+", "/doc"))
    return ranking.keep_first(df, ["company_id", "place"], "link_id").select("company_id", "place", "link_id")


# -- addresses and page patterns --


@query
def url_structure(spark, sf):
    s = table(spark, sf, "pages").select("page_id", urls.url_structure(F.col("url")).alias("s"))
    return s.select(
        "page_id", F.array_join("s.domain_structure", ".").alias("domain"), "s.has_www", "s.tld", "s.domain_depth",
        F.array_join("s.path_structure", "/").alias("path"),
    )


@query
def base_domain(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.base_domain(u).alias("domain"), urls.company_of_domain(u).alias("company"), urls.origin(u).alias("origin"),
        urls.registrable_domain(u).alias("registrable"),
    )


@query
def ir_url_candidates(spark, sf):
    u = F.col("url")
    made = F.concat(urls.ir_candidates(u), urls.ir_paths(u))
    return table(spark, sf, "pages").select("page_id", F.posexplode(made).alias("ord", "candidate"))


@query
def text_of_url(spark, sf):
    df, _, url, _ = _links(spark, sf)
    return df.select("link_id", urls.text_of_url(url).alias("text"))


@query
def page_patterns(spark, sf):
    made = report_links(spark, sf).withColumn("url", F.replace("url", F.lit("/doc-"), F.lit("/annual-report-")))
    out = links.page_patterns(made, "company_id", "url", "text", "link_id")
    return out.select("company_id", *[F.array_join(c, "|").alias(c) for c in out.columns if c != "company_id"])


@query
def path_frequency(spark, sf):
    df = report_links(spark, sf).withColumn("url", F.concat(F.regexp_replace("url", "/doc-[0-9]+", "/annual-report"), F.lit("/x")))
    return links.path_frequency(df, "url")


@query
def year_paths(spark, sf):
    df, _, url, _ = _links(spark, sf)
    return df.select("link_id", urls.year_path(url).alias("path"))


@query
def date_strings(spark, sf):
    df, text, url, _ = _links(spark, sf)
    body = F.concat(text, F.lit(" on 3/4/2025, July 31, 2025 and "), F.lit("2024-05-06; fy 2025 "), F.col("link_id").cast("string"))
    found = links.date_strings(body)
    return df.select("link_id", F.array_join(found, "|").alias("dates"), F.array_join(links.latest_dates(found), "|").alias("latest"))


# -- periods and names --


def _titles(spark, sf) -> DataFrame:
    o = spread(table(spark, sf, "orders"))
    y, q, k = F.year("o_orderdate") + 24, F.quarter("o_orderdate").cast("string"), F.col("o_orderkey") % 9
    ys, yy = y.cast("string"), F.substring(y.cast("string"), 3, 2)
    word = F.element_at(F.array(*[F.lit(w) for w in ("first", "second", "third", "Fourth")]), F.quarter("o_orderdate"))
    cat = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    title = (
        F.when(k == 0, cat("Results Q", q, " ", ys)).when(k == 1, cat(word, " quarter ", ys)).when(k == 2, cat(ys, " q", q))
        .when(k == 3, cat("Three months ended March 31, ", ys)).when(k == 4, cat("FY", ys, " Q", q)).when(k == 5, cat("FY", yy, " Q", q))
        .when(k == 6, cat(q, "q", yy)).when(k == 7, cat("  ", q, "Q", yy)).otherwise(cat("Report ", ys))
    )
    return o.select("o_orderkey", title.alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("published"))


@query
def period_from_title(spark, sf):
    return _titles(spark, sf).select("o_orderkey", periods.period_from_title(F.col("title")).alias("period"))


@query
def period_from_date(spark, sf):
    return _titles(spark, sf).select("o_orderkey", periods.period_from_date(F.col("published")).alias("period"))


@query
def infer_period(spark, sf):
    return _titles(spark, sf).select("o_orderkey", periods.infer_period(F.col("title"), F.col("published")).alias("period"))


@query
def normalize_period(spark, sf):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.lower(periods.infer_period(F.col("title"), F.col("published")))).when(k == 1, F.substring("published", 1, 10)).otherwise(F.col("title"))
    return _titles(spark, sf).select("o_orderkey", periods.normalize_period(raw).alias("period"))


@query
def expected_quarter(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", periods.expected_quarter(F.col("o_orderdate")).alias("e")).select("o_orderkey", "e.*")


def _named(spark, sf) -> DataFrame:
    df = with_ticker(report_links(spark, sf))
    c = scoring.classification(F.col("text"), F.col("url"))
    df = df.withColumn("label", F.coalesce(c["year"], F.lit("unknown")))
    return df.withColumn("filename", urls.report_filename(F.col("ticker"), F.col("label"), F.col("url")))


@query
def filename_generate(spark, sf):
    return _named(spark, sf).select("link_id", "filename")


@query
def filename_parse(spark, sf):
    n = F.col("filename")
    return _named(spark, sf).select("link_id", periods.ticker_from_filename(n).alias("ticker"), periods.period_from_filename(n).alias("period"))


@query
def ticker_from_stem(spark, sf):
    n = F.col("filename")
    return _named(spark, sf).select("link_id", F.split_part(n, F.lit("_"), F.lit(1)).alias("ticker"), F.coalesce(F.try_element_at(F.split(n, "_"), F.lit(2)), F.lit("UNKNOWN")).alias("part"))


@query
def object_paths(spark, sf):
    s = urls.object_paths(F.lit("store"), F.col("ticker"), periods.period_from_filename(F.col("filename")), F.lit("report"))
    return _named(spark, sf).select("link_id", s.alias("p")).select("link_id", "p.*")


# -- documents --


@query
def doc_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *documents.digests(F.col("text")))


@query
def doc_dedup_keep_first(spark, sf):
    return documents.dedup_by_hash(table(spark, sf, "documents").select("doc_id", "source", "text"), "text", ["source"], "doc_id")


@query
def dup_stats(spark, sf):
    return documents.duplicate_counts(table(spark, sf, "documents"), "text", "source")


def _doc_name() -> Column:
    i = F.col("doc_id")
    tail = F.when(i % 5 == 0, "_Slides.pdf").when(i % 5 == 1, "_supplement.pdf").otherwise("_report.pdf")
    return F.concat(F.upper("source"), F.lit("_"), i.cast("string"), tail)


@query
def report_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", documents.report_type(_doc_name(), F.col("text")).alias("report_type"))


@query
def title_from_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", documents.title_of(_doc_name()).alias("title"))


@query
def head_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(documents.head_lines(F.col("text")), "\n").alias("head"))


@query
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(documents.truncated(F.col("text"), 1000).cast("binary")).alias("md5"))


@query
def concat_first5(spark, sf):
    c = table(spark, sf, "conversations")
    return documents.first_parts(c, "conv_id", "turn", F.col("role"), F.col("text"))


@query
def markdown_to_csv(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows")
    )
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), r["n_nationkey"].cast("string"), F.lit(" |  "), r["n_name"], F.lit(" | |"))), "\n")
    return n.select("n_regionkey", documents.markdown_to_csv(F.concat(F.lit("| key | name |\n|--|--|\n\n"), body)).alias("csv"))


def _fenced() -> Column:
    i = F.col("event_id")
    cat = lambda a, b: F.concat(F.lit(a), F.col("props"), F.lit(b))
    return F.when(i % 4 == 0, cat("```json\n", "\n```")).when(i % 4 == 1, cat("Here: ", " done")).when(i % 4 == 2, F.lit("no record")).otherwise(F.col("props"))


@query
def json_clean(spark, sf):
    return table(spark, sf, "events").select("event_id", documents.clean_json(_fenced()).alias("json"))


@query
def json_parse_fallback(spark, sf):
    """Model output made from the events: a nested record, fenced; every fifth is cut off, every seventh has no confidence."""
    i, v = F.col("event_id"), F.col("value")
    conf = F.when(i % 7 == 0, "").otherwise(', "confidence": 0.5')
    text = F.concat(F.lit('```json\n{"ticker": "X", "revenue": {"value": '), v.cast("string"), F.lit(', "unit": "USD", "scale": "M"}'), conf, F.when(i % 5 == 0, "").otherwise("}"), F.lit("\n```"))
    r = documents.parsed_record(text, F.col("event_type"), F.lit("2025-Q1"), F.lit("2025-04-01"), F.lit("press"))
    return table(spark, sf, "events").select("event_id", r.alias("r")).select(
        "event_id", "r.ticker", "r.period", "r.extracted", "r.confidence", F.col("r.revenue.value").alias("revenue"), "r.guidance_summary"
    )


# -- manifest --


def _entries(spark, sf) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    conf = F.when(i % 3 == 0, F.lit(None)).otherwise(F.col("quality").cast("double") * 0.9)
    period = F.concat(F.lit("2025-Q"), (i % 4 + 1).cast("string"))
    e = d.select("doc_id", "source", "lang", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("sha256")).join(lab, "doc_id")
    return e.select(
        "doc_id", F.upper("source").alias("ticker"), period.alias("period"), F.concat(F.lit("2025-0"), (i % 9 + 1).cast("string"), F.lit("-15")).alias("published"),
        F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("lang")).alias("report_type"), "sha256", conf.alias("confidence"),
    )


@query
def manifest_entries(spark, sf):
    e = manifest.entry(ticker=F.col("ticker"), period=F.col("period"), sha256=F.col("sha256"), notes=F.array(F.lit("parsed")))
    return _entries(spark, sf).select("doc_id", F.to_json(e).alias("entry"))


@query
def manifest_summary(spark, sf):
    return manifest.summary(_entries(spark, sf), "ticker", "confidence")


@query
def manifest_by_type(spark, sf):
    return manifest.counts_by(_entries(spark, sf), "report_type")


@query
def manifest_by_period(spark, sf):
    return manifest.counts_by(_entries(spark, sf), "period")


@query
def latest_entry_per_key(spark, sf):
    return manifest.latest(_entries(spark, sf), "ticker", "published", "doc_id").select("ticker", "doc_id", "published")


@query
def is_duplicate(spark, sf):
    """Documents whose text is that of an entry in the manifest (the labelled documents)."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return manifest.known(d, d.join(table(spark, sf, "labels"), "doc_id", "left_semi"), ["sha256"]).select("doc_id")


# -- summaries --


@query
def corpus_summary(spark, sf):
    d = table(spark, sf, "documents").withColumn("size", F.octet_length("text")).withColumn("period", F.concat(F.lit("2025-Q"), (F.col("doc_id") % 4 + 1).cast("string")))
    return summaries.corpus(d, "source", "period", "size")


@query
def pipeline_summary(spark, sf):
    stages = {"extracted": "doc_id % 5 <> 0", "uploaded": "doc_id % 7 <> 0", "in_manifest": "doc_id % 2 = 0", "qc_passed": "doc_id % 11 = 0"}
    return summaries.pipeline(_entries(spark, sf), stages, "confidence")


@query
def run_totals(spark, sf):
    return summaries.run_totals(table(spark, sf, "events"), "event_type <> 'error'", "value", 3600.0)


@query
def failure_analysis(spark, sf):
    e = table(spark, sf, "events").withColumn("error", F.when(F.col("event_type") == "error", F.col("props")))
    return summaries.failures(e, "error")


@query
def upload_summary(spark, sf):
    return summaries.outcomes(table(spark, sf, "events"), "event_type", "value >= 5")


# -- state --


def _arrivals(spark, sf) -> DataFrame:
    """Arrivals by event_id; every third was published a day earlier than it came."""
    late = F.when(F.col("event_id") % 3 == 0, F.expr("ts - INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.md5(F.col("props").cast("binary")).alias("sha256"), F.date_format(late, "yyyy-MM-dd HH:mm:ss").alias("published")
    )


@query
def state_upsert(spark, sf):
    return state.upserted(_arrivals(spark, sf), "user_id", "event_id")


@query
def skip_decision(spark, sf):
    return state.replay(_arrivals(spark, sf), "user_id", "event_id").select("event_id", "process")


@query
def skip_reasons(spark, sf):
    """All arrivals against the state that those of one type left."""
    a = _arrivals(spark, sf)
    s = state.upserted(a.filter("event_type = 'error'"), "user_id", "event_id")
    return state.decide(a, s, "user_id").select("event_id", "process", "reason")


@query
def older_arrivals(spark, sf):
    return state.older_than_seen(_arrivals(spark, sf), "user_id", "event_id", 1_000).select("event_id", "newest_before")


@query
def state_histogram(spark, sf):
    return state.histogram(state_upsert(spark, sf))


@query
def latest_updates(spark, sf):
    """The states in order of their last update."""
    return state_upsert(spark, sf).select("user_id", "published").orderBy(F.desc("published"), "user_id")


@query
def stream_state_upsert(spark, sf):
    folder = work_folder(spark)
    _arrivals(spark, sf).drop("event_type").repartition(3, "user_id").write.parquet(f"{folder}/drops")
    schema = "event_id long, user_id long, sha256 string, published string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/drops")
    return state_stream.stream_upsert(spark, stream, folder, "user_id", "event_id")


# -- checks --


@query
def required_objects_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return files.missing_objects(d, table(spark, sf, "labels"), ["doc_id"])


@query
def qc_outputs(spark, sf):
    e = qc.text_outputs(F.col("text"), F.col("doc_id") % 2)
    return table(spark, sf, "documents").select("doc_id", e.alias("e")).select("doc_id", F.array_join("e", "; ").alias("errors"), (F.size("e") == 0).alias("passed"))


def _records(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    r = F.struct(
        F.when(i % 4 == 0, F.lit(None)).otherwise(F.col("ticker")).alias("ticker"), F.col("period"), F.col("published"), F.col("report_type"),
        F.struct((i % 5 - 1).cast("double").alias("value"), F.when(i % 6 == 0, "EUR").otherwise("USD").alias("unit"), F.when(i % 7 == 0, "T").otherwise("M").alias("scale")).alias("revenue"),
        F.array_repeat(F.lit("x"), (i % 8).cast("int")).alias("key_highlights"), F.col("confidence"),
    )
    e = F.struct(
        F.col("ticker"), F.col("period"), F.col("published"), F.col("report_type"), F.when(i % 3 == 0, "").otherwise("u").alias("source_url"),
        F.when(i % 10 == 0, F.substring("sha256", 1, 9)).otherwise(F.col("sha256")).alias("sha256"), F.lit("f.pdf").alias("filename"),
        F.when(i % 9 == 0, "/f.pdf").otherwise("gs://b/f.pdf").alias("pdf_path"),
    )
    return _entries(spark, sf).select("doc_id", r.alias("r"), e.alias("e"), "confidence", "ticker", "period")


@query
def qc_structured(spark, sf):
    x = qc.structured(F.col("r"), F.col("ticker"), F.lit("2025-Q1"))
    return _records(spark, sf).select("doc_id", F.array_join(x, "; ").alias("errors"))


@query
def qc_manifest(spark, sf):
    x = qc.manifest_entry(F.col("e"), F.col("confidence"))
    return _records(spark, sf).select("doc_id", F.array_join(x, "; ").alias("errors"), qc.first_error(x).alias("first_error"))


@query
def qc_full(spark, sf):
    c = qc.combined(
        structured=qc.structured(F.col("r"), F.col("ticker"), F.lit("2025-Q1")), manifest=qc.manifest_entry(F.col("e"), F.col("confidence"))
    )
    return _records(spark, sf).select("doc_id", c.alias("c")).select("doc_id", "c.overall_passed", "c.error_count")


# -- files --


@query
def csv_long_form(spark, sf):
    """The nations as CSV tables, one file a region, read back as cells."""
    folder = work_folder(spark)
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.repartition(1).sortWithinPartitions("n_nationkey").write.option("quoteAll", "true").csv(f"{folder}/csv")
    return files.csv_cells(spark, f"{folder}/csv").select("row_no", "col_no", "value")


@query
def jsonl_permissive(spark, sf):
    """Entries and broken lines in one file: the readable ones come back."""
    folder = work_folder(spark)
    e = _entries(spark, sf).select(F.to_json(F.struct("ticker", "period", "sha256")).alias("value"), "doc_id")
    line = F.when(F.col("doc_id") % 10 == 0, F.substring("value", 1, 12)).otherwise(F.col("value"))
    e.select(line.alias("value")).write.text(f"{folder}/lines")
    return files.json_lines(spark, f"{folder}/lines").groupBy("ticker", "period").agg(F.count("*").alias("n"))


@query
def binary_scan(spark, sf):
    """Three files of known bytes, found by their names."""
    folder = work_folder(spark)
    r = table(spark, sf, "region").select("r_name")
    r.repartition(1).sortWithinPartitions("r_name").write.text(f"{folder}/files")
    return files.binary_files(spark, f"{folder}/files", "*.txt", recursive=True).select("file_size", "sha256")


@query
def page_titles(spark, sf):
    """Stripped, lower-case titles; null where a page has none."""
    t = nullif_empty(F.lower(py_strip(F.regexp_extract("html", "<title>([^<]*)</title>", 1))))
    return table(spark, sf, "pages").select("page_id", t.alias("title"))
