"""Further registered queries: searches of several stages, files and sinks, checks by kind of value, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import urls
from ..operators import discovery, documents, downloads, links, manifest, qc, ranking, searches, state, summaries
from ..params import EngineParams
from ..sources import files
from ..sources.files import work_folder
from ..sources.versioned import VersionedTable
from .catalogue import DEFAULTS, _arrivals, _entries, _named, query, report_links, table, tree_pages, with_ticker


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


# -- searches --


def _companies(spark) -> DataFrame:
    rows = [(i, t, u) for i, (t, _, u) in enumerate(P.COMPANIES)]
    return spark.createDataFrame(rows, "company_id long, ticker string, url string")


@query
def discover_ir(spark, sf):
    """The investor page of each company, from known ones, crawled pages (of every fourth company) and links; the links of some
    companies are relative but for those in menus, or relative altogether."""
    companies, i, k = _companies(spark), F.col("company_id"), F.col("link_id")
    w = Window.partitionBy("company_id").orderBy("link_id")
    made = report_links(spark, sf).withColumn("ord", F.row_number().over(w) - 1)
    area = F.when(k % 11 == 0, "nav").when(k % 13 == 0, "footer")
    href = F.when(k % 3 == 0, F.replace("url", F.lit("/doc-"), F.lit("/investors/"))).otherwise(F.col("url"))
    relative = (i % 5 == 3) | ((i % 5 == 2) & ~F.coalesce(area == "nav", F.lit(False)))
    href = F.when(relative, F.regexp_replace(href, "^https://[^/]*", "")).otherwise(href)
    found = made.select("company_id", "ord", F.when(k % 4 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"), href.alias("href"), area.alias("area"))
    crawled = companies.filter(i % 4 == 1).select(
        F.element_at(urls.ir_candidates(F.col("url")), (i % 9 + 1).cast("int")).alias("url"), F.when(i % 8 == 1, "Access Denied").otherwise("Investor Center").alias("title"),
        F.lit("").alias("body"),
    )
    return discovery.discover(companies, crawled, found)


def _navigation(spark, sf) -> DataFrame:
    """Links of pages under each company's own: every third page of a company exists, some by a title that says that it doesn't."""
    base = lambda c: F.concat(F.lit("https://c"), c.cast("string"), F.lit(".example.com/ir"))
    paths = spark.createDataFrame(list(enumerate(P.NAVIGATION_PATHS)), "j int, path string")
    i, j = F.col("company_id"), F.col("j")
    bases = _companies(spark).select("company_id", F.concat(base(i), F.lit("/")).alias("url"))
    # 30 companies and 33 paths
    pages = bases.select("company_id").join(F.broadcast(paths)).filter((i * 7 + j) % 3 == 0).select(
        F.concat(base(i), F.col("path")).alias("url"), F.when((i + j) % 11 == 0, "Page Not Found").otherwise("Reports").alias("title")
    )
    names = F.array(*[F.lit(x) for x in P.NAVIGATION_PATHS])
    k = F.col("link_id")
    path = F.element_at(names, (k % 33 + 1).cast("int"))
    shown = report_links(spark, sf).select(
        F.concat(base(i), path).alias("page"), (F.floor(k / 33) % 40).alias("ord"), F.when(k % 4 == 0, "Webcast").otherwise(F.col("text")).alias("text"),
        F.regexp_replace("url", "/doc-[0-9]+", "/doc").alias("url"),
    )
    return ranking.navigation_links(bases, pages, shown)


@query
def navigation_links(spark, sf):
    return _navigation(spark, sf).select("company_id", "url", "path_ord", "ord")


@query
def navigation_reports(spark, sf):
    """Valid ones among the links of other pages, an address once, with their class. Every fourth link has a text of no report."""
    found = _navigation(spark, sf).withColumn("link_id", F.col("path_ord") * 100 + F.col("ord"))
    hits = ranking.first_of_each(ranking._hits(found, DEFAULTS, ranking._on_other_pages))
    return hits.select("company_id", "url", "path_ord", "ord", F.col("class.year").alias("label"), "strategy", "score")


def _bodies(spark, sf) -> DataFrame:
    i = F.col("page_id").cast("string")
    body = F.concat("html", F.lit(" in Q3 2025 see https://investors.example.com/2025/q3/doc-"), i, F.lit(".pdf, or the report at "), "url")
    return table(spark, sf, "pages").withColumn("html", body)


@query
def context_urls(spark, sf):
    found = links.context_urls(_bodies(spark, sf), ["investor", "report", "Q[1-4]"])
    return found.select("page_id", "word", "hit", "place", "found_url", "valid")


@query
def fallback_reports(spark, sf):
    return links.fallback_reports(_bodies(spark, sf)).drop("ord")


@query
def cascade_all(spark, sf):
    """The cascade with links of other pages and addresses found in texts: a company's main page has the links whose number is no
    multiple of its own number in the list (plus 2)."""
    k, i = F.col("link_id"), F.col("company_id")
    every = with_ticker(report_links(spark, sf))
    main = every.filter((k % (i + 2) != 0) & (i % 3 != 1) & (i % 3 != 2))
    other = every.filter((k % 40 == 1) & (i % 3 == 1))
    last = every.filter(k % 100 == 2).select("company_id", "link_id", "url")
    out = ranking.cascade(main, DEFAULTS, navigation=other, last_resort=last)
    return out.groupBy("company_id", "strategy").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query
def first_valid_pdf(spark, sf):
    """Every third link's file is unusable."""
    found = with_ticker(report_links(spark, sf))
    held = found.select("url", F.when(F.col("link_id") % 3 == 0, "too small").alias("problem"))
    return downloads.first_valid_pdf(found, held).select("company_id", "link_id", F.col("place").cast("long").alias("place"), F.col("score").cast("long").alias("score"))


@query
def pdf_candidates(spark, sf):
    return links.pdf_candidates(tree_pages(spark, sf))


@query
def area_links(spark, sf):
    found = links.area_links(tree_pages(spark, sf))
    return found.groupBy("page_id", F.coalesce("area", F.lit("page")).alias("area")).agg(F.count("*").alias("n"), F.max("href").alias("last"))


@query
def dynamic_discovery(spark, sf):
    found = searches.dynamic_discovery(tree_pages(spark, sf), DEFAULTS)
    return found.select("page_id", "selector", F.col("place").cast("long").alias("place"), "url", "text", F.col("class.year").alias("label"), F.round("score", 4).alias("score"))


@query
def page_scan(spark, sf):
    found = searches.page_scan(tree_pages(spark, sf), DEFAULTS)
    return found.select("page_id", "url", "text", "pass", "matched", F.col("class.year").alias("label"), "score")


@query
def date_hits(spark, sf):
    return searches.date_hits(tree_pages(spark, sf))


def _search_links(spark, sf) -> DataFrame:
    """Links of which some are of this year; the first hundred of every fifth company's are about nothing that a keyword finds."""
    k, i = F.col("link_id"), F.col("company_id")
    year = lambda c: F.when(k % 3 == 0, F.replace(c, F.lit("2022"), F.lit("2025"))).otherwise(F.col(c))
    text = F.when((i % 5 == 2) & (F.col("nth") <= 100), F.when(k % 2 == 0, "Quarterly report").otherwise("Other 2025 report")).when(k % 11 == 0, "").otherwise(year("text"))
    nth = F.row_number().over(Window.partitionBy("company_id").orderBy("link_id"))
    made = with_ticker(report_links(spark, sf)).withColumn("nth", nth)
    word = F.lower(F.col("ticker"))
    address = F.when((k % 7 == 0) & (i % 5 != 2), F.replace(year("url"), F.lit("/doc-"), F.concat(F.lit("/investment-banking-"), word, F.lit("-earnings-release-")))).otherwise(year("url"))
    return made.select("company_id", "link_id", "ticker", text.alias("text"), address.alias("url"))


@query
def keyword_search(spark, sf):
    found = searches.keyword_search(_search_links(spark, sf), DEFAULTS)
    return found.select("company_id", "link_id", "tier", "keyword", "url", F.col("class.year").alias("label"), "score")


@query
def learned_reports(spark, sf):
    named = _search_links(spark, sf).withColumn("url", F.replace("url", F.lit("/doc-"), F.lit("/quarterly-report_")))
    found = searches.learned_reports(named, DEFAULTS)
    return found.select("company_id", "link_id", "text", F.col("class.year").alias("label"), F.round("score", 4).alias("score"))


@query
def fixed_page_reports(spark, sf):
    """The links of companies' fixed pages; on the first page of every other company none is recent."""
    tried = searches.fixed_pages(_companies(spark))
    i, k, o = F.col("company_id"), F.col("link_id"), F.col("page_ord")
    year = F.when((o == 0) & (i % 2 == 0), "2023").otherwise(F.when(k % 3 == 0, "2025").otherwise("2021"))
    shown = report_links(spark, sf).filter("link_id % 5 < 2").withColumn("page_ord", (k % 2).cast("int")).join(F.broadcast(tried), ["company_id", "page_ord"])
    shown = shown.select("page", (F.floor(k / 50) % 300).alias("ord"), "text", F.regexp_replace("url", "/20[0-9]{2}/", F.concat(F.lit("/"), year, F.lit("/"))).alias("url"))
    return searches.first_page_with_reports(tried, shown).select("company_id", "page_ord", F.col("ord").cast("long").alias("ord"), "url", "text")


# -- downloads and uploads --


@query
def files_to_download(spark, sf):
    """Reports whose file isn't there: files of even numbers are, those of multiples of ten are unusable."""
    named, k = _named(spark, sf), F.col("link_id")
    wanted = named.select("link_id", F.concat(k.cast("string"), F.lit("_"), "filename").alias("filename"))
    present = wanted.filter(k % 2 == 0).select("filename", F.when(k % 10 == 0, "too small").alias("problem"))
    return downloads.to_download(wanted, present).select("link_id")


@query
def answer_problems(spark, sf):
    """What is wrong with a server's answer: made of links and kinds of beginnings."""
    k = F.col("link_id")
    kind = F.when(k % 7 == 0, "Text/HTML; charset=utf-8").when(k % 7 == 1, F.lit(None)).otherwise("application/pdf")
    head = F.when(k % 5 == 0, "<!DOCTYPE html><p>").when(k % 5 == 1, "%PDF-1.4 <html>").when(k % 5 == 2, "\n<html lang=en>").otherwise("%PDF-1.7")
    found = report_links(spark, sf).withColumn("problem", downloads.answer_problem(F.col("url"), kind, head))
    return found.filter("problem is not null").select("link_id", "problem")


@query
def ticker_files(spark, sf):
    return downloads.of_ticker(_named(spark, sf), "msft").select("link_id", "ticker")


@query
def file_sizes(spark, sf):
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", downloads.sizes(size).alias("s")).select("doc_id", "s.kb", "s.mb")


@query
def download_summary(spark, sf):
    d = table(spark, sf, "documents")
    runs = d.groupBy(F.col("source").alias("ticker")).agg(F.count("*").alias("n"))
    stored = d.select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".xlsx").otherwise(".txt")).alias("name"),
                      F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("size"))
    return downloads.summary(runs, "n % 2 = 0", stored)


@query
def upload_rows(spark, sf):
    k = F.col("link_id")
    error = F.when(k % 9 == 0, F.concat(F.lit("no space for "), k.cast("string")))
    return downloads.uploads(_named(spark, sf), "store", F.lit("2025-Q4"), error).groupBy("ticker", "success").agg(
        F.count("*").alias("n"), F.max("path").alias("last_path"), F.max("error").alias("last_error")
    )


# -- state --


@query
def state_after_skips(spark, sf):
    return state.after_skips(_arrivals(spark, sf), "user_id", "event_id")


@query
def state_overview(spark, sf):
    a = _arrivals(spark, sf)
    return state.overview(state.upserted(a.filter("event_type = 'error'"), "user_id", "event_id"), a, "user_id")


@query
def state_backups(spark, sf):
    """Where each state's copy goes, and whether there is one to clean up after."""
    a = _arrivals(spark, sf)
    kept = state.kept_states(state.upserted(a.filter("event_type = 'error'"), "user_id", "event_id"), a, "user_id")
    path = F.concat(F.lit("store/state/"), F.col("user_id").cast("string"), F.lit(".json"))
    return kept.select("user_id", "kept", F.when(F.col("kept"), downloads.state_backup(path, F.lit("20251010_120000"))).alias("backup"))


# -- summaries --


@query
def corpus_totals(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        F.col("source").alias("ticker"), _text("2025-Q", (i % 4 + 1).cast("string")).alias("period"), (i % 7).alias("tables"), (i % 3).alias("images"),
        F.octet_length("text").alias("size"),
    )
    return summaries.corpus_totals(d, "ticker", "period", "tables", "images", "size")


@query
def corpus_by_type(spark, sf):
    i = F.col("doc_id")
    name = F.concat(F.upper("source"), F.when(i % 5 == 0, "_Slides.pdf").when(i % 5 == 1, "_supplement.pdf").otherwise("_report.pdf"))
    typed = table(spark, sf, "documents").select(documents.report_type(name, F.lit("")).alias("report_type"))
    return manifest.counts_by(typed, "report_type")


@query
def failed_rows(spark, sf):
    e = table(spark, sf, "events")
    error = F.when(F.col("event_type") == "error", F.concat(F.when(F.col("event_id") % 2 == 0, "Timeout: ").otherwise("No reports: "), F.col("event_id").cast("string")))
    return summaries.failed_rows(e.select(F.col("user_id").alias("company"), error.alias("error"), "event_id"), "error", "event_id")


@query
def image_totals(spark, sf):
    return documents.extraction_totals(documents.duplicate_counts(table(spark, sf, "documents"), "text", "source"), 100)


@query
def year_weights(spark, sf):
    """The weight of the year that each order's date stands for, as a search in 2025 has it."""
    year = (F.year("o_orderdate") + 24).cast("string")
    weights = F.create_map(*[F.lit(x) for pair in P.year_patterns(DEFAULTS.year) for x in pair])
    return table(spark, sf, "orders").groupBy(year.alias("year")).agg(F.count("*").alias("n")).withColumn("weight", F.coalesce(weights[F.col("year")], F.lit(0.0)))


@query
def config_problems(spark, sf):
    """Settings of runs, made of customers: some of a company that isn't known, without workers or a date."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    tickers = F.array(*[F.lit(c[0]) for c in P.COMPANIES], F.lit("NONE"))
    companies = F.array(F.element_at(tickers, (k % 31 + 1).cast("int")), F.element_at(tickers, (n % 31 + 1).cast("int")))
    as_of = F.when(k % 7 == 0, "today").otherwise("2025-10-10")
    problems = qc.config_problems(companies, n - 2, as_of)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(problems, "; ").alias("problems"))


# -- checks --


def _tables() -> Column:
    i = F.col("doc_id")
    one = F.struct(F.lit("t1.csv").alias("name"), F.substring("text", F.lit(1), (i % 20).cast("int")).alias("content"))
    two = F.struct(F.lit("t2.csv").alias("name"), F.when(i % 5 != 0, "a long table, with cells").alias("content"))
    return F.slice(F.array(one, two), F.lit(1), (i % 3).cast("int"))


@query
def qc_extraction(spark, sf):
    e = qc.extraction(F.when(F.col("doc_id") % 10 != 0, F.col("text")), _tables())
    return table(spark, sf, "documents").select("doc_id", F.array_join(e, "; ").alias("errors"))


@query
def qc_objects(spark, sf):
    """A text folder is there for every second document, the PDF for every third."""
    i = F.col("doc_id")
    paths = urls.object_paths(F.lit("store"), F.upper("source"), F.lit("2025-Q1"), i.cast("string"))
    d = table(spark, sf, "documents").select("doc_id", paths.alias("p"))
    present = F.array_compact(F.array(F.when(i % 3 == 0, F.col("p.raw_pdf")), F.when(i % 2 == 0, F.col("p.text_dir"))))
    known = ["raw_pdf", "text_dir", "tables_dir", "images_dir", "structured_json", "docling_manifest", "manifest_jsonl", "state_json"]
    e = qc.objects(present, ["raw_pdf", "text_dir", "video"], F.col("p"), known)
    return d.select("doc_id", F.array_join(e, "; ").alias("errors"))


@query
def qc_json(spark, sf):
    """Records as JSON texts with values of all kinds."""
    i = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    revenue = pick(6, '"lots"', '{"value": "x", "unit": "USD", "scale": "M"}', '{"value": -1, "unit": "EUR", "scale": "T"}', "null", "{}", '{"value": 2.5, "unit": "USD", "scale": null}')
    eps = pick(4, ', "eps_diluted": "n/a"', ', "eps_diluted": 1.5', ', "eps_diluted": null', "")
    notes = pick(5, ', "key_highlights": "text"', ', "key_highlights": []', ', "key_highlights": ["a","b","c","d","e","f"]', "", ', "key_highlights": ["a"]')
    conf = pick(3, ', "confidence": 0.05', ', "confidence": "high"', "")
    who = pick(7, '"X"', '"X"', '"Y"', '"X"', "null", '"X"', '"X"')
    text = F.concat(F.lit('{"ticker": '), who, F.lit(', "period": "2025-Q1", "published": "2025-04-01", "report_type": "press", "revenue": '), revenue, eps, notes, conf, F.lit("}"))
    e = qc.structured_json(text, F.lit("X"), F.lit("2025-Q1"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(e, "; ").alias("errors"))


@query
def manifest_full(spark, sf):
    i = F.col("doc_id")
    e = F.struct(
        "ticker", "period", "published", "report_type", F.lit("https://x.example.com/r").alias("source_url"), "sha256", F.lit("r.pdf").alias("filename"),
        F.when(i % 4 > 0, i % 9).cast("int").alias("pages"), (i % 5).cast("int").alias("tables"), F.when(i % 2 == 0, "1.0.0").alias("version"), "confidence",
        F.when(i % 6 == 0, F.array(F.lit("late"))).alias("notes"),
    )
    m = manifest.full_entry(e, "store", "parser", "model-1")
    return _entries(spark, sf).select("doc_id", m.alias("m")).select(
        "doc_id", "m.pdf_path", "m.pages", "m.tables", F.col("m.parser.version").alias("version"), F.col("m.structured.path").alias("record"),
        F.col("m.structured.confidence").alias("confidence"), F.size("m.notes").alias("n_notes"),
    )


@query
def table_exports(spark, sf):
    k, n = F.col("doc_id"), F.col("source")
    frame = F.when(k % 4 == 0, _text("name\n", n)).when(k % 4 == 1, F.lit("name"))
    direct = F.when(k % 4 == 1, n)
    other = F.when(k % 4 == 2, _text("h\n", n, "\n"))
    md = F.when(k % 8 != 7, _text("| name |\n|--|\n| ", n, " |"))
    e = documents.table_export(frame, direct, other, md)
    return table(spark, sf, "documents").select("doc_id", e.alias("e")).select("doc_id", "e.method", "e.csv")


# -- files --


def _reports(spark, sf) -> DataFrame:
    """A report of each document, of the company that its source stands for: every fourth with its original, every third with an image,
    and with as many tables as the number's remainder by three."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    every = F.array(*[F.struct(F.lit(f"t{k}").alias("name"), F.concat(F.lit(f"k,v\n{k},"), F.octet_length(text).cast("string")).alias("csv")) for k in (1, 2)])
    image = F.array(F.struct(F.lit("chart").alias("name"), F.unhex(F.md5(text.cast("binary"))).alias("content")))
    return table(spark, sf, "documents").select(
        F.coalesce("source", F.lit("none")).alias("ticker"), _text("2025-Q", (i % 4 + 1).cast("string")).alias("period"), _text("r", i.cast("string")).alias("report"),
        F.when(i % 4 == 0, F.concat(F.lit("%PDF-"), i.cast("string")).cast("binary")).alias("pdf"), F.col("text"), F.slice(every, F.lit(1), (i % 3).cast("int")).alias("tables"),
        F.when(i % 3 == 0, image).otherwise(F.slice(image, 1, 0)).alias("images"), F.to_json(F.struct("lang", "n_chars")).alias("metadata"),
    )


def _written(spark, sf) -> str:
    root = f"{work_folder(spark)}/tree"
    files.write_layout(_reports(spark, sf), root)
    return root


@query
def layout(spark, sf):
    """Every document as files, read back: how many of each kind there are, and the hash of all their hashes."""
    back = files.read_layout(spark, _written(spark, sf))
    named = F.concat_ws(":", "filename", F.sha2("content", 256))
    per = back.groupBy("ticker", "period", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.array_join(F.array_sort(F.collect_list(named)), ",").alias("all"))
    return per.withColumn("all", F.sha2(F.col("all").cast("binary"), 256))


@query
def pruned_layout(spark, sf):
    """The texts of one company's quarter: other folders aren't listed."""
    back = files.read_folders(spark, _written(spark, sf), ["SRC3"], ["2025-Q4", "2025-Q9"]).filter("kind = 'text'")
    return back.select("report", F.decode("content", "UTF-8").alias("text"))


@query
def partition_tree(spark, sf):
    return files.partition_tree(spark, _written(spark, sf)).select("ticker", "period", "filename", "length")


@query
def output_sets(spark, sf):
    found = files.output_sets(files.partition_tree(spark, _written(spark, sf)))
    return found.select("ticker", "period", "stem", "filename", "text_file", F.array_join("table_files", ",").alias("tables"), F.array_join("image_files", ",").alias("images"))


@query
def object_listing(spark, sf):
    return files.listing(spark, _written(spark, sf), "src1/").filter(F.col("updated").isNotNull()).select("name", "size", "extension")


@query
def whole_texts(spark, sf):
    found = files.whole_texts(spark, f"{_written(spark, sf)}/src1/2025-Q2/text")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "text")


@query
def json_objects(spark, sf):
    """A state as one JSON object over several lines, and one that isn't there."""
    folder = work_folder(spark)
    table(spark, sf, "region").agg(F.count("*").alias("n")).select(_text('{\n "ticker": "A",\n "processing_count": ', F.col("n").cast("string"), "\n}")).coalesce(1).write.text(f"{folder}/state")
    schema = "ticker string, processing_count long"
    return files.json_object(spark, f"{folder}/state", schema).unionByName(files.json_object(spark, f"{folder}/none", schema))


@query
def results_sink(spark, sf):
    """A run's results, written twice and read back: the second run replaces the first."""
    folder = work_folder(spark)
    r = table(spark, sf, "nation").select("n_name", "n_regionkey")
    files.write_results(r, f"{folder}/results")
    files.write_results(r.filter("n_regionkey < 3"), f"{folder}/results")
    back = spark.read.json(f"{folder}/results")
    return back.filter(F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT")).select("n_name", "n_regionkey")


@query
def appended_lines(spark, sf):
    """Entries appended in two steps; those with errors come back and are not written."""
    folder = work_folder(spark)
    e = _entries(spark, sf).select("ticker", "period", "published", "report_type", "sha256")
    files.append_json_lines(e.filter("period = '2025-Q1'"), f"{folder}/lines")
    left = files.append_valid(e.filter("period = '2025-Q2'"), qc.messages((F.col("report_type").isNull(), "no type")), f"{folder}/lines")
    kept = files.json_lines(spark, f"{folder}/lines").groupBy("period").agg(F.count("*").alias("n"), F.count("_written_at").alias("stamped"))
    return kept.unionByName(left.groupBy(F.lit("left out").alias("period")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("stamped")))


@query
def put_states(spark, sf):
    """States put by key in two steps: those that errors left, then those of all arrivals of even users, which replace theirs."""
    path = f"{work_folder(spark)}/states"
    a = _arrivals(spark, sf)
    files.put_by_key(state.upserted(a.filter("event_type = 'error'"), "user_id", "event_id"), path, "user_id")
    files.put_by_key(state.upserted(a.filter("user_id % 2 = 0"), "user_id", "event_id"), path, "user_id")
    return files.by_key(spark, path)


@query
def backup_states(spark, sf):
    """A backup of the states that errors left, read after all arrivals of even users and a cleaning: what was, and what is."""
    path = f"{work_folder(spark)}/states"
    a = _arrivals(spark, sf)
    files.put_by_key(state.upserted(a.filter("event_type = 'error'"), "user_id", "event_id"), path, "user_id")
    states = VersionedTable(spark, path)
    states.pin("before")
    files.put_by_key(state.upserted(a.filter("user_id % 2 = 0"), "user_id", "event_id"), path, "user_id")
    files.put_by_key(state.upserted(a.filter("user_id % 4 = 0"), "user_id", "event_id"), path, "user_id")
    states.clean(grace=0)
    was = states.read_pin("before").select("user_id", F.col("processing_count").alias("was"))
    return states.read().select("user_id", F.col("processing_count").alias("now")).join(was, "user_id", "full")


@query
def stored_objects(spark, sf):
    """Texts stored as objects with their types and metadata; some a second time, which the reader then sees."""
    root = f"{work_folder(spark)}/store"
    i = F.col("doc_id")
    made = table(spark, sf, "documents").select(
        _text("parsed/", i.cast("string"), "/text.txt").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"),
        F.lit("text/plain").alias("content_type"), F.create_map(F.lit("region"), F.col("source")).alias("metadata"), "doc_id",
    )
    files.put_objects(made.drop("doc_id"), root)
    new = lambda c: made.filter("doc_id % 3 = 0").withColumn("content", F.lit(c).cast("binary")).withColumn("content_type", F.lit("application/json"))
    uris = files.put_objects(new("new").unionByName(new("neu")).drop("doc_id"), root)  # each name twice in one put
    back = files.get_objects(spark, root).join(uris, "name", "left")
    return back.select("name", F.sha2("content", 256).alias("content"), "content_type", F.col("metadata")["region"].alias("region"), F.col("uri").isNotNull().alias("again"))
