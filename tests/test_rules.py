"""Recorded results, and hand-checked cases of the column rules."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarterlens.functions import periods, rules, scoring, urls
from quarterlens.params import EngineParams

HERE = os.path.dirname(os.path.abspath(__file__))


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_recorded_reports(spark):
    with open(f"{HERE}/data/ranked_reports.json", encoding="utf-8") as f:
        rows = json.load(f)
    df = spark.createDataFrame(
        [(i, *r[:6], float(r[6]), float(r[7])) for i, r in enumerate([[*r[:3], float(r[3]), *r[4:]] for r in rows])],
        "i int, text string, url string, strategy string, priority double, label string, type string, score double, final double",
    )
    t, u = F.col("text"), F.col("url")
    c = scoring.classification(t, u)
    got = df.select(
        "*", c.alias("c"), scoring.comprehensive_score(t, u).alias("s"), scoring.final_score(F.col("score"), F.col("strategy"), F.col("priority")).alias("f")
    ).collect()
    assert len(got) == 20
    computed = [r for r in got if r["strategy"] in ("learned_patterns", "comprehensive_scan")]
    assert len(computed) == 11
    for r in got:
        assert (r["c"]["year"], r["c"]["type"]) == (r["label"], r["type"]) and abs(r["c"]["priority"] - r["priority"]) < 1e-9
    for r in computed:
        assert abs(r["s"] - r["score"]) < 1e-9
    again = df.select(
        "final", "strategy", "text", "url", "score", "priority",
        scoring.final_score(scoring.comprehensive_score(t, u), F.col("strategy"), F.col("priority")).alias("f"),
    ).collect()
    assert all(abs(r["f"] - r["final"]) < 1e-9 for r in again)


@pytest.mark.parametrize(
    ("title", "period"),
    [
        ("Results Q1 2024", "2024-Q1"), ("q3   2025 call", "2025-Q3"), ("first quarter 2024", "2024-Q1"), ("First Quarter 2024", None),
        ("2024 Q1", None), ("2024 q2", "2024-Q2"), ("1q24", "2024-Q1"), ("1Q24", None), ("4q49", None), ("FY24 Q1", None),
        ("FY2024 Q3", "2024-Q3"), ("Three months ended March 31, 2024", None), ("", None), (None, None), ("Q2 1999", None), ("2q2023", "2023-Q2"),
    ],
)
def test_period_from_title(spark, title, period):
    assert one(spark, periods.period_from_title(F.col("t")), t=title) == period


@pytest.mark.parametrize(
    ("raw", "period"),
    [("2024-Q3", "2024-Q3"), (" 2024-q3 ", "2024-Q3"), ("2024-10-31", "2024-Q1"), ("FY2023 quarter 2", "2023-Q2"), ("none", None), ("2025", None)],
)
def test_normalize_period(spark, raw, period):
    assert one(spark, periods.normalize_period(F.col("t")), t=raw) == period


@pytest.mark.parametrize(
    ("name", "ticker", "period"),
    [
        ("CAT_2025-Q2_LATEST-EXPECTED_financial_report.pdf", "CAT", "2025-Q2"), ("V_2025-Q4_financial_report.pdf", "UNKNOWN", "2025-Q4"),
        ("MMM_2025_annual.pdf", "MMM", "2025-Q4"), ("HD_20253.pdf", "HD", "2025-Q3"), ("apple.pdf", "UNKNOWN", "2025-Q4"),
    ],
)
def test_file_names(spark, name, ticker, period):
    n = F.col("n")
    assert one(spark, periods.ticker_from_filename(n), n=name) == ticker
    assert one(spark, periods.period_from_filename(n), n=name) == period


def test_period_from_date_and_infer(spark):
    assert one(spark, periods.period_from_date(F.col("d")), d="2024-11-05T10:00:00") == "2024-Q4"
    assert one(spark, periods.period_from_date(F.col("d")), d="2024-13-05") is None
    assert one(spark, periods.infer_period(F.col("t"), F.col("d")), t="Report", d="2024-02-05") == "2024-Q1"


@pytest.mark.parametrize(
    ("text", "url", "valid"),
    [
        ("Q2 2025 results", "https://a.com/x.pdf", True), ("", "", False), ("Q2 2025 presentation", "https://a.com/x.pdf", False),
        ("Annual report", "https://a.com/2019/x.pdf", False), ("Latest annual report", "https://a.com/2019/x.pdf", True),
        ("Q2 2019 results", "https://a.com/x.pdf", True), ("hello", "https://a.com/", False), (None, None, False),
    ],
)
def test_valid_links(spark, text, url, valid):
    assert one(spark, rules.valid_report_link(F.col("u"), F.col("t")), t=text, u=url) is valid


@pytest.mark.parametrize(
    ("c", "factor"),
    [
        ("october 30, 2025 results", 0.1), ("oct 3, 2025", 1.0), ("november 31, 2025", 1.0), ("12/31/2025", 0.1), ("9/30/2025", 1.0), ("13/1/2025", 1.0),
        ("q3 2025 conference", 0.2), ("add to calendar", 0.3), ("q4 2025 results", 0.95), ("webcast event", 0.3), ("2024 10-k", 0.7), ("2024 q1", 0.4), ("results", 1.0),
    ],
)
def test_availability(spark, c, factor):
    assert abs(one(spark, scoring.availability(F.col("c"), F.lit(1.0)), c=c) - factor) < 1e-12


@pytest.mark.parametrize(
    ("url", "valid"),
    [
        ("https://a.com/investors/x", True), ("https://a.com/investors/news", False), ("https://a.com/financial", True),
        ("https://a.com/financial/2025-01", False), ("javascript:void(0)", False), ("/investors/", False), (None, False),
    ],
)
def test_ir_urls(spark, url, valid):
    assert one(spark, rules.valid_ir_url(F.col("u")), u=url) is valid


def test_file_problems(spark):
    big = b"%PDF-1.7" + b" " * 60_000
    cases = [
        ("a.pdf", b"x", "too small"), ("a.pdf", b"x" * 60_000, "not a PDF"), ("a.pdf", b"%PDF-<html>" + b" " * 60_000, "web page"),
        ("a.pdf", b"%PDF- 404" + b" " * 60_000, "error page"), ("a.xlsx", b"x" * 20_000, "not a workbook"), ("a.pdf", big[:20_000], "below minimum"),
        ("a.pdf", big, None), ("a.xlsx", b"PK\x03\x04" + b" " * 20_000, None), ("a.xls", b"\xd0\xcf\x11\xe0" + b" " * 20_000, None), ("a.docx", b"x" * 60_000, None),
    ]
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c, _) in enumerate(cases)], "i int, name string, content binary")
    got = {r["i"]: r["p"] for r in df.select("i", rules.file_problem_bytes(F.col("name"), F.col("content")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_ir_candidates(spark):
    got = one(spark, urls.ir_candidates(F.col("u")), u="https://www.acme.com/x")
    assert got[0] == "https://ir.aboutacme.com/" and got[1] == "https://investors.acme.com/" and len(got) == 9
    assert one(spark, urls.registrable_domain(F.col("u")), u="https://a.b.acme.com/x") == "acme.com"


def test_params():
    p = EngineParams.from_env({"QUARTERLENS_COMPANIES": "AAPL, XX", "QUARTERLENS_WORKERS": "0"})
    assert p.problems() == ["unknown company: XX", "workers must be at least 1"] and EngineParams().problems() == []


def test_paths_of_any_length(spark):
    url = "https://www.example.com/" + "/".join(f"s{i}" for i in range(1_500))
    assert len(one(spark, urls.url_structure(F.col("u"))["path_structure"], u=url)) == 1_500
    assert one(spark, urls.url_structure(F.col("u"))["path_structure"], u="https://x.com") == []


@pytest.mark.parametrize(
    ("url", "start", "rejected"),
    [
        ("https://x.com/a", "<!DOCTYPE html>", True), ("https://x.com/a.PDF", "<!DOCTYPE html>", False), ("https://x.com/a", "<html>", True),
        ("https://x.com/a", "%PDF-1.7 <html>", False), ("https://x.com/a", "  <html", True), ("https://x.com/filing", "<html", False),
        ("https://x.com/a", " " * 600 + "<html", False), ("https://x.com/a", "<!doctype html>", False),
    ],
)
def test_web_pages_instead_of_files(spark, url, start, rejected):
    assert one(spark, rules.web_page_instead(F.col("u"), F.col("h")), u=url, h=start) == rejected


def test_generic_link_texts_and_scripts(spark):
    plain = one(spark, scoring.pdf_link_score(F.col("u"), F.col("t"), F.lit("XYZ")), u="https://a.com/r.pdf", t="report")
    for text, off in (("click", 1), ("here", 1), ("click here", 2), ("download here", 2), ("view", 1)):
        assert one(spark, scoring.pdf_link_score(F.col("u"), F.col("t"), F.lit("XYZ")), u="https://a.com/r.pdf", t=text) == plain - off
    assert not one(spark, rules.valid_ir_url(F.col("u")), u="https://a.com/investors/?x=JavaScript:go()")
    assert one(spark, rules.valid_ir_url(F.col("u")), u="https://a.com/investors/?x=go")
