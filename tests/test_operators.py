"""Files, streams, validators and model output; and every query against its SQL."""

import json
import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterlens.operators import documents, links, qc, ranking, state
from quarterlens.params import EngineParams
from quarterlens.plans import more, oracle_more  # noqa: F401
from quarterlens.plans.catalogue import QUERIES
from quarterlens.plans.oracle import SQL
from quarterlens.sources import files
from quarterlens.streaming.state_stream import stream_upsert


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, bool):
        return str(v)
    return round(float(v), 8) if isinstance(v, (int, float)) else v


def rows_of(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, duck, sf, name):
    a, b = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_context_urls(spark):
    first = "see https://a.example.com/x for the report"
    rows = [(1, first + " " * 300 + "https://b.example.com/yy Report " + "r" * 3), (2, None), (3, "é report https://c.example.com/2025-q2.pdf")]
    got = links.context_urls(spark.createDataFrame(rows, "page_id long, html string"), ["report"]).collect()
    assert {(r["page_id"], r["place"], r["hit"], r["found_url"], r["valid"]) for r in got} == {
        (1, first.index("report"), "report", "https://a.example.com/x", False),
        (1, len(first) + 325, "Report", "https://b.example.com/yy", False),
        (3, 2, "report", "https://c.example.com/2025-q2.pdf", True),
    }


def test_keep_first_is_stable(spark):
    df = spark.createDataFrame([(2, "a", 1.0), (1, "a", 1.0), (3, "b", 0.5)], "i int, url string, s double").repartition(3)
    got = ranking.keep_first(df, ["url"], F.desc("s"), "i").orderBy("url").collect()
    assert [r["i"] for r in got] == [1, 3]


def test_csv_with_line_breaks_in_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"Rev\nenue, a","b ""q"""\n1,"x\ny"\n2,\n3,4\n')
    got = {(r["row_no"], r["col_no"]): r["value"] for r in files.csv_cells(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): "Rev\nenue, a", (0, 1): 'b "q"', (1, 0): "1", (1, 1): "x\ny", (2, 0): "2", (3, 0): "3", (3, 1): "4"}


def test_json_lines_and_append(spark, tmp_path):
    path = str(tmp_path / "m")
    good = {"ticker": "A", "period": "2025-Q1", "structured": {"confidence": 0.5}}
    os.makedirs(path)
    with open(f"{path}/a.json", "w") as f:
        f.write(json.dumps(good) + "\n\n{broken\n" + json.dumps(good) + "\n")
    assert files.json_lines(spark, path).count() == 2
    assert files.json_lines_with_rejects(spark, path).cache().filter("_corrupt_record is not null").count() == 1
    entries = spark.createDataFrame([("B", "2025-Q2"), ("", "2025-Q2")], "ticker string, period string")
    left = files.append_valid(entries, qc.messages((F.col("ticker") == "", "no ticker")), path)
    assert left.count() == 1 and files.json_lines(spark, path).filter("ticker = 'B' and _written_at is not null").count() == 1


def test_files_and_output_sets(spark, tmp_path):
    place = tmp_path / "docs" / "aapl" / "2025-Q1" / "out"
    place.mkdir(parents=True)
    for n in ("r.pdf", "r.txt", "r-t10.csv", "r-t2.csv", "r-p1-1.png", "s.pdf"):
        (place / n).write_bytes(n.encode())
    tree = files.partition_tree(spark, str(tmp_path / "docs"))
    got = files.output_sets(tree).collect()
    assert len(got) == 1 and got[0]["ticker"] == "AAPL" and got[0]["table_files"] == ["r-t10.csv", "r-t2.csv"] and got[0]["image_files"] == ["r-p1-1.png"]
    assert files.binary_files(spark, str(tmp_path / "docs"), recursive=True).filter("file_size = 5").count() == 2
    assert files.json_object(spark, str(tmp_path / "none.json"), "a int").count() == 0
    df = spark.createDataFrame([("A", "2025-Q1", 1)], "ticker string, period string, n int")
    files.write_partitioned(df, str(tmp_path / "p"))
    files.write_results(df, str(tmp_path / "r"))
    assert os.path.isdir(tmp_path / "p" / "ticker=A" / "period=2025-Q1") and spark.read.json(str(tmp_path / "r")).columns[-1] == "timestamp"


def test_markdown_and_json_output(spark):
    md = "| a | b |\n|---|---|\n|--|--|\n\n| 1 |  | x y |"
    df = spark.createDataFrame([(md, 'note ```json\n{"a": {"b": 1}} ``` ')], "md string, js string")
    r = df.select(documents.markdown_to_csv(F.col("md")).alias("m"), documents.clean_json(F.col("js")).alias("j")).first()
    assert r["m"] == '"a","b"\n"1","x y"' and json.loads(r["j"]) == {"a": {"b": 1}}


def test_stream_skips_and_replays(spark, tmp_path):
    schema = "event_id long, user_id long, sha256 string, published string"
    rows = [(i, i % 3, f"h{i % 5}", f"2025-01-{(i * 7) % 28 + 1:02}") for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    drops, place = str(tmp_path / "drops"), str(tmp_path)
    df.filter("event_id < 40").repartition(3, "user_id").write.parquet(drops)
    run = lambda: sorted(
        map(tuple, stream_upsert(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(drops), place, "user_id", "event_id").collect())
    )
    after = lambda d: sorted(map(tuple, state.after_skips(d, "user_id", "event_id").collect()))
    first = run()
    assert first == after(df.filter("event_id < 40")) and sum(r[3] for r in first) < 40
    assert run() == first  # nothing new
    df.filter("event_id >= 40").coalesce(1).write.mode("append").parquet(drops)
    second = run()
    assert second == after(df)
    # the last batch was written but not committed: it runs again
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == second
    # the last accepted reports are sent again: nothing changes
    spark.createDataFrame([(900 + r[0], r[0], r[1], r[2]) for r in second], schema).coalesce(1).write.mode("append").parquet(drops)
    assert run() == second


def test_decisions(spark):
    arrivals = spark.createDataFrame(
        [(1, "a", "2025-02-01"), (2, "same", "2025-02-01"), (3, "new", "2025-01-01"), (4, "new", "2025-03-01"), (5, "new", "2024-01-01")],
        "k int, sha256 string, published string",
    )
    s = spark.createDataFrame([(2, "same", "2025-01-01"), (3, "old", "2025-02-01"), (4, "old", "2025-02-01"), (5, "old", None)], "k int, sha256 string, published string")
    got = {r["k"]: (r["process"], r["reason"].split(" ")[0]) for r in state.decide(arrivals, s, "k").collect()}
    assert got == {1: (True, "No"), 2: (False, "Same"), 3: (False, "Older"), 4: (True, "New"), 5: (True, "New")}


def test_validators(spark):
    df = spark.createDataFrame([("  " + "x" * 50,), (None,), ("quarter " * 20,)], "t string")
    got = [r["e"] for r in df.select(qc.text_outputs(F.col("t"), F.lit(0)).alias("e")).collect()]
    assert got == [["Text file too short: 50 chars"], ["Text file not found", "Neither meaningful text nor tables found - extraction may have failed"], []]


def test_anchors_of_all_spellings(spark):
    html = "<A HREF='/one'>1</A><a class=x href=/two>2</a><a name=\"y\">none</a><a\nhref = \"https://a/b?c='d'\"> <b>3</b>\n</a ><abbr href='no'>x</abbr>"
    pages = spark.createDataFrame([(1, "https://h.com/p/q", html), (2, "https://h.com", None)], "page_id long, url string, html string")
    got = [(r["ord"], r["href"], r["text"]) for r in links.page_links(pages).orderBy("ord").collect()]
    assert got == [(0, "/one", "1"), (1, "/two", "2"), (2, None, "none"), (3, "https://a/b?c='d'", "3")]
    assert [r["full"] for r in links.absolutised(links.page_links(pages)).orderBy("ord").collect()] == ["https://h.com/one", "https://h.com/two", "https://a/b?c='d'"]
    assert links.page_links(pages, 2).count() == 2


def test_nested_and_broken_pages(spark):
    html = "<div class='a'><div class='earnings'><span>Q2</span></div><a href='/x.pdf'>X<br>Y</a></div><p><a href=y.pdf>skip<div class='PDF'></p>"
    pages = spark.createDataFrame([(1, "https://h.com/p", html), (2, None, None)], "page_id long, url string, html string")
    got = [(r["pass"], r["url"], r["text"]) for r in links.pdf_candidates(pages).orderBy("ord").collect()]
    assert (1, "https://h.com/x.pdf", "XY") in got and (2, "https://h.com/x.pdf", "Q2") in got and (1, "y.pdf", "skip") not in got


def test_older_arrivals_over_spans(spark):
    rows = [(i, 1, f"2025-01-{(i * 7) % 28 + 1:02}") for i in range(80)] + [(i, 2, "2025-01-01") for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, k int, published string")
    one, many = (sorted(map(tuple, state.older_than_seen(df, "k", "event_id", n).collect())) for n in (1_000, 7))
    want, newest = [], {}
    for i, k, p in rows:
        if k in newest and p < newest[k]:
            want.append((i, k, p, newest[k]))
        newest[k] = max(newest.get(k, ""), p)
    assert one == many == sorted(want)


def test_best_report_of_ties(spark):
    rows = [(3, 1, "Form 10-Q Q2 2025", "https://a/1.pdf"), (2, 1, "Form 10-Q Q2 2025", "https://a/1.pdf"), (9, 1, "Form 10-Q Q2 2025", "https://a/0.pdf")]
    df = spark.createDataFrame(rows, "link_id long, company_id int, text string, url string")
    got = ranking.best_report(df, EngineParams()).collect()
    assert [(r["link_id"], r["url"]) for r in got] == [(2, "https://a/1.pdf")]
