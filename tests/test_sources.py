"""Versioned tables and the report tree: crashes, races, backups, pruning, aborts."""

import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

from quarterlens.sources import files, report_tree
from quarterlens.sources.versioned import VersionedTable

SCHEMA = "name string, n long, extra string"


def rows(spark, *values):
    return spark.createDataFrame([(*v, "x")[:3] if len(v) == 2 else v for v in values], SCHEMA)


def held(df):
    return sorted(((r.name, r.n) for r in df.collect()), key=str)


@pytest.fixture
def versioned(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/table", "name")


def test_puts_and_versions(spark, versioned):
    assert versioned.empty() and versioned.versions() == []
    assert versioned.put(rows(spark, ("a", 1), ("b", 2), (None, 3), ("a", 5))) == 1
    assert versioned.put(rows(spark, ("b", 7), (None, 8)), ["n"]) == 2
    assert versioned.put(rows(spark, ("c", None), ("c", 1))) == 3
    assert versioned.put(rows(spark).limit(0)) == 4
    assert held(versioned.read()) == [("a", 5), ("b", 7), ("c", 1), (None, 8)] == held(versioned.read(4))
    assert held(versioned.read(1)) == [("a", 5), ("b", 2), (None, 3)]
    assert held(VersionedTable(spark, versioned.root).read(2)) == [("a", 5), ("b", 7), (None, 8)]
    with pytest.raises(ValueError):
        versioned.put(rows(spark, ("a", 1)).drop("extra"))


def test_a_crash_before_the_version_changes_nothing(spark, versioned, monkeypatch):
    versioned.put(rows(spark, ("a", 1)))
    before = held(versioned.read())

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(VersionedTable, "_put_if_absent", crash)
    with pytest.raises(OSError):
        versioned.put(rows(spark, ("a", 2), ("b", 2)))
    monkeypatch.undo()
    assert held(versioned.read()) == before and versioned.versions() == [1]
    assert versioned.clean(grace=0)[1] >= 1  # what the crash left
    assert held(versioned.read()) == before
    assert versioned.put(rows(spark, ("b", 3))) == 2


def test_a_writer_that_comes_second_starts_over(spark, versioned, monkeypatch):
    versioned.put(rows(spark, ("a", 1), ("b", 1)))
    plain, other = VersionedTable._put_if_absent, []

    def overtaken(self, name, content):
        if name.startswith("log/") and not other:
            other.append(1)
            VersionedTable(spark, versioned.root, "name").put(rows(spark, ("b", 2)))
        return plain(self, name, content)

    monkeypatch.setattr(VersionedTable, "_put_if_absent", overtaken)
    assert versioned.put(rows(spark, ("a", 3), ("c", 3))) == 3
    assert held(versioned.read()) == [("a", 3), ("b", 2), ("c", 3)]


def test_backups_and_cleaning(spark, versioned):
    for k in range(6):
        versioned.put(rows(spark, ("a", k), (f"k{k}", k)))
        if k == 2:
            assert versioned.pin("third") == 3
    with pytest.raises(ValueError):
        versioned.pin("third", 1)
    was = held(versioned.read_pin("third"))
    versions, _ = versioned.clean(keep=2, grace=0)
    assert versions == 3 and versioned.versions() == [3, 5, 6]
    assert held(versioned.read_pin("third")) == was == [("a", 2), ("k0", 0), ("k1", 1), ("k2", 2)]
    assert len(versioned.read(5).collect()) == 6 and versioned.pins() == {"third": 3}
    versioned.unpin("third")
    versioned.clean(grace=0)
    assert versioned.versions() == [6] and held(versioned.read())[0] == ("a", 5)


def test_reads_cost_keys_not_puts(spark, versioned):
    for k in range(12):
        versioned.put(rows(spark, *[(f"k{i}", k) for i in range(8)]))
    folders = versioned._latest()["folders"]
    assert sum(f["rows"] for f in folders) <= 16 and len(versioned.read().collect()) == 8


def test_a_writers_numbers(spark, versioned):
    assert versioned.put(rows(spark, ("a", 1)), writer="w", number=0) == 1
    assert versioned.put(rows(spark, ("a", 9)), writer="w", number=0) == 1
    assert versioned.put(rows(spark, ("a", 2)), writer="v", number=0) == 2
    assert versioned.put(rows(spark, ("a", 3)), writer="w", number=1) == 3
    assert held(versioned.read()) == [("a", 3)]


def test_objects_that_come_twice(spark, tmp_path):
    schema = "name string, content binary, content_type string, metadata map<string,string>"
    put = lambda *c: files.put_objects(spark.createDataFrame([("x", bytes(v, "ascii"), "t", {}) for v in c], schema), str(tmp_path))
    assert put("b", "a").count() == 1
    put("c")
    assert [bytes(r.content) for r in files.get_objects(spark, str(tmp_path)).collect()] == [b"c"]
    assert [bytes(r.content) for r in files.get_objects(spark, str(tmp_path), 1).collect()] == [b"b"]


# -- the report tree --


def reports(spark, *values):
    made = [(t, p, r, None, text, [("one", "a\n1"), ("two", None)], [("i/x", b"\x00\x01")], '{"b": 1, "a": 2}') for t, p, r, text in values]
    return spark.createDataFrame(made, report_tree.REPORTS)


def test_reports_as_files(spark, tmp_path):
    root = str(tmp_path / "tree")
    files.write_layout(reports(spark, ("aapl", "2025-Q1", "r", "text é"), ("aapl", "2025-Q2", "s", " "), ("msft", "2025-Q1", "r", None)), root)
    found = {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names}
    one = {"tables/{}-t1.csv", "tables/{}-t2.csv", "images/{}-p1-i_x.png", "metadata/{}.json"}
    want = {f"{place}/{f.format(r)}" for place, r in (("aapl/2025-Q1", "r"), ("aapl/2025-Q2", "s"), ("msft/2025-Q1", "r")) for f in one}
    assert found == want | {"aapl/2025-Q1/text/r.txt"}
    back = files.read_layout(spark, root)
    assert {(r.ticker, r.kind, bytes(r.content)) for r in back.filter("period = '2025-Q1' AND kind IN ('text', 'metadata')").collect()} == {
        ("AAPL", "text", "text é".encode()), ("AAPL", "metadata", b'{"a": 2, "b": 1}'), ("MSFT", "metadata", b'{"a": 2, "b": 1}')
    }
    assert back.filter("report = 's'").count() == 4 and {r.report for r in back.collect()} == {"r", "s"}
    files.write_layout(reports(spark, ("aapl", "2025-Q1", "r", "new")), root)  # replaces its files, leaves the others
    assert back.count() == 13 and bytes(back.filter("kind = 'text'").first().content) == b"new"


def test_other_folders_are_not_listed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    files.write_layout(reports(spark, *[(t, f"2025-Q{q}", "r", "x") for t in ("aapl", "msft", "ibm") for q in (1, 2)]), root)
    wanted = files.read_layout(spark, root).filter((F.col("ticker") == "MSFT") & F.col("period").isin("2025-Q2", "2025-Q3"))
    plan = spark._jvm.PythonSQLUtils.explainString(wanted._jdf.queryExecution(), "formatted")
    assert "EqualTo(ticker,MSFT)" in plan and "In(period" in plan
    assert {(r.ticker, r.period) for r in wanted.collect()} == {("MSFT", "2025-Q2")}
    listed = []
    plain = report_tree._folders
    monkeypatch.setattr(report_tree, "_folders", lambda store, at: listed.append(at) or plain(store, at))
    reader = report_tree.ReportReader(root, [])
    left = list(reader.pushFilters([report_tree.EqualTo(("ticker",), "MSFT"), report_tree.EqualTo(("kind",), "text"), report_tree.In(("period",), ("2025-Q2", "2025-Q3"))]))
    assert [f.attribute for f in left] == [("kind",)]
    assert [(f.ticker, f.period) for f in reader.partitions()] == [("msft", "2025-Q2")]
    assert [os.path.basename(x) for x in listed] == ["tree", "msft"]


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    root = tmp_path / "tree"
    good = reports(spark, *[("aapl", "2025-Q1", f"r{i}", "x") for i in range(20)])
    with pytest.raises(Exception, match="not a name"):
        files.write_layout(good.unionByName(reports(spark, ("aapl", "2025-Q1", "../bad", "x"))).repartition(3), str(root))
    assert not [f for _, _, names in os.walk(root) for f in names] and not (root / "_staging").exists()
    files.write_layout(good, str(root))
    assert files.read_layout(spark, str(root)).count() == 100 and not (root / "_staging").exists()
    empty = tmp_path / "none"
    assert files.read_layout(spark, str(empty)).count() == 0


def test_whole_texts_of_several_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r.text for r in files.whole_texts(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo\n"]


def test_whole_texts_are_listed_and_read_in_tasks(spark, tmp_path):
    """What Spark's own reader reads, without a list of the files in the driver."""
    root = tmp_path / "a b"
    for name in ("flat/a.txt", 'flat/ü %20[#?"{}^`|\\<>].txt', "flat/\x7f\xa0\u2003\u2028\u3000\u200b.txt", "flat/.h.txt", "flat/_h.txt", "flat/_SUCCESS", "keyed/k=1/b.txt", "keyed/k=2/l=x/b.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"\xef\xbb\xbfone\r\n\xff\x00" + name.encode())
    (root / "flat/empty.txt").touch()
    for at, n in (("flat", 3), ("keyed/k=2", 1)):
        own = spark.read.text(str(root / at), wholetext=True).selectExpr("_metadata.file_path AS path", "hex(value) AS text").collect()
        for form in (f"{root / at}", f"{root / at}/", f"file:{root / at}", f"file://{root / at}"):
            found = files.whole_texts(spark, form)
            assert not [f for f in found.inputFiles() if f.endswith(".txt")]
            assert sorted(map(tuple, found.selectExpr("path", "hex(text)").collect())) == sorted(map(tuple, own)) and len(own) == n
    root = root / "flat"
    assert files.whole_texts(spark, str(tmp_path / "a b/keyed")).count() == 2
    (root / "inner").mkdir()
    (root / "inner/c.txt").write_text("c")
    assert files.whole_texts(spark, str(root)).count() == 3 and files.whole_texts(spark, str(root / "inner")).count() == 1
    (tmp_path / "none").mkdir()
    assert files.whole_texts(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.whole_texts(spark, str(tmp_path / "no")).count()


def test_the_driver_gets_no_list_of_files(spark, tmp_path):
    """What a task sends to the driver doesn't grow with its files, and the last task's file of a place stays."""
    rows = reports(spark, *[("aapl", "2025-Q1", f"r{i}", "x") for i in range(50)]).collect()
    sizes = []
    for n in (1, 50):
        writer = report_tree.ReportWriter(str(tmp_path / "tree"))
        sizes.append(len(pickle.dumps(writer.write(iter(rows[:n])))))
        writer.abort([])
    assert sizes[0] == sizes[1] and not (tmp_path / "tree" / "_staging").exists()


@pytest.mark.parametrize("by_tasks", [True, False])
def test_places_that_come_twice(spark, tmp_path, by_tasks):
    root = str(tmp_path / "tree")
    parts = [reports(spark, ("aapl", "2025-Q1", "r", t), ("aapl", "2025-Q1", "r", f"{t}{t}")).coalesce(1) for t in ("b", "c", "a")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if by_tasks:
        files.write_layout(every, root)
    else:
        report_tree.register(spark)
        every.write.format("report_tree").mode("append").option("path", root).save()
    back = files.read_layout(spark, root).filter("kind = 'text'").collect()
    assert [bytes(r.content) for r in back] == [b"aa"] and not (tmp_path / "tree" / "_staging").exists()


def test_moves_that_died_are_made_by_another_run(spark, tmp_path):
    root = tmp_path / "tree"
    report_tree.register(spark)
    every = reports(spark, *[("aapl", "2025-Q1", f"r{i}", "x") for i in range(20)]).repartition(3)
    every.write.format("report_tree").mode("append").option("path", str(root)).option("job", "j").save()
    assert files.read_layout(spark, str(root)).count() == 0
    store, at = report_tree.open_store(str(root))
    attempt = json.loads((root / "_staging/j/committed").read_text())[1]
    some = list(report_tree._places(store, at, "j", attempt))[::2]
    for place in some:
        report_tree._move(store, f"{at}/_staging/j/{attempt}/{place}", f"{at}/{place}", set())
    report_tree.finish(spark, str(root), "j")
    assert files.read_layout(spark, str(root)).count() == 100 and not (root / "_staging").exists()


def test_files_are_listed_in_tasks(spark, tmp_path):
    """A listing reads no file of the tree, nor its list in the driver, and has what Spark's own reader has."""
    root = tmp_path / "a b" / "tree"
    for name in ("a/2025-Q1/r.pdf", "a/2025-Q1/text/r.TXT", "a/_x/s.txt", "a/_y=1/s.txt", "ab/tree/t-1.csv", "b/.h/u.txt", "b/v", "w.txt", "_SUCCESS", "_metadata"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "empty").mkdir()
    own = {(r.path, r.length, r.modificationTime) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).collect()}
    assert {(r.path, r.size, r.updated) for r in files.tree_files(spark, str(root)).collect()} == own and len(own) == 6
    for form in (f"{root}/", f"file:{root}", f"file://{root}"):
        every = files.listing(spark, form)
        assert not [f for f in every.inputFiles() if f.startswith(f"file://{str(root).replace(' ', '%20')}")]
        assert {(r.name, r.extension) for r in every.collect()} == {
            ("a/2025-Q1/r.pdf", "pdf"), ("a/2025-Q1/text/r.TXT", "txt"), ("a/_y=1/s.txt", "txt"), ("ab/tree/t-1.csv", "csv"), ("b/v", ""), ("w.txt", "txt")
        }
    names = lambda *more: {r.name for r in files.listing(spark, str(root), *more).collect()}
    assert names("a") == {"a/2025-Q1/r.pdf", "a/2025-Q1/text/r.TXT", "a/_y=1/s.txt", "ab/tree/t-1.csv"} and names("a/2025-Q1/t") == {"a/2025-Q1/text/r.TXT"}
    assert names("", "?.{txt,pdf}") == {"a/2025-Q1/r.pdf", "a/_y=1/s.txt", "w.txt"} and names("a/", "*.pdf") == {"a/2025-Q1/r.pdf"}
    assert files.listing(spark, str(root / "w.txt")).count() == 1 and files.listing(spark, str(root / "empty")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.listing(spark, str(root / "none")).count()


def test_output_sets_hold_no_list_in_the_driver(spark, tmp_path):
    files.write_layout(reports(spark, ("aapl", "2025-Q1", "r", "x")), str(tmp_path / "tree"))
    (tmp_path / "tree/aapl/2025-Q1/r.pdf").write_text("%PDF")
    found = files.output_sets(files.partition_tree(spark, str(tmp_path / "tree")))
    assert not [f for f in found.inputFiles() if "/tree/" in f]
    assert [(r.text_file, r.table_files, r.image_files) for r in found.collect()] == [("r.txt", ["r-t1.csv", "r-t2.csv"], ["r-p1-i_x.png"])]


def test_partition_tree_is_listed_in_tasks(spark, tmp_path):
    root = tmp_path / "t" / "t"  # the folder's own name comes again in its path and below it
    for name in ("aapl/2025-Q1/a/b/c.txt", "t/t/t/d.pdf", ".x/2025-Q1/e.txt", "msft/f.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    tree = files.partition_tree(spark, str(root))
    assert not [f for f in tree.inputFiles() if f.endswith((".txt", ".pdf"))]
    assert {(r.ticker, r.period, r.filename, r.length) for r in tree.collect()} == {("AAPL", "2025-Q1", "c.txt", 22), ("T", "t", "d.pdf", 11)}
    assert {r.path for r in tree.collect()} == {f"file:{root}/aapl/2025-Q1/a/b/c.txt", f"file:{root}/t/t/t/d.pdf"}


def test_partition_tree_sends_no_names_to_the_driver(spark, tmp_path):
    """What the tasks of the whole query, write and moves included, send to the driver doesn't grow with its files."""
    import __spark_entry__

    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def sent() -> dict[int, int]:
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, quantiles, spark._jvm.java.util.ArrayList())
        return {s.stageId(): s.resultSize() for s in map(stages.apply, range(stages.size()))}

    found = []
    for n in (60, 3000):
        made = spark.range(0, n, 1, 1).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "concat('src', id % 2) AS source", "1L AS n_chars")
        made.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        before = sent()
        rows = __spark_entry__.queries()["partition_tree"](spark, f"{tmp_path}/{n}")
        rows.write.format("noop").mode("overwrite").save()
        found.append((sum(size for k, size in sent().items() if k not in before), rows.count()))
    (few, some), (many, more) = found
    assert more > 40 * some and many - few < more - some, found  # less than a byte a file


@pytest.mark.parametrize("name", ["pruned_layout", "whole_texts"])
def test_queries_move_their_files_in_tasks(spark, sf, monkeypatch, name):
    import __spark_entry__

    jobs, plain = [], report_tree.finish
    monkeypatch.setattr(report_tree, "finish", lambda *a: jobs.append(a[2]) or plain(*a))
    assert __spark_entry__.queries()[name](spark, sf).count() > 0 and len(jobs) == 1


@pytest.mark.parametrize("name", ["output_sets", "partition_tree", "pruned_layout"])
def test_queries_need_no_data_source(spark, sf, monkeypatch, name):
    """Writing and planning a data source in Python keeps processes of 30 MB each beside the driver."""
    import __spark_entry__

    made, plain = [], report_tree.register
    monkeypatch.setattr(report_tree, "register", lambda s: made.append(s) or plain(s))
    assert __spark_entry__.queries()[name](spark, sf).count() > 0 and not made


def test_some_folders_as_the_data_source_reads_them(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    files.write_layout(reports(spark, *[(t, f"2025-Q{q}", "r", "x") for t in ("aapl", "msft", "ibm") for q in (1, 2)]), root)
    listed, plain = [], report_tree._folders
    monkeypatch.setattr(report_tree, "_folders", lambda store, at: listed.append(at) or plain(store, at))
    found = files.read_folders(spark, root, ["MSFT", "IBM"], ["2025-Q2", "2025-Q3"])
    assert {os.path.basename(x) for x in listed} == {"tree", "msft", "ibm"}
    own = files.read_layout(spark, root).filter("ticker IN ('MSFT', 'IBM') AND period IN ('2025-Q2', '2025-Q3')")
    assert found.schema == own.schema and sorted(map(str, found.collect())) == sorted(map(str, own.collect())) and found.count() == 10
    assert files.read_folders(spark, root, ["X"], ["2025-Q1"]).count() == 0 == files.read_folders(spark, f"{root}/none", ["X"], ["2025-Q1"]).count()
