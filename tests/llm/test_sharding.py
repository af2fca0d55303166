import zlib

from quarterlens.llm.sharding import SHARDS, assign_shards, op10_sharding


def check(rows, out, overhead=16):
    size = lambda t: len((t or "").encode()) + overhead
    assert len(out) == len(rows)
    total, largest = sum(size(t) for _, t in rows), max((size(t) for _, t in rows), default=0)
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r)
    last = None
    for s in sorted(shards):
        own = sorted(shards[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
        assert abs(sum(r["size"] for r in own) - total / SHARDS) <= largest
    assert set(shards) <= set(range(SHARDS))


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op10_sharding(spark, sf).collect()
    check(rows, out)
    by_id = {r["doc_id"]: r for r in out}
    for i, t in rows:
        assert by_id[i]["size"] == len((t or "").encode()) + 16 and by_id[i]["text_crc32"] == zlib.crc32((t or "").encode())
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    assert len({r["shard"] for r in out}) == SHARDS


def test_odd_tables(spark):
    rows = [(5, "x")] * 300 + [(None, None), (7, ""), (8, "é" * 5_000), (9, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, size int, shard int").repartition(4)
    check(rows, assign_shards(df).collect())
    assert assign_shards(df.limit(0)).count() == 0
