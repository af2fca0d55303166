import hashlib
import random

import numpy as np
import pyarrow as pa

from quarterlens.llm.repeats import _ASKED, _REMOVE, _ROW, LENGTH, _cut, remove_repeats, repeated_windows


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            if w in seen:
                gone[p : p + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in remove_repeats(df).drop("kept").collect())


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_passages_periods_and_lengths(spark):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("ab é") for _ in range(n))
    passages = [text(n) for n in (60, 99, 100, 101, 130, 300, 700)]
    rows = []
    for i in range(120):
        rows.append((i, text(rnd.randint(0, 250)) + rnd.choice(passages) + text(rnd.randint(0, 80)) + rnd.choice(passages)))
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 101), (205, "it " * 3_000), (206, "it " * 900), (207, text(5_000) * 2)]
    rows += [(-5, rows[3][1]), (300, rows[7][1]), (301, rows[7][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "a", 0) for r in rows], "doc_id long, text string, data string, kind int").repartition(5)
    assert result(df) == brute(rows)


def test_repeated_doc_ids_and_empty_table(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choice("abcdefgh") for _ in range(500))
    rows = [(1, t), (1, t), (2, t[:200]), (2, t[100:300] + "zz"), (None, t[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in remove_repeats(df).select("doc_id", "n_bytes", "n_removed").collect()]
    assert sorted(got, key=repr) == sorted([(None, 150, 0), (1, 500, 150), (1, 500, 150), (2, 200, 200), (2, 202, 200)], key=repr)
    assert remove_repeats(df.limit(0)).count() == 0


def test_text_longer_than_a_slice(spark):
    rnd = np.random.default_rng(3)
    t = rnd.integers(97, 123, 5_000_000, dtype=np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, t), (2, t[1_000_000:4_500_000]), (3, t[2_097_000:2_097_400])], "doc_id long, text string")
    got = sorted(tuple(r) for r in remove_repeats(df).select("doc_id", "n_removed", "n_spans").collect())
    assert got == [(1, 0, 0), (2, 3_500_000, 1), (3, 400, 1)]


def test_passes_end_with_equal_windows():
    rnd = np.random.default_rng(4)
    data = rnd.integers(97, 99, 4_000, dtype=np.uint8)
    data[3_000:3_400] = data[100:500]
    at = np.arange(len(data) - LENGTH + 1)
    index, group = repeated_windows(np.zeros(len(at), np.int64), at, np.append(data, np.zeros(8, np.uint8)))
    raw, where = data.tobytes(), {}
    for p in at.tolist():
        where.setdefault(raw[p : p + LENGTH], []).append(p)
    want = sorted(v for v in where.values() if len(v) > 1)
    assert sorted(sorted(index[group == g].tolist()) for g in np.unique(group)) == want


def test_more_texts_of_a_doc_id_than_16_bits_count():
    text = bytes(random.Random(2).choices(range(97, 123), k=120))
    columns = [pa.array([7, 7], pa.int64()), pa.array([4464, 70_000], pa.int32()), pa.array([text, text], pa.binary())]
    (moved,) = _cut(8)([pa.RecordBatch.from_arrays(columns, names=["doc_id", "alt", "text"])])
    gone = [r for r in moved.to_pylist() if r["kind"] == _REMOVE]
    assert [(r["doc_id"], r["alt"]) for r in gone] == [(7, 70_000)]
    rows = np.zeros(1, _ROW)
    rows["gram"], rows["alt"], rows["start"], rows["n"] = 5, 70_000, 123_456, 77
    asked = np.frombuffer(rows[["gram", "start", "n"]].tobytes(), _ASKED)
    assert asked.tolist() == [(5, 123_456, 77)] and rows["alt"][0] == 70_000


def test_anchors_with_many_stretches_are_split(spark):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    passage = text(130)
    rows = [(i, text(rnd.randint(0, 90)) + passage + text(rnd.randint(0, 90))) for i in range(200)]
    rows += [(i, text(60) + passage[5:125] + text(60)) for i in range(200, 260)] + [(5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(dict(rows).items())
    for hot in (3, 1_000):
        got = sorted(tuple(r) for r in remove_repeats(df, hot).drop("kept").collect())
        assert sorted(set(got)) == want and len(got) == len(rows)


def test_the_least_doc_id_is_no_missing_one(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choice("abcdefgh") for _ in range(300))
    rows = [(-(1 << 63), t), (-(1 << 63), t[:120]), (None, t[50:250]), (None, t[50:250])]
    got = [tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect()]
    first = {n: g for d, n, g in got if d is not None}
    assert [(d, n, g) for d, n, g in got if d is None] == [(None, 200, 0)] * 2 and first.keys() == {300, 120}
    assert (first[300], first[120]) in {(200, 120), (250, 0)}  # whichever of the two comes first
