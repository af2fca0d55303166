import hashlib
import random

import numpy as np

from quarterlens.llm.exact_dedup import LEAST, MOST, cut_points, exact_duplicates, keep_one


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def check(rows, result):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    got = {r["doc_id"]: r for r in result.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        g = groups[lower(t)]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), i == max(g))
        assert r["text_sha256"] == hashlib.sha256(lower(t).encode()).hexdigest()


def odd_rows():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdé ÄX") for _ in range(n)) for n in (0, 5, 700, 3_000, 90_000)]
    texts = [rnd.choice(base) for _ in range(60)] + [None, "", "ABC", "abc", "ÄBC", "äbc", base[4] + "x", base[4][:-1], base[4].upper()]
    return list(enumerate(texts))


def test_odd_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "r", 5) for i, t in odd_rows()], "doc_id long, text string, recipe string, row int").repartition(6)
    check(odd_rows(), exact_duplicates(df))


def test_names_that_clash_are_told_apart(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(3)
    check(odd_rows(), exact_duplicates(df, bits=3))


def test_repeated_rows_empty_table_and_keep_one(spark):
    rows = [(1, "A"), (1, "a"), (0, "a"), (2, "b"), (None, "b"), (2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_duplicates(df).collect()
    assert sum(r["kept"] for r in got) == 3 and len(got) == 6
    assert sorted((r["doc_id"], r["text"].lower()) for r in keep_one(df).collect()) == [(1, "a"), (2, "b"), (2, "c")]
    assert exact_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_cuts_depend_on_content_only():
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 123, 60_000, dtype=np.uint8)
    alone = cut_points(text, np.array([0, len(text)]))[0]
    after = cut_points(np.concatenate([text[:777], text]), np.array([0, 777, 777 + len(text)]))[1]
    assert alone == after and alone[-1] == len(text)
    sizes = np.diff([0, *alone])
    assert sizes[:-1].min() >= LEAST and sizes.max() <= MOST
    moved = cut_points(np.concatenate([text[:100], text]), np.array([0, len(text) + 100]))[0]
    assert len({c - 100 for c in moved} & set(alone)) > len(alone) // 2


def test_keep_one_leaves_the_last_of_rows_that_tie(spark):
    rows = [(1, "A", 1), (1, "a", 2), (1, "a", 3), (0, "a", 4), (None, "b", 5), (None, "B", 6), (None, None, 7), (3, "", 8), (3, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").coalesce(1)
    for _ in range(3):
        assert sorted(r["row"] for r in keep_one(df).collect()) == [3, 6, 8, 9]
