"""The conversation trie against a trie of Python dicts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarterlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, block int, value string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def run(spark, rows):
    df = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def talk(rng, convs, letters, longest):
    rows = []
    for c in rng.sample(range(10 * convs), convs):
        for turn in range(rng.randint(0, longest)):
            rows.append((c, turn, rng.choice(["u", "ä", None]) if turn > 3 else "u", rng.choice(letters), 1, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "convs", "letters", "longest", "parts"), [(1, 60, "ab", 12, 9), (2, 150, "a", 14, 16), (3, 200, ["", "é", "xyz"], 9, 40), (4, 12, "ab", 5, 3)])
def test_trie_against_dicts(spark, seed, convs, letters, longest, parts):
    rows = talk(random.Random(seed), convs, letters, longest)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_odd_rows(spark):
    rows = [
        (None, 1, "u", "gone", 0, ""), (5, None, "u", "first", 0, ""), (5, 0, None, None, 0, ""), (5, 0, None, None, 0, ""), (6, 3, "u", "", 0, ""),
        (-3, 1, "u", "x" * 5000, 0, ""), (-5, 1, "u", "y", 0, ""), (10, None, None, None, 0, ""),
    ]
    rows = [(c, t, r, x, b, v) for c, t, r, x, b, v in rows if c is None or c >= 0]  # Python's % differs from SQL's below 0
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert [r[:6] for r in run(spark, [(7, t, "u", "t", 0, "") for t in range(2)])][0][:5] == (7, 0, -1, 1, 0 if zlib.crc32(b"7") % 9 > 1 else 1)


def test_hot_conversation_in_chunks(spark, monkeypatch):
    """Equal conversations that meet as several chunks have one hash over all their ids."""
    import pyarrow as pa

    ids = list(range(1000))
    batch = pa.RecordBatch.from_pydict({"conv_id": pa.array(ids), "marks": pa.array([b"m" * 16] * 1000), "sizes": pa.array([[3]] * 1000, pa.list_(pa.int32()))})
    monkeypatch.setattr(trie, "CHUNK", 100)
    chunks = list(trie._chunks(iter([batch.slice(0, 333), batch.slice(333)])))
    assert sum(b.num_rows for b in chunks) > 20
    assert ",".join(x for b in chunks for x in b["members"].to_pylist()) == ",".join(map(str, ids))


@pytest.mark.parametrize("seed", range(30))
def test_blocks_add_up(seed):
    """Nearest smaller values, runs of equal ones and ranges' least ones."""
    rng = random.Random(seed)
    values = [rng.randint(0, 5) for _ in range(rng.randint(1, 40))]
    for strict in (True, False):
        want = [next((j for j in range(i + 1, len(values)) if values[j] < values[i] or not strict and values[j] == values[i]), len(values)) for i in range(len(values))]
        assert trie.nearest_smaller(values, strict) == want
    least = trie.Least(values)
    for i, end in enumerate(trie.nearest_smaller(values)):
        assert trie.equal_runs(values, [1] * len(values))[i] == values[i:end].count(values[i])
        for j in range(i + 1, len(values) + 1):
            assert least.get(trie.np.array([i]), trie.np.array([j]))[0] == min(values[i:j])
