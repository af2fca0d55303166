import math
import random

import numpy as np

from quarterlens.llm.neighbours import MultiIndex, nearest


def brute(rows, step=100, k=10):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = answers(nearest(df))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0])) and q not in [i for i, _ in near]
        assert all(abs(s - np.linalg.norm(x[q] - x[i])) < 1e-9 for i, s in near)


def test_visiting_all_cells_is_exact_with_copies_and_odd_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(7)]) for i in range(300)]
    rows = [(i, rows[5][1] if i % 3 == 0 else v) for i, v in rows]  # one vector holds a third of all rows
    rows += [(1000, None), (1100, [0.0] * 7), (1200, [1.0, None] + [1.0] * 5), (1300, [math.nan] * 7), (1400, [math.inf] * 7), (None, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, block string")
    want, got = brute(rows), answers(nearest(df, share=1.0))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 2.5])], "vec_id long, embedding array<float>")
    assert answers(nearest(df)) == {0: [(7, 0.5)]}
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.filter("vec_id = 0")).count() == 0


def test_doubles_and_lengths(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5 if i % 7 else 3)]) for i in range(250)]
    rows += [(500, [1.0 + 1e-12, 2.0, 3.0]), (501, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.array(v + [0.0] * (5 - len(v))) for i, v in rows}
    got = answers(nearest(df, share=1.0))
    assert got.keys() == {0, 100, 200, 500}
    for q, near in got.items():
        want = sorted((float(np.sqrt(((x[q] - y) ** 2).sum())), i) for i, y in x.items() if i != q)[:10]
        assert [i for i, _ in near] == [i for _, i in want]
        assert all(abs(s - d) < 1e-15 + 1e-9 * d for (_, s), (d, _) in zip(near, want, strict=True))
    assert got[500][0][0] == 501 and 0 < got[500][0][1] < 1e-11


def test_cells_beyond_the_bound_hold_no_neighbour():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 20, (30, 6))
    x = np.unique((centres[rnd.integers(0, 30, 3_000)] + rnd.normal(0, 1, (3_000, 6))).astype(np.float32), axis=0).astype(float)
    index = MultiIndex(x[::10], 8)
    cells = index.cell(x)
    counts = np.bincount(cells, minlength=index.cells)
    spread = index.spread(x, cells)
    index.radii = np.array([spread[cells == c].max() if counts[c] else 0.0 for c in range(index.cells)])
    left = 0
    for q in x[::50]:
        near = np.argsort(((x - q) ** 2).sum(1))[:11]
        every = index.traverse(q, counts.tolist(), np.inf)
        some = index.traverse(q, counts.tolist(), np.inf, index.bound(q, 11))
        assert set(cells[near]) <= set(some) <= set(every) and len(every) == (counts > 0).sum()
        left += counts[some].sum()
    assert left < 0.5 * len(x) * len(x[::50])


def test_bounds_hold_in_single_precision():
    rnd = np.random.default_rng(8)
    for scale, shift in ((1.0, 0.0), (1e-4, 1.0), (1e-4, 1000.0), (50.0, 0.0)):
        x = (rnd.normal(0, scale, (400, 16)) + shift).astype(np.float32).astype(float)
        index = MultiIndex(x, 4)
        for q in x[:20]:
            assert index.bound(q, 11) >= np.sort(np.sqrt(((x - q) ** 2).sum(1)))[10]
    huge = rnd.normal(0, 1e30, (50, 4))
    with np.errstate(all="ignore"):
        assert MultiIndex(huge, 2).bound(huge[0], 5) == np.inf
