"""The quality classifier: held-out labels, the prior's bound, statistics against plain Python, odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarterlens.llm import quality as Q
from quarterlens.llm.common import table


def test_held_out_labels(spark):
    out = Q.op12_quality(spark, "/root/testdata/sf0.01")
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id", "left").collect()
    assert len(rows) == table(spark, "/root/testdata/sf0.01", "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r.predicted for r in held if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.92 and np.mean(bad) < 0.08


def plain(text: str) -> list[float]:
    words = re.split("[ \t-\r]+", text.strip(" \t\n\v\f\r")) if text.strip(" \t\n\v\f\r") else []
    n, lines = max(len(words), 1), [x for x in text.split("\n") if x]
    size = len(text.encode())
    letters = sum(c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
    upper, wide = sum("A" <= c <= "Z" for c in text), sum(ord(c) > 127 for c in text)
    marks = [text.count(chr(c)) for c in Q._PUNCTUATION]
    shout = [w for w in words if sum("A" <= c <= "Z" for c in w) > 1 and not re.search("[a-z]", w)]
    triples = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    return [
        np.log1p(size), np.log1p(n), upper / (letters + 1), np.sqrt(sum(c in "0123456789" for c in text) / n), np.sqrt(text.count("\n") / n), wide / (letters + wide + 1),
        np.sqrt(sum(marks) / n), np.sqrt(len(shout) / n), sum(ord(w[-1]) in Q._PUNCTUATION for w in words) / n, np.log1p(max(size - n, 0) / n),
        np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), len(set(words)) / n**0.9, max(Counter(words).values(), default=0) / n,
        len(triples) / (len(words) - 2) if len(words) > 2 else 1, max(len(set(lines)), 1) / max(len(lines), 1), np.log1p(n / (sum(map(text.count, ".!?")) + 1)),
        *(np.sqrt(m / n) for m in marks),
    ]


def test_statistics_against_plain_python():
    texts = ["", " ", "a", "A B! C?", "Ünï côdé 日本。\n\nline\nline", "x x x y x x x", "\n", "one\ttwo  three\r\nfour", "SHOUT!! LOUD!! a b c a b c", "end ", " 1,234.5 %$#", "w" * 70_000 + " " + "w v " * 9000]
    for batch in (texts, texts[::-1], ["", "", "q"], [""]):
        got = Q.statistics(pa.array(batch, pa.string()))
        assert np.allclose(got, [plain(t) for t in batch], atol=1e-5)
    sliced = pa.array(texts, pa.string())[3:7]
    assert np.allclose(Q.statistics(sliced), [plain(t) for t in texts[3:7]], atol=1e-5)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_mixtures(prior):
    rng = np.random.default_rng(1)
    good = lambda n: np.clip(rng.normal(0.7, 0.1, n), 0, 0.999)
    bad = lambda n: np.clip(rng.normal(0.35, 0.1, n), 0, 0.999)
    counts = lambda x: np.bincount((x * Q.BINS).astype(int), minlength=Q.BINS)
    n = 20_000
    found = Q.class_prior(counts(good(5000)), counts(np.concatenate([good(int(prior * n)), bad(n - int(prior * n))])))
    assert abs(found - prior) < 0.05


def test_risk_is_non_negative_and_its_slope_right():
    """The risk against its definition row by row, and its gradient against differences."""
    rng = np.random.default_rng(2)
    d, prior = 3, 0.6
    scale = Q.Scale(1, np.zeros(d), np.ones(d))
    x, trusted = rng.normal(size=(300, d)), rng.random(300) < 0.3
    risk = Q.non_negative_risk(prior)

    def at(w):
        of_batch, width = Q._losses([w], scale)
        parts = of_batch(x, trusted)
        assert len(parts) == width
        p, u = parts.reshape(2, -1)
        return risk(Q.Sums(p, d + 1), Q.Sums(u, d + 1), w)

    for _ in range(5):
        w = rng.normal(size=d + 1) / 2
        g = np.column_stack([np.clip(x, -8, 8), np.ones(300)]) @ w
        loss = lambda z: np.log1p(np.exp(-z))
        inside = loss(-g[~trusted]).mean() - prior * loss(-g[trusted]).mean()
        assert np.isclose(at(w)[0], prior * loss(g[trusted]).mean() + max(0, inside))
        if inside > 0:
            steps = np.eye(d + 1) * 1e-5
            assert np.allclose([(at(w + s)[0] - at(w - s)[0]) / 2e-5 for s in steps], at(w)[1], atol=1e-5)


def test_odd_tables(spark):
    docs = "text string, doc_id long, x string, held_out string, trusted int"
    rows = [("fine words here. " * 9, 1, "", "", 0), ("BAD!! " * 50, 1, "", "", 0), (None, None, "", "", 0), ("", 2, "", "", 0), ("z " * 400_000, 3, "", "", 0)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = Q.quality(spark.createDataFrame(rows, docs), labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id is None} == {r.score for r in out if r.doc_id == 2}
    assert {r.score for r in Q.quality(spark.createDataFrame(rows, docs), labels.limit(0)).collect()} == {0.5}
    assert Q.quality(spark.createDataFrame([], docs), labels).collect() == []
