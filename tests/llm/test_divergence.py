"""The divergence audit against sums over all terms, and the radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quarterlens.llm import divergence

SCHEMA = "term string, source string, lang string, text string, n long, p long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, ranks=200):
    lower = {c: c + 32 for c in range(65, 91)}
    groups, df, langs = defaultdict(Counter), Counter(), defaultdict(set)
    for _, source, lang, text, *_ in rows:
        words = Counter(TERM.findall((text or "").translate(lower)))
        groups[lang or "", source or ""] += words
        langs[lang or ""].add(source or "")
        df.update((lang or "", w) for w in words)
    kept = defaultdict(list)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].append(w)
    out = []

    def share(counts, terms):
        total = sum(counts[w] for w in terms) + len(terms)
        return {w: 1 + 10**9 * (counts[w] + 1) // total for w in terms}

    for lang, sources in langs.items():
        terms = kept[lang]
        q = share(sum((groups[lang, s] for s in sources), Counter()), terms)
        p = {s: share(groups[lang, s], terms) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in terms), t.encode()) for t in sources if t != s]
            words = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in terms if groups[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(words)[:ranks])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


def run(spark, rows, **more):
    df = divergence.audit(spark.createDataFrame(rows, SCHEMA), **more)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_audit_against_all_terms(spark):
    rng = random.Random(4)
    words = ["A", "b", "Été", "été", "ÉTÉ", "日本", "x1y", "don't", "zz", "\x7fq", "a b", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [("t", rng.choice(["s1", "s2", "s3", "", None]), rng.choice(["x", "y", None]), " ".join(rng.choices(words, k=rng.randint(0, 30))), 1, 2) for _ in range(150)]
    rows += [("t", "lonely", "x", "", 1, 2), ("t", "none", "z", "one two", 1, 2), ("t", "none2", "z", None, 1, 2), ("t", "s1", "x", "b " * 30000, 1, 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, ranks=3) == brute(rows, ranks=3)
    assert run(spark, []) == []


def test_joins_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = [("t", f"s{i % 7}", "x", f"one two {chr(97 + i % 5) * 3}", 1, 2) for i in range(40)]
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("seed", "few"), [(1, 1), (2, 1), (3, 5)])
def test_radix_selection(spark, seed, few):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        pool = [rng.choice([0, 1, 7, 1 << 20, (1 << 59) + 5, (1 << 59) + 6, 12345]) for _ in range(rng.choice([3, 60, 90]))]
        rows += [("l", f"g{g}", "common" * 3 + "".join(rng.choices("abé", k=6)) + chr(97 + i % 26) * (i // 26), v) for i, v in enumerate(pool)]
    rows = list({(a, b, c): (a, b, c, d) for a, b, c, d in rows}.values())
    got = divergence.top_ranked(spark.createDataFrame(rows, "lang string, source string, item string, value long"), 11, few)
    want = []
    for g in {r[1] for r in rows}:
        best = sorted((-v, i.encode()) for _, s, i, v in rows if s == g)[:11]
        want += [("l", g, i.decode(), -v, k + 1) for k, (v, i) in enumerate(best)]
    assert sorted(map(tuple, got.select("lang", "source", "item", "value", "rank").collect())) == sorted(want)


def test_counts_beyond_longs(spark):
    share = spark.sql("SELECT 9000000000000000L AS n, 9100000000000000L AS total").select(divergence._share("n", "total")).first()[0]
    assert share == 1 + 10**9 * (9000000000000000 + 1) // 9100000000000000
