import random
import re

import pyarrow as pa

from quarterlens.llm import near_dedup
from quarterlens.llm.links import components
from quarterlens.llm.near_dedup import _across, _check, keep_one, near_duplicates, odd_sketches, set_keys, shingles


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for members in where.values():
        for x in members:
            for y in members:
                if x < y and (x, y) not in seen:
                    seen.add((x, y))
                    n = len(sets[x] & sets[y])
                    if 100 * n >= percent * len(sets[x] | sets[y]):
                        a, b = find(x), find(y)
                        parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(rows, result, percent=85):
    want = brute(rows, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result.collect()}
    wrong = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert got.keys() == want.keys() and not wrong, list(wrong.items())[:5]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(rows, near_duplicates(docs))


def test_families_with_drifting_copies(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    rows, i = [], 0
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([3, 40, 150, 400]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = word()
            base = w if rnd.random() < 0.3 else base  # chains as well as stars
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "A b"), (i + 4, "a  B"), (i + 5, "x " * 40_000), (i + 6, "é b c d e f")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(7)
    check(rows, near_duplicates(df))
    check(rows, near_duplicates(df, 80), 80)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B c d e f"), (None, "a b c d e f"), (9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, 3, False), (9, 9, True)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_keep_one_judges_rows_without_an_own_doc_id(spark):
    t = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1] + " more"), (7, t[2]), (7, t[3]), (3, t[2] + " more"), (8, t[0] + " more")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _row int")
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["text"].removesuffix(" more") for r in out.collect()) == t


def test_every_text_of_a_doc_id_links(spark):
    t = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(1, t[k]) for k in range(6)] + [(10 + k, t[k] + " more") for k in range(6)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        assert {r["component_id"] for r in near_duplicates(df).collect()} == {1}


def test_check_compares_full_sets():
    a, b = (" ".join(f"a{i}" for i in range(40)).encode() + x for x in (b"", b" more"))
    c = " ".join(f"c{i}" for i in range(40)).encode()
    keys = dict(zip((a, b, c), set_keys(*shingles([a, b, c])), strict=True))
    pairs = [(a, b), (a, c), (c, b), (b, a)]
    ids = {a: 1, b: 2, c: 3}
    columns = [pa.array([f(p) for p in pairs], t) for f, t in (
        (lambda p: keys[p[0]], pa.binary()), (lambda p: keys[p[1]], pa.binary()), (lambda p: ids[p[0]], pa.int64()),
        (lambda p: ids[p[1]], pa.int64()), (lambda p: p[0], pa.binary()), (lambda p: p[1], pa.binary()),
    )]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "node_a", "node_b", "text_a", "text_b"])
    for parts in ([batch], [batch.slice(i, 1) for i in range(4)]):
        assert [tuple(r.values()) for x in _check(85)(parts) for r in x.to_pylist()] == [(1, 2), (2, 1)]


def test_words_that_share_a_hash(spark):
    rows = []
    for n in (1024, 2048, 4096):
        w = "".join("ab"[i.bit_count() % 2] for i in range(n))
        rows += [(len(rows) + k, f"one two {x} four five six") for k, x in enumerate((w, w.translate(str.maketrans("ab", "ba"))))]
    check(rows, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))


def test_large_buckets_are_split(spark, monkeypatch):
    rnd = random.Random(8)
    monkeypatch.setattr(near_dedup, "CHUNK", 5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):  # families around the threshold, which meet in many buckets
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2])):
            w[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    check(rows, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))


def test_pairs_of_a_bucket_beyond_the_budget_come_in_later_rounds(monkeypatch):
    texts = [" ".join([f"w{i}" for i in range(60)] + [f"x{k}"]).encode() for k in range(40)]
    hashes, counts, more = shingles(texts)
    keys, sketches, nexts = set_keys(hashes, counts, more), odd_sketches(hashes, counts), odd_sketches(hashes, counts, 1)
    n = len(texts)
    columns = [pa.array([7] * n, pa.int64()), pa.array(keys, pa.binary()), pa.array([k % 2 for k in range(n)], pa.int64()), pa.array(counts),
               pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array([x.tobytes() for x in nexts], pa.binary()),
               pa.array([0] * n, pa.int32()), pa.array([True] * n)]
    batch = pa.RecordBatch.from_arrays(columns, names=list("abcdefgh"))
    monkeypatch.setattr(near_dedup, "BLOCK", 200)
    want = {(min(a, b), max(a, b)) for a in keys[::2] for b in keys[1::2]}
    some = [tuple(r.values()) for x in _across(2, 85)([batch]) for r in x.to_pylist()]
    every = [tuple(r.values()) for x in _across(10_000, 85)([batch]) for r in x.to_pylist()]
    assert (None, None) in some and set(some) - {(None, None)} < want and len(some) < len(want) and set(every) == want


def test_words_part_at_ascii_white_space_only():
    texts = ["", " \t", "a", " a  b\x0b\x0cc\r\nd ", "é f G h \x1c i\x85j", "", "É ABC", "\n"]
    digests, counts = near_dedup.words_of(pa.array(texts))
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())]
    assert counts.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for t in texts]
    assert [tuple(d) for d in digests.tolist()] == [tuple(near_dedup.words_of(pa.array([w.decode()]))[0].tolist()[0]) for w in words]
    assert near_dedup.words_of(pa.array([], pa.string()))[1].tolist() == [] and len(set(map(tuple, digests.tolist()))) == len(set(words))


def test_bands_reach_the_threshold():
    assert [near_dedup.bands_for(p) for p in (85, 80)] == [19, 27]
    for percent in (85, 80):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) < 1e-6


def test_recall_at_the_threshold(spark):
    """Pairs of 104 words, 100 shingles, of which they share 92 (85.2 per cent) or 91 (83.5 per cent)."""
    rnd, rows = random.Random(12), []
    for pair in range(300):
        words = [f"p{pair}x{i}" for i in range(104)]
        rows.append((2 * pair, " ".join(words)))
        other = list(words)
        for k in range(8 if pair % 2 == 0 else 9):  # a changed word at the end costs one shingle
            other[103 - k] = f"q{rnd.randrange(10**9)}"
        rows.append((2 * pair + 1, " ".join(other)))
    sets = {i: shingle_set(t) for i, t in rows}
    assert {len(sets[2 * p] & sets[2 * p + 1]) for p in range(300)} == {92, 91}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[2 * p + 1] == (2 * p if p % 2 == 0 else 2 * p + 1) for p in range(300))
