import hashlib
import random
import re

from quarterlens.llm import pii
from quarterlens.llm.pii import _features, expectation_maximisation, personal_data, redact, train

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def check(rows, result):
    got = {r["doc_id"]: r for r in result.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, want, r["spans"])
        for k in KINDS:
            assert r[f"n_{k}"] == sum(w.startswith(k + ":") for w in want)
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], personal_data(docs))


def test_random_and_odd_texts(spark):
    rnd = random.Random(5)
    parts = ["a@b.c", "@", ".", "_", "x", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "+1 (974) 555-3436", "+49 30 1234567", "+", "(", ") ", "-", " ", "7", "42", "é", "😀", "\n", "a@b", "a@b.c-d_e@f.gh", "5500000000000004", "00", "%", "\x01"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "x" * 50_000, "1" * 50_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", "+1" + "2 " * 20_000, "é" * 9 + "a@b.co " * 2_000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, row int")
    check(rows, personal_data(df))


def test_added_spans(spark):
    rows = [(1, "call (974) 555-3436 now, or mail jane (at) site (dot) com"), (2, "nothing here"), (3, 'token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc"')]
    got = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "" and "phone:5:19" in got[1] and "email:33:57" in got[1] and got[3].startswith("secret:0:")


def test_repeated_rows_empty_table_and_redaction(spark):
    rows = [(1, "é a@b.co x"), (1, "é a@b.co x"), (2, None), (3, "plain"), (4, "+1 (974) 555-3436")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _kept string")
    assert personal_data(df).count() == 5
    out = sorted((tuple(r) for r in redact(df).collect()), key=repr)
    assert out == sorted([(1, "é [EMAIL] x", "z")] * 2 + [(2, None, "z"), (3, "plain", "z"), (4, "[PHONE]", "z")], key=repr)
    assert personal_data(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


def test_expectation_maximisation_tells_reliable_labelers_apart():
    rnd, counts = random.Random(1), {}
    for _ in range(5000):
        y = rnd.random() < 0.4
        v = tuple(int(y if rnd.random() < a else not y) for a in (0.95, 0.9, 0.55))
        counts[v] = counts.get(v, 0) + 1
    post = expectation_maximisation(list(counts.items()))
    assert post[1, 1, 0] > 0.9 and post[0, 0, 1] < 0.1


def test_redaction_of_rows_without_an_own_doc_id(spark):
    rows = [(1, "mail a@b.co now"), (1, "plain text with no data"), (1, "é +1 (974) 555-3436"), (None, "x@y.org"), (None, "nothing")]
    out = redact(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")).collect()
    want = [(1, "mail [EMAIL] now", 0), (1, "plain text with no data", 0), (1, "é [PHONE]", 0), (None, "[EMAIL]", 0), (None, "nothing", 0)]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_long_secrets_and_addresses_are_whole_spans(spark):
    key, local = "ab8ca1b325bc4f85" * 20, "j0" * 35
    mail = f"{local} (at) " + "x" * 10 + " (dot) a" * 10 + " (dot) com"
    rows = [(1, f"token = {key} end"), (2, f"mail contact {mail}!"), (3, "password=" + "a1" * 50_000), (4, "a (at) b" + " (dot) c" * 20_000)]
    got = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == f"secret:0:{8 + len(key)}" and got[2] == f"email:13:{13 + len(mail)}"
    assert got[3] == f"secret:0:{len(rows[2][1])}" and got[4] in ("", f"email:0:{len(rows[3][1])}")


def test_classifier_learns_the_looks_of_trusted_spans():
    plain, odd = ("15", "most", "dash", "blank", "blank"), ("40", "few", "not", "word", "word")
    counts = [("phone", (1, 1, 1, 1), plain, 400), ("phone", (0, 0, 0, 0), odd, 400), ("phone", (-1, 1, -1, 0), plain, 30), ("phone", (-1, 1, -1, 0), odd, 30)]
    weights = train(counts)
    score = lambda v, shape: sum(weights[f] for f in _features("phone", v, shape))
    assert score((1, 1, 1, 1), plain) > 1 > -1 > score((0, 0, 0, 0), odd)
    assert score((-1, 1, -1, 0), plain) > score((-1, 1, -1, 0), odd) + 0.5  # equal votes, told apart by the span
    assert train([]) == {}


def test_names_beside_titles_and_first_names(spark):
    rows = [(1, "signed by Dr. Heike Vogel today"), (2, "dear Mary Poppins, hello"), (3, "The Xylo Band plays"), (4, "McMary Smith")]
    got = {r["doc_id"]: (r["spans"], r["n_spans"]) for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("name:10:25", 1) and got[2] == ("name:5:17", 1) and got[3] == got[4] == ("", 0)


def test_a_text_with_very_many_matches(spark):
    """One text of 100,000 addresses: spans and redaction grow with the matches, not with their square."""
    import time

    text = "".join(f"é write to user{i}@mail{i % 7}.example.com now; " for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string").coalesce(1)
    began = time.time()
    found = pii.personal_data(docs).filter("doc_id = 1").first()
    between = time.time()
    cleaned = pii.redact(docs).filter("doc_id = 1").first().text
    assert between - began < 60 and time.time() - between < 60
    spans = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"user\d+@mail\d\.example\.com", text))
    assert found.n_email == 100_000 and found.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert cleaned == re.sub(r"user\d+@mail\d\.example\.com", "[EMAIL]", text)


def test_redaction_across_blocks(spark):
    """Spans at the edges of the blocks that a text is cut into, in text beyond the basic plane."""
    for before in (pii.BLOCK - 12, pii.BLOCK - 1, pii.BLOCK, 2 * pii.BLOCK - 5):
        text = "😀" * before + " a@b.co " + "é" * (pii.BLOCK * 2) + " c@d.org"
        got = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
        assert got == text.replace("a@b.co", "[EMAIL]").replace("c@d.org", "[EMAIL]")
