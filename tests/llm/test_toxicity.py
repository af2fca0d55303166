import glob
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarterlens.llm.common import shared_dir, ship
from quarterlens.llm.toxicity import Decoder, Model, document_counts, fit, language, plain_words, repetitive, toxicity, word_key


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ship(spark)
    out = toxicity(docs, fit(docs, labels))
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    clean, bad = [r for r in held if not r["toxic"]], [r for r in held if r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["predicted"] for r in bad) >= 0.6 * len(bad)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(docs, labels), fit(docs, turned)
    assert a.weights == b.weights and a.bias == b.bias


def test_decoder_restores_obfuscated_words():
    words = {"idiot": -4.0, "moron": -4.0, "stupid": -4.0, "the": -2.0, "one": -3.0}
    trigrams = {}
    for w in words:
        p = f"^^{w}$"
        for i in range(len(p) - 2):
            trigrams[p[i : i + 3]] = -1.0
    d = Decoder(trigrams, words)
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tuuupid", "stupid"), ("s-t-u-p-1-d", "stupid"), ("th3", "the")):
        assert d.decode(token)[0] == word
    assert d.decode("x" * 200)  # long runs end


def test_odd_tables(spark):
    schema = "doc_id long, text string, score double, toxic int"
    toxic = "you are an awful blorg person"
    rows = [(i, toxic if i % 4 == 0 else f"hello friend number {'abcdefgh'[i % 8]}", 0.5, 9) for i in range(120)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    odd = [(None, None, 0.0, 0), (1, "", 0.0, 0), (1, "", 0.0, 0), (2, "a b c " * 30_000, 0.0, 0), (3, "1a" * 50_000, 0.0, 0), (4, "😀 é", 0.0, 0)]
    out = toxicity(spark.createDataFrame(odd, schema), model).collect()
    assert len(out) == 6 and {r["score"] for r in out if r["doc_id"] == 1} == {out[0]["score"]}
    assert toxicity(docs.limit(0), model).count() == 0
    none = fit(docs, labels.limit(0))
    assert all(r["predicted"] == 0 for r in toxicity(docs, none).collect())


def test_language_model_counts_every_document(spark):
    rows = [(i, f"plain words {'qzxv' if i >= 40 else 'here'} {chr(0x430 + i % 30)}{chr(0x430 + i // 30)}bb") for i in range(300)]
    rows = [(i, t + (" awful" if i < 40 and i % 2 else "")) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    ship(spark)
    d = fit(docs, labels, most=20).decoder
    assert "qzxv" in d.words and "here" in d.words  # in unlabelled documents only; in labelled ones beyond the sample
    assert {"^^q", "qzx", "zxv", "xv$"} <= d.trigrams.keys()
    assert all(f"^^{t.split()[3][0]}" in d.trigrams for _, t in rows)


def test_hidden_words_in_joined_and_long_tokens():
    common = ["hello", "you", "are", "such", "really", "one", "the", "paragraph"]
    words = {w: -4.0 for w in [*common, "idiot"]}
    trigrams = {p[i : i + 3]: -1.0 for w in words for p in [f"^^{w}$"] for i in range(len(p) - 2)}
    trigrams |= {a[-2:] + b[0]: -2.0 for a in words for b in words} | {a[-1] + b[:2]: -2.0 for a in words for b in words}
    m = Model({"idiot": 1.0}, 0.0, Decoder(trigrams, words))
    for text in ("hello,1d10t", "you_4re_1d10t", "hello!1d10t", "such/1d10t.really", "hello1d10t", "1d1otyou"):
        assert m.present(text) == {"idiot"}, text
    for before in range(60, 90):  # at any place of a very long token
        assert m.present("x1" * (before // 2) + "y" * (before % 2) + ",1d10t," + "x1" * 40) == {"idiot"}, before
    for k in range(8, 14):
        assert m.present("hello" * k + "1d10t" + "really" * 9) == {"idiot"}, k
    for text in ("hello,fr1end", "qx1d10tzv", "par4graph", "h3llo/you"):  # no chance substrings
        assert m.present(text) == set(), text


def test_search_is_exact():
    """The decoder against all paths through the lattice."""
    rnd = random.Random(3)
    letters = "abcdeiloprst"
    for _ in range(40):
        trigrams = {x + y + z: -rnd.random() * 6 for x in letters + "^" for y in letters + "^" for z in letters + "$" if rnd.random() < 0.5}
        d = Decoder(trigrams, {})
        token = "".join(rnd.choice("aabls1!0$ .-*e") for _ in range(rnd.randint(1, 6)))
        every = [(0.0, "^^", "")]
        for run in re.finditer(r"(.)\1*", token):
            reached = []
            for cost, state, out in every:
                for step, price in Decoder.steps(run.group(1), len(run.group())):
                    c, now = cost + price, state
                    for x in step:
                        if x == " ":
                            c, now = c + (trigrams.get(now + "$", d.floor) if now != "^^" else 0), "^^"
                        else:
                            c, now = c + trigrams.get(now + x, d.floor), now[1] + x
                    reached.append((c, now, out + step))
            every = reached
        full = [(c + (trigrams.get(s + "$", d.floor) if s != "^^" else 0), " ".join(o.split())) for c, s, o in every]
        want = sorted((-c for c, _ in full))
        for best in (1, 8, 32):
            got = d.paths(token, best)
            assert np.allclose([-c for c, _ in got], want[:best])
            assert all(any(abs(c - f) < 1e-9 and o == t for f, t in full) for c, o in got)


def test_blanks_are_arcs():
    words = {w: -4.0 for w in ("you", "idiot", "stupid", "a")}
    trigrams = {p[i : i + 3]: -1.0 for w in words for p in [f"^^{w}$"] for i in range(len(p) - 2)}
    d = Decoder(trigrams, words)
    assert d.paths("s t u p 1 d", 1)[0][1] == "stupid" and d.paths("y 0 u  s t u p i d", 1)[0][1] == "you stupid"
    m = Model({"idiot": 1.0, "incomprehensibilitiesnesses": 1.0}, 0.0, d)
    assert m.present("so 1 d 1 o t, he") == {"idiot"} and m.present("y o u i d i o t " * 400) == {"idiot"}
    for blank in ("\t", "\n", "   ", " \r\n ", "\u00a0"):
        assert m.present(blank.join("so idiot he").replace(blank + " " + blank, "  ")) == {"idiot"}, blank
        assert m.present("you" + blank + blank.join("idiot") + blank + "there") == {"idiot"}, blank
    assert m.present("i d") == set() and m.present("x y z " * 300) == set()
    assert m.present("inc0mprehensibilitiesnesses") == {"incomprehensibilitiesnesses"} == m.present("i.n.c.o.m.p.r.e.h.e.n.s.i.b.i.l.i.t.i.e.s.n.e.s.s.e.s")


def test_a_shared_doc_id_gives_one_labelled_text(spark):
    rows = [(1, f"bad text {i}") for i in range(50)] + [(i, f"fine text {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 60)], "doc_id long, toxic int")
    ship(spark)
    fit(docs, labels, most=30)
    sample = max(glob.glob(shared_dir(spark).removeprefix("file://") + "/toxicity-sample-*"), key=os.path.getmtime)
    assert spark.read.parquet(sample).count() <= 30


def test_words_with_repeated_letters_are_looked_at():
    rnd = random.Random(1)
    words = ["".join(rnd.choice(["a", "b", "é", "日", "😀"]) for _ in range(rnd.randint(0, 7))) for _ in range(3_000)]
    for w, may in zip(words, repetitive(pa.array(words)).tolist(), strict=True):
        assert may or not re.search(r"(.)\1\1", w), w
    assert repetitive(pa.array(["abc", "aabb", "éa", "x"])).tolist() == [False] * 4 and repetitive(pa.array([], pa.string())).tolist() == []


def test_counts_of_words_in_documents():
    texts = ["A b, a!", "", "b's c3po B", "  x\ty ", "日本 日本。", "it's (no) 1d10t"]
    want = Counter(w for t in texts for w in {w for x in t.split() for w in plain_words(x.lower())})
    got = document_counts(pa.array(texts))
    assert dict(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True)) == want
    assert document_counts(pa.array([], pa.string())).num_rows == 0


def test_language_model_against_a_plain_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r["text"] or "" for r in docs.select("text").collect()]
    words, trigrams = Counter(), Counter()
    for t in rows:
        words.update({w for x in t.split() for w in plain_words(x.lower())})
    for w, n in words.items():
        p = f"^^{w}$"
        for i in range(len(p) - 2):
            trigrams[p[i : i + 3]] += n
    after = Counter()
    for t, n in trigrams.items():
        after[t[:2]] += n
    chars, keys, counts, total = language(docs.repartition(5))
    assert total == len(rows) and chars.keys() == trigrams.keys()
    assert all(abs(chars[t] - math.log((n + 0.1) / (after[t[:2]] + 3.0))) < 1e-12 for t, n in trigrams.items())
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {word_key(w): n for w, n in words.items() if n >= 3}
