import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarterlens.llm.bpe import bpe, decode_ids, encode_texts, round_trips
from quarterlens.llm.packing import differencing, pack, windows_for
from quarterlens.llm.tokens import segments, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(6)
    parts = ["'", "s", "'s", "'ll", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "Ⅷ", "!", "?", "　", "\x1c", "\x85", "日本", "😀", "́", "ve", "\r\n", "​",
             "_", "<|endoftext|>", "\0", "don't", "x" * 30, "word ", " Word", "﻿", "ſ"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    out += [None, "", "a" * 20_000, "".join(rnd.choice("abcdé") for _ in range(9_000)), "the word " * 30_000, " " * 5_000, "\n" * 300 + "x"]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)


def test_counts(spark, library):
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts()}
    got = {r["doc_id"]: r for r in token_counts(frame(spark, texts()), JSON).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["n_bytes"] == len((dict(texts())[i] or "").encode()) for i, r in got.items())
    assert token_counts(frame(spark, texts()).limit(0), JSON).count() == 0


def test_counts_of_the_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, JSON).collect()} == want


def test_segments_join_to_the_text():
    t = "abc def  ghi\n jkl " * 20_000
    cut = segments(t, 1_000)
    assert "".join(cut) == t and len(cut) > 100 and segments("x" * 5_000, 1_000) == ["x" * 5_000]


def test_round_trips(spark, tik):
    got = {r["doc_id"]: r for r in round_trips(frame(spark, texts()), RANKS).collect()}
    for i, t in texts():
        ids = tik.encode_ordinary(t or "")
        r = got[i]
        assert r["n_tokens"] == len(ids), (i, t)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_and_decode(spark, tik):
    rows = [r for r in texts() if r[1] is not None]
    encoded = encode_texts(frame(spark, rows), RANKS)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: tik.encode_ordinary(t) for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in decode_ids(encoded, RANKS).collect()} == dict(rows)


def test_matrix_rows_and_heap_agree(tik):
    enc, rnd = bpe(RANKS), random.Random(2)
    words = ["".join(rnd.choice("abctheinx") for _ in range(rnd.randint(1, 200))).encode() for _ in range(200)]
    ids, counts = enc.merge_pieces(words)
    assert ids.tolist() == [i for w in words for i in enc.merge_long(w)] and counts.sum() == len(ids)


def test_differencing_deals_all_items_evenly():
    rnd = random.Random(9)
    for _ in range(100):
        sizes = [rnd.randint(1, 512) for _ in range(rnd.randint(1, 200))]
        k = rnd.randint(1, 30)
        groups = differencing(sizes, k)
        assert sorted(x for g in groups for x in g) == list(range(len(sizes))) and len(groups) <= k
        if len(sizes) > 12 * k:
            sums = [sum(sizes[i] for i in g) for g in groups]
            assert max(sums) - min(sums) < 40
    assert all(sum(g) <= 10 for g in [[[6, 6, 6][i] for i in x] for x in windows_for([6, 6, 6], 10)])


def test_packing(spark, library):
    rows = texts()
    out = pack(frame(spark, rows), JSON).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces, sequences = {}, {}
    for r in out:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(own) and len(part) == r["length"] > 0
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(ids[i])
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) + 4  # three tasks, each with one block that isn't full
    assert pack(frame(spark, rows).limit(0), JSON).count() == 0


def clashing(n):
    """The Thue-Morse word of n letters and its complement: they share every polynomial hash modulo 2^64."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_share_a_hash(spark, tik, library):
    rows = [(k, f"{w} end") for k, w in enumerate(w for n in (1024, 2048, 4096) for w in (*clashing(n), *clashing(n)))]
    rows += [(100, " ".join(w for n in (1024, 2048) for w in clashing(n)))]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        for r in round_trips(df, RANKS).collect():
            text = dict(rows)[r["doc_id"]]
            assert r["ids_sha256"] == hashlib.sha256(np.array(tik.encode_ordinary(text), "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        for r in pack(df, JSON).collect():
            own = [*library.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids, 1]
            part = own[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(own)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (None, None), (None, "a b c")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    for run in (lambda d: round_trips(d, RANKS), lambda d: token_counts(d, JSON), lambda d: pack(d, JSON)):
        assert run(df).count() == len(rows) and run(df.limit(0)).count() == 0
        assert sorted(str(r["doc_id"]) for r in run(df).collect()) == ["1", "1", "1", "None", "None"]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in round_trips(df, RANKS).collect()}
    assert len(got) == 4


def test_other_vocabularies_are_refused(tmp_path):
    import json

    from quarterlens.llm.tokens import encoder

    spec = json.load(open(JSON, encoding="utf-8"))
    for k, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            encoder(str(path))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "turned.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        encoder(str(tmp_path / "turned.json"))


def test_packing_again_gives_the_same_sequences(spark):
    df = spark.createDataFrame([(i % 40, f"text {i} " * (i % 97)) for i in range(400)], "doc_id long, text string").coalesce(1)
    a, b = (sorted(map(tuple, pack(df, JSON).collect())) for _ in range(2))
    assert a == b


def test_sequences_are_full_on_many_partitions(spark):
    """What tasks cannot fill a block with is packed together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(64)
    out = pack(docs, JSON)
    total = out.selectExpr("sum(length) AS tokens", "count(DISTINCT sequence_id) AS n").first()
    assert total.tokens / (2048 * total.n) > 0.98
    spans = out.groupBy("sequence_id").agg({"length": "sum", "offset": "max", "*": "count"}).collect()
    assert max(r["sum(length)"] for r in spans) <= 2048
    pieces = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)
