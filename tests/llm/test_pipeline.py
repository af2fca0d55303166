"""Each stage of the pipeline against a plain version of its rule, on its own input."""

import re

import corpus_pipeline
from quarterlens.llm.tokens import encoder

from .test_exact_dedup import lower
from .test_near_dedup import brute as components
from .test_pii import brute as spans


def test_stages(spark, tmp_path):
    import public_tokenizers

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    kept["start"] = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs.collect()
        if i < 4:
            assert docs.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept["toxicity"]}
    gone = {r["doc_id"] for r in kept["start"]} - left
    clean = [i for i, t in labels.items() if t == 0]
    assert len(gone & set(clean)) <= 0.01 * len(clean) and len(gone & {i for i, t in labels.items() if t == 1}) >= 0.6 * sum(labels.values())
    best = {}
    for r in kept["toxicity"]:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert {r["doc_id"] for r in kept["exact_dedup"]} == set(best.values())
    comp = components([(r["doc_id"], r["text"]) for r in kept["exact_dedup"]], 80)
    assert {r["doc_id"] for r in kept["near_dedup"]} == {i for i, (_, c) in comp.items() if c == i}
    before = {r["doc_id"]: r["text"] for r in kept["near_dedup"]}
    after = {r["doc_id"]: r for r in kept["pii"]}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert not spans(after[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"])
        marks = len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", after[i]["text"]))
        assert (after[i]["text"] == text) or marks or "[SECRET]" in after[i]["text"] or "[NAME]" in after[i]["text"]
        assert marks >= bool(spans(text))
    enc = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(enc.encode(r["text"], allowed_special="all")) + 1 for i, r in after.items()}
    got = {}
    for r in kept["packing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_toxic_rows_without_an_own_doc_id_are_rejected(spark, monkeypatch, tmp_path):
    model = corpus_pipeline.toxicity.Model({"blorg": 9.0}, -3.0, corpus_pipeline.toxicity.Decoder({}, {}))
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: model)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, "you blorg"), (None, "fine"), (4, "a blorg"), (4, "good"), (5, "well")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).collect()
    assert sorted(r["text"] for r in out) == ["fine", "good", "well"]


def test_stages_on_odd_tables(spark, monkeypatch, tmp_path):
    """Nulls in any column, empty texts, repeated rows, one doc_id with several texts, clashing columns, and empty tables."""
    model = corpus_pipeline.toxicity.Model({"blorg": 9.0}, -3.0, corpus_pipeline.toxicity.Decoder({}, {}))
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: model)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    words = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, words, "en"), (1, words, "en"), (1, words.upper(), None), (1, "mail a@b.co", "de"), (None, words + " more", "en"), (None, None, None),
        (None, "a blorg", "en"), (2, "", "en"), (3, None, "en"), (4, "x" * 70_000, "en"), (4, "blorg", None), (5, "mail a@b.co now", "fr"),
    ]
    docs = spark.createDataFrame([(*r, None, len(r[1]) if r[1] else None, 7, "k") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row int, key string")
    sizes = {}
    full = docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, full, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema
            out.write.parquet(str(tmp_path / name))
            full = spark.read.parquet(str(tmp_path / name))
        sizes[name] = out.count()
    # gone: two toxic rows; of three equal texts two, of three empty ones two; the text that is near to another
    assert sizes["toxicity"] == 10 and sizes["exact_dedup"] == 6 and sizes["near_dedup"] == 5 and sizes["pii"] == 5
    kept = {(r["doc_id"], (r["text"] or "")[:20]) for r in full.collect()}
    assert {(1, "mail [EMAIL]"), (5, "mail [EMAIL] now"), (4, "x" * 20)} <= kept
