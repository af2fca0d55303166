"""Operators on further columns with clashing names, on empty tables and on very long texts."""

import hashlib
import os

import public_tokenizers as P
import pytest

from quarterlens.llm import bpe, common, exact_dedup, near_dedup, pii, sharding

RANKS = P.path("byte_bpe_50k.tiktoken")
CLASHING = "text string, doc_id long, size long, shard string, row string, part string, key string, keep_id string, group_size string, kind string, _pii string"


def clashing(spark, *rows):
    return spark.createDataFrame([(t, i, 1, *["x"] * 8) for i, t in rows], CLASHING)


def test_exact_duplicates_beside_other_columns(spark):
    got = exact_dedup.exact_duplicates(clashing(spark, (1, "Same"), (2, "sAME"), (3, None), (None, ""), (4, "é"))).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in got) == [(-1, 3, 2, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 4, 1, True)]


def test_shards_beside_other_columns_and_of_very_long_texts(spark):
    rows = [(i, "x" * (3_000_000 if i % 4 == 0 else 5)) for i in range(9)] + [(None, None)]
    got = sharding.assign_shards(clashing(spark, *rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted((-1 if i is None else i, len(t or "") + 16) for i, t in rows)
    own = {}
    for r in got:
        own.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in own.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], CLASHING)
    encoded = bpe.encode_texts(none, RANKS)
    assert encoded.count() == 0 and bpe.decode_ids(encoded, RANKS).count() == 0
    assert pii.redact(none).columns == none.columns and pii.redact(none).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0 and sharding.assign_shards(none).count() == 0


def test_redaction_of_null_and_empty_texts(spark):
    got = pii.redact(clashing(spark, (1, None), (2, ""), (3, "mail a@b.co"), (None, "+1 202 555 0147"), (3, "no"))).collect()
    assert sorted(((r.doc_id or -1), r.text or "-", r["_pii"]) for r in got) == [(-1, "[PHONE]", "x"), (1, "-", "x"), (2, "-", "x"), (3, "mail [EMAIL]", "x"), (3, "no", "x")]


@pytest.mark.parametrize("text", ["", "word " * 300_000, "x" * 200_000])
def test_round_trip_of_very_long_texts(spark, text):
    r = bpe.round_trips(clashing(spark, (1, text)), RANKS).first()
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_rows_without_those_that_go(spark):
    """Exactly the named rows go, whatever the columns' names are, and few others meet them in a join."""
    names = ["id", "_PLACE", "_part", "_bits", "_may", "_gone", "p"]
    rows = [(i, *[f"{c}{i}" for c in names[1:]]) for i in range(-500, 500)]
    docs = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in names[1:]))
    for gone in ([], [-500, 3, 499, 10**12, 3], list(range(-500, 500))):
        left = common.without(docs, "id", spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        assert left.columns == names and sorted(tuple(r) for r in left.collect()) == sorted(r for r in rows if r[0] not in set(gone))
    told = common.flagged(docs, "id", spark.createDataFrame([(3,), (4,)], "x long"), "f").filter("f").collect()
    assert {3, 4} <= {r.id for r in told} and len(told) < 10


def test_stages_remove_what_their_results_do_not_read(spark):
    docs = spark.createDataFrame([(i, f"text of {i % 3} and some more words") for i in range(9)], "doc_id long, text string")
    place = common.shared_dir(spark).removeprefix("file://")
    were = set(os.listdir(place))
    assert exact_dedup.keep_one(docs).count() == 3 and near_dedup.keep_one(docs).count() == 3
    left = {x.rsplit("-", 32)[0] for x in set(os.listdir(place)) - were}
    assert not [x for x in left if x.startswith(("exact-cut", "exact-clashes", "near-signed", "near-classes"))]
