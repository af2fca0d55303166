"""The document pipeline: toxicity, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame, which is
written as Parquet and reread as the next stage's docs. All but the last return the columns of documents, further ones
included. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlens.llm import exact_dedup, near_dedup, packing, pii, toxicity
from quarterlens.llm.common import row_ids, ship, shared_dir, stored, table, without


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity operator predicts to be toxic; the model is fitted on the labelled ones. Rows without
    a doc_id, or that share one, are judged one by one; without labels nothing goes."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, own = row_ids(docs)  # rows that share a doc_id, or have none, are judged one by one
    scored = toxicity.toxicity(rows.select(F.col(own).alias("doc_id"), "text"), model)
    rejected = stored(spark, scored.filter("predicted = 1").select("doc_id"), "pipeline-toxic")
    return without(rows, own, rejected).select(*docs.columns)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each set of equal texts, the one with the largest doc_id; null and empty texts are equal."""
    return exact_dedup.keep_one(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, a similarity of 0.8 or more); texts without words stay."""
    return near_dedup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind; every document stays, and n_chars follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row's tokens into sequences; null and empty texts are documents of one token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the toxicity model, the span classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
