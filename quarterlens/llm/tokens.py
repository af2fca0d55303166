"""Token counts: batches of equal bytes, lengths only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, slices, spread, table, text_offsets, texts, tidy

SLICE = 1 << 20
SEGMENT = 1 << 16
LIMIT = 1024

#: Between a character that is no white space and a blank that another such character follows, the split pattern
#: always begins a new piece, so merges never cross this place.
_SAFE = re.compile(r"(?<=\S)(?= \S)")

_encoders: dict = {}


def encoder(vocabulary: str):
    """An encoder for a byte-level BPE in a tokenizer's .json file, with that file's special tokens.

    Its ids, as ranks, go to the tiktoken library, which gives the same ids about four times as fast as the tokenizers library
    does (the tests hold one against the other). That takes a file whose merges stand in the order of the ids of what they
    make, which changes no text before it is split; any other is refused.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or made != sorted(made):
            raise ValueError(f"{vocabulary} is no plain byte-level BPE with ids in the order of its merges")
        # bytes that stand for themselves in such files; the others are moved up from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _encoders[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _encoders[vocabulary]


def segments(text: str, most: int = SEGMENT) -> list[str]:
    """Cuts a long text into segments of about `most` characters at safe boundaries only. Where none lies ahead, the
    rest stays whole. A cut never falls inside a special string, as these hold no blank."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        m = _SAFE.search(text, start + most)
        if not m or m.start() >= len(text):
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def batch_counts(enc, rows: list[str]) -> list[int]:
    """The number of tokens of each text: all segments of a slice go to the library as one batch, and only lengths are kept."""
    cut = [segments(t) for t in rows]
    lengths = [len(ids) for ids in enc.encode_batch([s for parts in cut for s in parts], num_threads=1, allowed_special="all")]
    ends = list(accumulate(map(len, cut), initial=0))
    return [sum(lengths[a:b]) for a, b in pairwise(ends)]


def _count(vocabulary: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for a, b in slices(batch, SLICE):
                part = batch.slice(a, b - a)
                offsets = text_offsets(part.column(1))
                counts, sizes = batch_counts(enc, part.column(1).to_pylist()), offsets[1:] - offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([c > limit for c in counts], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """The number of tokens of every whole text; no ids leave the Python workers.

    Arrow batches are dealt into slices of about SLICE bytes, so that memory and time for each step don't depend
    on how long the rows happen to be; texts over SEGMENT characters are encoded in segments that end where the split
    pattern always ends a piece. Special strings in a text become their tokens, as is the tokenizers library's default.

    Null and empty texts have 0 tokens. Every row is returned once, repeated ones too; other columns are ignored; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return spread(texts(docs)).mapInArrow(tidy(_count(vocabulary, limit)), schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
