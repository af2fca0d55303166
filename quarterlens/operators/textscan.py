"""Many words in one pass over a text, with an Aho-Corasick automaton."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowered(text: str) -> str:
    """Lower case with a character for each character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(words: Sequence[Sequence[str]]):
    """Finds all spellings of each word; a spelling may stand for several words."""
    import ahocorasick

    ranks: dict[str, list[int]] = {}
    for rank, spellings in enumerate(words):
        for s in spellings:
            if s and rank not in ranks.setdefault(s.lower(), []):
                ranks[s.lower()].append(rank)
    found = ahocorasick.Automaton()
    for spelling, which in ranks.items():
        found.add_word(spelling, (len(spelling), which))
    if ranks:
        found.make_automaton()
    return found if ranks else None


def hits(machine, text: str) -> Iterator[tuple[int, int, int]]:
    """(place, length, rank) of all hits in a text, by where they end."""
    if machine is not None and text:
        for end, (length, ranks) in machine.iter(lowered(text)):
            for rank in ranks:
                yield end - length + 1, length, rank


def words_in(column: Column, words: Sequence[Sequence[str]]) -> Column:
    """The ranks of the words that a text contains, ascending (array<int>; null and empty texts have none). words: each word's
    spellings, all in any case. The text is gone over once, whatever the number of words."""

    @F.pandas_udf("array<int>")
    def scan(texts: pd.Series) -> pd.Series:
        machine = automaton(words)
        return texts.map(lambda t: sorted({rank for _, _, rank in hits(machine, t or "")}))

    return scan(F.coalesce(column, F.lit("")))


def first_hits(df: DataFrame, key: str, body: str, words: Sequence[Sequence[str]], most: int = 5, around: int = 200, pattern: str = r"https?://[^\s<>\"]{10,}") -> DataFrame:
    """What matches `pattern` within `around` characters of the first `most` hits of each word: key, rank, hit (as written), place,
    ord (of the match among those of the hit), found. Whole texts, each gone over once for all words; a word's own hits
    don't overlap. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, wanted = automaton(words), re.compile(pattern)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts, ends = [0] * len(words), [0] * len(words)
                for place, length, rank in hits(machine, text or ""):
                    if counts[rank] < most and place >= ends[rank]:
                        counts[rank], ends[rank] = counts[rank] + 1, place + length
                        start = max(0, place - around)
                        for k, m in enumerate(wanted.finditer(text[start : place + length + around])):
                            rows.append((i, rank, text[place : place + length], place, k, m.group()))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "rank", "hit", "place", "ord", "found"])

    return df.select(F.col(key).cast("long").alias(key), F.col(body).cast("string")).mapInArrow(run, f"{key} long, rank int, hit string, place int, ord int, found string")


# Functions of this module go to the workers by value, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
