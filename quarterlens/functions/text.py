"""Text predicates and scores as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(words: Iterable[str]) -> str:
    """A regular expression that finds any of the words."""
    return "|".join(re.sub(r"([.\\+*?\[\](){}^$|])", r"\\\1", w) for w in words)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Whether one of the words is in the text. A chain of byte searches, which stops at the first hit; on short texts it
    is several times as fast as one regular expression with as many alternatives."""
    return reduce(or_, [c.contains(w) for w in dict.fromkeys(words)])


def py_strip(c: Column) -> Column:
    """Strips ASCII white space of all kinds, not blanks only."""
    return F.regexp_replace(c, r"^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$", "")


def weighted_first(c: Column, pairs: Iterable[tuple[str, float]]) -> Column:
    """The weight of the first word, in list order, that is in the text; 0 if none is."""
    out = None
    for word, weight in pairs:
        out = F.when(c.contains(word), F.lit(weight)) if out is None else out.when(c.contains(word), F.lit(weight))
    return out.otherwise(F.lit(0.0))


def points(condition: Column, n: float) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0 if isinstance(n, int) else 0.0))


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def combined(text: Column, url: Column) -> Column:
    return F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body over a struct of values, each computed once. Written out, an expression that is used in many places is copied into
    each, and plans grow with the product of such uses."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), 1)
