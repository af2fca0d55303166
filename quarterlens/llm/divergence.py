"""How the sources of each language differ: their distances in pairs, and the terms that set each apart."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, ship, slices, spread, stored, table, text_bytes, tidy

#: Documents of a language that a kept term is in, at least; ranks of terms that are returned.
LEAST_DOCUMENTS, RANKS = 3, 200
#: Bytes of text that are cut into terms at a time; counts that a task gathers before it sums, and before it passes them on.
SLICE, GATHERED, SUMMED = 1 << 20, 1_000_000, 600_000
#: Pairs that are made at a time.
PAIRS = 1 << 19
#: Bits of a digit of the radix selection; bytes of a digit among ties; ties that a last window may sort.
DIGIT, TIE_BYTES, FEW = 12, 2, 1000
#: Groups (of some hundred bytes each) up to which their table is broadcast; beyond, joins shuffle.
BROADCAST_GROUPS = 50_000
KEYS = ["lang", "source"]

_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, and the text that each is of. A term is a run of letters A-Z and of characters beyond ASCII, which
    is a run of such bytes, as all bytes of the latter are over 127."""
    data, offsets = text_bytes(texts)
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    tops = offsets[:-1][offsets[:-1] < len(inside)]
    begins[tops] = inside[tops]
    kept = _LOWER[data[inside]]
    at = np.flatnonzero(begins)
    wide = len(kept) >= 1 << 31
    places = np.append((np.cumsum(inside) - 1)[at], len(kept)).astype(np.int64 if wide else np.int32)
    kind = pa.LargeStringArray if wide else pa.StringArray
    terms = kind.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(kept))
    return terms, np.searchsorted(offsets, at, side="right") - 1


def _term_counts(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, df of a batch (lang, source, text)."""
    terms, row = terms_of(part.column(2))
    coded = terms.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    once = pa.array(row.astype(np.int64) * width + coded.indices.to_numpy()).value_counts()  # (text, term) and how often
    key = once.field("values").to_numpy()
    summed = pa.table({"key": group[key // width] * width + key % width, "n": once.field("counts")}).group_by("key", use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    key = summed["key"].to_numpy()
    return pa.table({
        "lang": langs.dictionary.take(pa.array(key // width // len(sources.dictionary))),
        "source": sources.dictionary.take(pa.array(key // width % len(sources.dictionary))),
        "term": coded.dictionary.take(pa.array(key % width)).cast(pa.string()), "n": summed["n_sum"], "df": summed["n_count"],
    })


def _summed(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).combine_chunks()
    sums = whole.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
    return pa.table({"lang": sums["lang"], "source": sums["source"], "term": sums["term"], "n": sums["n_sum"], "df": sums["df_sum"]})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []
    for batch in batches:
        for start, end in slices(batch, SLICE, 2):
            if len(part := _term_counts(batch.slice(start, end - start))):
                waiting.append(part)
            if sum(map(len, waiting)) > GATHERED:
                waiting = [_summed(waiting)]
                if len(waiting[0]) > SUMMED:
                    yield from waiting[0].to_batches(max_chunksize=20_000)
                    waiting = []
    if waiting:
        yield from _summed(waiting).to_batches(max_chunksize=20_000)


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _meet(ids: np.ndarray, group: np.ndarray, p: np.ndarray, none: np.ndarray) -> Iterator[pa.Table]:
    """(key, value) of all ordered pairs of rows with the same id: what a term that both have adds beyond what each has alone."""
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    size = np.diff(np.append(starts, len(ids)))
    first, many = np.repeat(starts, size), np.repeat(size, size)
    ends = np.cumsum(many)
    row = 0
    while row < len(ids):
        done = ends[row - 1] if row else 0
        upto = max(row + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        a = np.repeat(np.arange(row, upto), many[row:upto])
        b = first[a] + np.arange(len(a)) - np.repeat(ends[row:upto] - many[row:upto] - done, many[row:upto])
        a, b = a[a != b], b[a != b]
        value = _divergences(p[a], p[b]) - _divergences(p[a], none[b]) - _divergences(none[a], p[b]) + _divergences(none[a], none[b])
        yield pa.table({"key": (group[a] << 31) | group[b], "value": value})
        row = upto


def _added(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by("key", use_threads=False).aggregate([("value", "sum")])
    return pa.table({"key": sums["key"], "value": sums["value_sum"]})


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) from rows (id, lang, source, p, none) of which those of an id follow each other."""
    codes: dict[tuple[str, str], int] = {}
    waiting: list[pa.Table] = []
    held: tuple[np.ndarray, ...] | None = None

    def out(sums: pa.Table) -> Iterator[pa.RecordBatch]:
        names, key = list(codes), sums["key"].to_numpy()
        langs, sources = pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string())
        a, b = pa.array(key >> 31), pa.array(key & ((1 << 31) - 1))
        whole = pa.table({"lang": langs.take(a), "source": sources.take(a), "item": sources.take(b), "value": sums["value"]})
        yield from whole.to_batches(max_chunksize=20_000)

    def join(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        for made in _meet(*rows):
            waiting.append(_added([made]))
            if sum(map(len, waiting)) > GATHERED:
                waiting = [_added(waiting)]
                if len(waiting[0]) > SUMMED:
                    yield from out(waiting[0])
                    waiting = []

    for batch in batches:
        if not batch.num_rows:
            continue
        langs, sources = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
        both = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        met, back = np.unique(both, return_inverse=True)
        pairs = [(langs.dictionary[int(x) // len(sources.dictionary)].as_py(), sources.dictionary[int(x) % len(sources.dictionary)].as_py()) for x in met]
        group = np.array([codes.setdefault(x, len(codes)) for x in pairs], np.int64)[back]
        rows = (batch.column(0).to_numpy(), group, batch.column(3).to_numpy(), batch.column(4).to_numpy())
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        whole = int(np.searchsorted(-(rows[0] == rows[0][-1]).astype(np.int8), -1))  # the last id may go on in the next batch
        held = tuple(x[whole:] for x in rows)
        if whole:
            yield from join(tuple(x[:whole] for x in rows))
    if held is not None:
        yield from join(held)
    if waiting:
        yield from out(_added(waiting))


def _share(n: str, total: str) -> Column:
    """1 + floor(10**9 * (n + 1) / total), exactly; beyond nine billion occurrences in decimals of 38 digits."""
    return F.expr(
        f"1 + CASE WHEN {n} < 9000000000 THEN (1000000000 * ({n} + 1)) div ({total}) "
        f"ELSE (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({total} AS DECIMAL(20, 0)) END"
    )


def _far(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, lang_n, held: [(source, n)]) of terms in at least `least` of a language's documents. Counts are summed in
    tasks before they move; a row has as many entries as the language has sources."""
    ship(docs.sparkSession)
    counted = spread(_rows(docs)).mapInArrow(tidy(_count), "lang string, source string, term string, n long, df long")
    return (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        .groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("held"))
        .filter(F.col("df") >= least).drop("df")
    )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _pick(hist: DataFrame, order: Column) -> DataFrame:
    """Of each group's digits the one in which the `need`th row lies; `need` is then counted within it."""
    running = F.sum("count").over(Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = hist.withColumn("upto", running).filter("upto >= need AND upto - count < need")
    return found.withColumn("need", F.expr("need - (upto - count)")).drop("upto")


def top_ranked(scores: DataFrame, most: int = RANKS, few: int = FEW, near=F.broadcast) -> DataFrame:
    """(lang, source, item, value, rank) of each group's `most` largest values (not negative), ties by their items' bytes.

    A radix selection: a histogram over the values' bit lengths and then over DIGIT bits at a time narrows each group down to its
    `most`th value. Values above it are in. Among those equal to it, histograms over the items' bytes, from where they begin to
    differ, go on until `few` are left. So a group's rows are counted where they are, and only `most` + `few` of them meet.
    Groups with fewer rows come whole; an empty table gives none. near: marks the table of thresholds (a row a group) for broadcast.
    """
    spark = scores.sparkSession
    length = F.when(F.col("value") == 0, 0).otherwise(F.length(F.bin("value")))
    hist = scores.groupBy(*KEYS, length.alias("digit")).count().withColumn("need", F.lit(most).cast("long"))
    cut = _pick(hist, F.desc("digit")).select(
        *KEYS, F.expr("CASE WHEN digit = 0 THEN 0L ELSE shiftleft(1L, digit - 1) END").alias("lo"),
        F.greatest(F.col("digit") - 1, F.lit(0)).alias("bits"), "need", "count",
    )
    cut = stored(spark, cut, "radix-cut")
    rows = stored(spark, scores.join(near(cut.select(*KEYS, "lo")), KEYS, "left").filter("lo IS NULL OR value >= lo").drop("lo"), "radix-rows")
    while cut.filter("bits > 0").take(1):
        inside = rows.join(near(cut.drop("count")), KEYS).filter("value >= lo AND value - lo < shiftleft(1L, bits)")
        step = F.greatest(F.col("bits") - DIGIT, F.lit(0))
        hist = inside.withColumn("step", step).withColumn("digit", F.expr("shiftright(value - lo, step)")).groupBy(*KEYS, "lo", "step", "need", "digit").count()
        finer = _pick(hist, F.desc("digit")).select(*KEYS, F.expr("lo + shiftleft(digit, step)").alias("lo"), F.col("step").alias("bits"), "need", "count")
        finer = stored(spark, finer, "radix-cut")
        discard(cut)
        cut = finer
    cut = cut.withColumn("edge", F.unhex(F.lit("")))
    coded = rows.withColumn("code", F.col("item").cast("binary"))
    while cut.filter(f"count > need AND count > {few}").take(1):
        open_ = cut.filter(f"count > need AND count > {few}")
        tied = coded.join(near(open_), KEYS).filter("value = lo AND substring(code, 1, length(edge)) = edge")
        ends = tied.groupBy(*KEYS, "lo", "need").agg(F.min("code").alias("a"), F.max("code").alias("b"))
        ends = stored(spark, ends.select(*KEYS, "lo", "need", _common("a", "b").alias("edge")), "radix-ends")
        tied = coded.join(near(ends), KEYS).filter("value = lo AND substring(code, 1, length(edge)) = edge")
        hist = tied.withColumn("digit", F.expr(f"substring(code, length(edge) + 1, {TIE_BYTES})")).groupBy(*KEYS, "lo", "need", "edge", "digit").count()
        narrowed = _pick(hist, F.asc("digit")).select(*KEYS, "lo", F.lit(0).alias("bits"), "need", "count", F.concat("edge", "digit").alias("edge"))
        ready = cut.filter(f"NOT (count > need AND count > {few})").select(*narrowed.columns)
        cut = stored(spark, ready.unionByName(narrowed), "radix-cut")
    chosen = coded.join(near(cut.select(*KEYS, "lo", "edge")), KEYS, "left").filter(
        "lo IS NULL OR value > lo OR (value = lo AND (code < edge OR substring(code, 1, length(edge)) = edge))"
    )
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("value"), "item"))
    return chosen.select(*KEYS, "item", "value", rank.alias("rank")).filter(F.col("rank") <= most)


def _common(a: str, b: str) -> Column:
    """The bytes with which both begin: with the least and the greatest of some items, what all of them begin with."""
    return F.udf(lambda x, y: os.path.commonprefix([bytes(x), bytes(y)]), "binary")(a, b)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): for every (lang, source) group its distance from each other source of the language
    (part 'pair'), and the terms that are commoner in it than in the language (part 'term', up to rank `ranks`).

    A pair's value is a sum over all kept terms. Terms that neither source has add the same, V times a baseline; a term that only
    one has adds what its p alone gives, so a histogram of each group's p does for all partners; only terms that both have are met
    pair by pair, summed in the task. Pairs of sources are the result's own size, so a language's sources are few against its terms.

    Null lang, source and text count as ''. A group without kept terms has all its counts 0; a language without any gives values
    of 0. Repeated rows count as often as they come. Further columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    terms = stored(spark, kept_terms(docs, least), "divergence-terms")
    each = terms.select("lang", "term", "lang_n", F.inline("held"))
    totals = each.groupBy(*KEYS).agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = (
        _rows(docs).select(*KEYS).distinct().join(totals, KEYS, "left").join(langs, "lang", "left")
        .select(*KEYS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")))
        .withColumn("none", F.when(F.col("v") > 0, _share("0", "greatest(total + v, 1)")))
    )
    groups = stored(spark, groups, "divergence-groups")
    small = groups.count() <= BROADCAST_GROUPS
    near = F.broadcast if small else (lambda df: df)

    numbered = terms.withColumn("id", F.monotonically_increasing_id()).select("id", "lang", "term", "lang_n", F.inline("held"))
    shared = numbered.join(near(groups), KEYS).withColumn("p", _share("n", "total + v"))
    alone = shared.groupBy(*KEYS, "p").agg(F.count("*").alias("n"))
    one = groups.select(*KEYS, "v", "none")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    pairs = one.join(other, "lang").filter("source <> item")
    base = _far("none", "other")
    mine = alone.join(pairs, KEYS).withColumn("value", F.expr(f"n * ({_far('p', 'other')} - {base})"))
    theirs = alone.withColumnRenamed("source", "item").join(pairs, ["lang", "item"]).withColumn("value", F.expr(f"n * ({_far('none', 'p')} - {base})"))
    met = shared.select("id", *KEYS, "p", "none")
    if not small:  # the join has dealt the rows out
        met = met.repartition("id").sortWithinPartitions("id")
    both = met.mapInArrow(tidy(_pair_sums), "lang string, source string, item string, value long")
    columns = [*KEYS, "item", "value"]
    summed = pairs.withColumn("value", F.expr(f"coalesce(v * {base}, 0)")).select(*columns)
    for part in (mine, theirs, both):
        summed = summed.unionByName(part.select(*columns))
    by_rank = Window.partitionBy(*KEYS).orderBy(F.desc("value"), "item")
    distances = summed.groupBy(*KEYS, "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by_rank))

    scores = (
        shared.withColumn("q", _share("lang_n", "lang_total + v")).filter("p > q")
        .select(*KEYS, F.col("term").alias("item"), F.expr(_far("p", "q")).alias("value"))
    )
    best = top_ranked(scores, ranks, near=near)
    parts = [df.select(*KEYS, F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", distances), ("term", best))]
    return parts[0].unionByName(parts[1])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, row_number() OVER () AS i, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w SEMI JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, sum(coalesce(n, 0)) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
  FROM t JOIN k ON t.lang = k.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
