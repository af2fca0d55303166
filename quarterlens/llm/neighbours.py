"""Nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stored, table, tidy

NEIGHBOURS = 10
QUERY_STEP = 100
#: Codebooks are fitted on at most SAMPLE distinct vectors; the share of entries to visit is measured on at most
#: TRIAL of them with PROBES queries, for a recall of AIM.
SAMPLE, TRIAL, PROBES, AIM = 20_000, 10_000, 200, 0.96
#: Most centroids of a half, and about how many entries a block holds.
MOST_CENTROIDS, BLOCK = 256, 4_096


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T)


def _centroids(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from a fixed random start."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], len(c)) / np.maximum(n, 1), c[:, j])
    return c


class MultiIndex:
    """Two codebooks, one for each half of a vector; an entry's cell is the pair of its nearest centroids."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = sample.shape[1] // 2
        self.books = [_centroids(h, centroids) for h in (sample[:, : self.half], sample[:, self.half :])]
        self.width = len(self.books[1])
        self.cells = len(self.books[0]) * self.width
        self.sample = sample.astype(np.float32)
        self.norms = (self.sample * self.sample).sum(1)
        self.radii = np.full(self.cells, np.inf)

    def bound(self, q: np.ndarray, k: int) -> float:
        """A distance within which k entries lie for certain, as so many of the sample do."""
        if len(self.sample) < k:
            return np.inf
        square = float(q @ q)
        d = self.norms - 2 * (self.sample @ q.astype(np.float32)) + np.float32(square)
        slack = 1e-4 * (float(self.norms.max()) + square)  # far more than single precision loses
        near = float(np.partition(d, k - 1)[k - 1]) + slack
        return math.sqrt(max(0.0, near)) if math.isfinite(near) else np.inf  # values beyond single precision give no bound

    def spread(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Distances of vectors from the centroid pairs of their cells."""
        a, b = self.books[0][cells // self.width], self.books[1][cells % self.width]
        return np.sqrt(((x - np.concatenate([a, b], 1)) ** 2).sum(1))

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = (_distances(h, c).argmin(1) for h, c in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True))
        return a * self.width + b

    def traverse(self, q: np.ndarray, counts: np.ndarray, want: float, bound: float = np.inf) -> list[int]:
        """Cells by the sum of their halves' distances from q, nearest first, until they hold `want` entries. Cells all of whose
        entries are beyond the bound, as the cell's radius says, count as looked at but are left out.

        Both lists of centroids are sorted by distance; a heap holds the pairs on the frontier, of which the pairs beyond
        are pushed when both of their predecessors were taken.
        """
        a, b = (_distances(h[None], c)[0] for h, c in zip((q[: self.half], q[self.half :]), self.books, strict=True))
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db = a[oa].tolist(), b[ob].tolist()
        oa, ob = oa.tolist(), ob.tolist()
        reach = [0] * len(da)  # how many pairs of each row were taken
        heap, out, have = [(da[0] + db[0], 0, 0)], [], 0
        far = (bound + float(self.radii.max())) ** 2
        while heap and have < want:
            d, i, j = heapq.heappop(heap)
            if d > far:  # all further cells are beyond the bound
                break
            reach[i] = j + 1
            cell = oa[i] * self.width + ob[j]
            if counts[cell]:
                if d <= (bound + self.radii[cell]) ** 2:
                    out.append(cell)
                have += counts[cell]
            if j + 1 < len(db) and (i == 0 or reach[i - 1] > j + 1):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if i + 1 < len(da) and reach[i + 1] == j:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        return out

    def share(self, sample: np.ndarray, aim: float = AIM) -> float:
        """The least share of entries whose visit finds `aim` of the true neighbours, on a trial of the sample."""
        trial = sample[:TRIAL]
        probes = np.arange(0, len(trial), max(1, len(trial) // PROBES))
        d = _distances(trial[probes], trial)
        d[np.arange(len(probes)), probes] = np.inf
        k = min(NEIGHBOURS, len(trial) - 1)
        if k < 1:
            return 1.0
        true = np.argpartition(d, k - 1, 1)[:, :k]
        cells = self.cell(trial)
        counts = np.bincount(cells, minlength=self.cells)
        need = []
        for i, p in enumerate(probes):
            order = self.traverse(trial[p], counts.tolist(), np.inf)
            seen = np.cumsum(counts[order]) - counts[order]
            place = np.full(self.cells, len(trial))
            place[order] = seen
            need += place[cells[true[i]]].tolist()
        return min(1.0, (float(np.quantile(need, aim)) + 1) / len(trial))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def _assign(index: MultiIndex, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            cells = index.cell(x).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            spread = index.spread(x, cells) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(spread)], names=["first", "v", "ids", "cell", "spread"])

    return run


def _visit(index: MultiIndex, width: int, most: int, counts: list[int], want: float, starts: np.ndarray, parts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                q = _matrix(part.column(1), width)[0]
                cells = np.array(index.traverse(q, counts, want, index.bound(q, most)), np.int64)
                blocks = np.repeat(starts[cells], parts[cells])
                blocks += np.arange(len(blocks)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                owners = np.repeat(cells, parts[cells])
                order = np.argsort(blocks, kind="stable")
                distinct, first = np.unique(blocks[order], return_index=True)
                lists = np.split(owners[order].astype(np.int32), first[1:]) if len(distinct) else []
                n = len(distinct)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(distinct.astype(np.int32)),
                        pa.array([1] * n, pa.int32()),
                        pa.array(part.column(0).to_pylist() * n, pa.int64()),
                        pa.array([None] * n, pa.int32()),
                        pa.array(lists, pa.list_(pa.int32())),
                        pa.array(part.column(1).to_pylist() * n, part.column(1).type),
                    ],
                    names=["block", "kind", "first", "cell", "cells", "v"],
                )

    return run


def _rerank(width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by block, entries before queries: each query's nearest entries of the visited cells."""
        block, held = None, []
        entries = None
        for batch in batches:
            blocks, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            firsts = batch.column(2).to_numpy()
            v = _matrix(batch.column(5), width)
            found: list[tuple] = []
            for i in range(batch.num_rows):
                if blocks[i] != block:
                    block, held, entries = blocks[i], [], None
                if kinds[i] == 0:
                    held.append((firsts[i], batch.column(3)[i].as_py(), v[i].copy()))
                    continue
                if entries is None:
                    entries = (
                        np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64),
                        np.stack([h[2] for h in held]) if held else np.zeros((0, width)),
                    )
                ids, cells, x = entries
                chosen = np.flatnonzero(np.isin(cells, batch.column(4)[i].values.to_numpy()))
                d = np.sqrt(((x[chosen] - v[i]) ** 2).sum(1))
                if len(d) > most:
                    near = d <= np.partition(d, most - 1)[most - 1]
                    chosen, d = chosen[near], d[near]
                order = np.lexsort((ids[chosen], d))[:most]
                found += [(firsts[i], int(ids[chosen[k]]), float(d[k])) for k in order]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                names=["query", "entry", "distance"],
            )

    return run


def nearest(vectors: DataFrame, step: int = QUERY_STEP, k: int = NEIGHBOURS, share: float | None = None) -> DataFrame:
    """The k nearest rows of (vec_id, embedding) for every row whose vec_id is divisible by `step`.

    Rows of one vector become one entry with its k + 1 least ids, which is all that any result can hold; they are ranked
    within salted groups first, so that a very common vector meets in no single task. Codebooks are fitted on a bounded
    sample. A query visits cells by summed distance, through a heap, until they hold `share` of all entries (None: the share
    that gives a recall of AIM on a trial of the sample); of these, cells that can't hold a neighbour, by their radius and the
    distances of the sample, are left out. Cells form blocks of bounded size, large cells several; each query
    goes to each block once with the list of its cells there, and is reranked on the original vectors in double precision.

    Null vectors, vectors with null, NaN or infinite components, zero vectors and null ids take no part; vectors shorter than the
    longest count as if zeros followed. Ties go to the smaller vec_id. Rows with equal vec_ids and equal vectors count
    once; a vec_id of several vectors is several entries. With fewer candidates than k, all are returned. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    # float components stay as they are, all others are read as doubles, so scores are those of the original vectors
    given = vectors.schema["embedding"].dataType
    kind = "float" if getattr(given, "elementType", None) == T.FloatType() else "double"
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    schema = "query_id long, rank int, vec_id long, score double"
    width = clean.agg(F.max(F.size(v))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    padded = F.concat(v, F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size(v)))
    clean = clean.select("id", F.when(F.size(v) < width, padded).otherwise(v).alias("v")).distinct()
    salted = Window.partitionBy("v", F.pmod("id", F.lit(64))).orderBy("id")
    few = clean.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= k + 1)
    points = few.groupBy("v").agg(
        F.min("id").alias("first"), F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")
    )
    points = stored(spark, points.select("first", "v", "ids"), "neighbours-points")
    n = points.count()
    chosen = points.orderBy(F.xxhash64("v"), "first").limit(SAMPLE).select("v").collect()  # SAMPLE vectors at most
    sample = np.array([r["v"] for r in chosen], np.float64)
    centroids = int(min(MOST_CENTROIDS, max(2, 2 ** int(np.log2(max(4.0, np.sqrt(n) / 2))))))
    index = MultiIndex(sample, centroids)
    share = index.share(sample) if share is None else share
    placed = points.mapInArrow(tidy(_assign(index, width)), f"first long, v array<{kind}>, ids array<long>, cell int, spread double")
    placed = stored(spark, placed, "neighbours-cells")

    # at most MOST_CENTROIDS ** 2 counts
    counts = np.zeros(index.cells, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("spread").alias("radius")).collect():
        counts[r["cell"]], index.radii[r["cell"]] = r["n"], r["radius"]
    index.radii[counts == 0] = 0.0
    # a cell lies in one block of several small cells, or, if large, in blocks of its own
    starts, parts, block, load = np.zeros(index.cells, np.int64), np.ones(index.cells, np.int64), 0, 0
    for c in np.flatnonzero(counts):
        if load and load + counts[c] > BLOCK:
            block, load = block + 1, 0
        starts[c] = block
        if counts[c] > BLOCK:
            parts[c] = -(-counts[c] // BLOCK)
            block, load = block + parts[c], 0
        else:
            load += counts[c]
    table_of = spark.createDataFrame(
        [(int(c), int(starts[c]), int(parts[c])) for c in np.flatnonzero(counts)], "cell int, start int, parts int"
    )
    entries = placed.join(F.broadcast(table_of), "cell").select(  # as many rows as cells
        (F.col("start") + F.pmod(F.xxhash64("v"), F.col("parts").cast("long"))).cast("int").alias("block"),
        F.lit(0).alias("kind"), "first", "cell", F.lit(None).cast("array<int>").alias("cells"), "v",
    )
    asking = clean.filter(F.col("id") % step == 0)
    own = points.select("first", F.col("v").alias("w"))
    queries = stored(spark, asking.join(own, F.col("v") == F.col("w")).select("id", F.col("first").alias("query"), "v"), "neighbours-queries")
    want = max(share * n, 4.0 * (k + 1))
    distinct = queries.select("query", "v").distinct()
    visits = distinct.repartition(max(distinct.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism), "query").mapInArrow(
        _visit(index, width, k + 1, counts.tolist(), want, starts, parts),
        f"block int, kind int, first long, cell int, cells array<int>, v array<{kind}>",
    )
    near = (
        entries.unionByName(visits)
        .repartition("block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(tidy(_rerank(width, k + 1)), "query long, entry long, distance double")
    )
    best = Window.partitionBy("query").orderBy("distance", "entry")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    full = near.join(points.select(F.col("first").alias("entry"), "ids"), "entry").select(
        "query", "distance", F.explode("ids").alias("vec_id")
    )
    within = Window.partitionBy("query").orderBy("distance", "vec_id")
    full = full.withColumn("place", F.row_number().over(within)).filter(F.col("place") <= k + 1)
    last = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    answers = (
        queries.select(F.col("id").alias("query_id"), "query")
        .distinct()
        .join(full.drop("place"), "query")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(last))
        .filter(F.col("rank") <= k)
    )
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
