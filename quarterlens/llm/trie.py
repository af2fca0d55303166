"""The trie of conversations that begin alike, from the LCP array of the sorted conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, ship, stored, table, tidy

#: Bytes that stand for a turn; turns in a block; bytes of conv_ids that are passed on together.
MARK, BLOCK_TURNS, CHUNK = 16, 200_000, 1 << 20
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, marks, sizes): each conversation's turns in order, as 128-bit digests of (role, text) one after the other, and
    the UTF-8 bytes of the texts. Texts do not move. A conversation is one row, of some 24 bytes a turn."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(conversations["turn"].alias("turn"), F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * MARK).alias("mark"), F.octet_length(text).alias("size")).alias("t"),
    ).filter("conv_id IS NOT NULL")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, marks, sizes) where conversation c begins with the first h = crc32(c) % most turns of c - c % every."""
    own = sequences(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("t", 1, most).alias("first"))
    joined = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).join(heads, "head", "left")
    turns = F.expr("concat(coalesce(slice(first, 1, h), slice(t, 1, 0)), slice(t, h + 1, size(t)))")
    return joined.select("conv_id", turns.alias("t")).select(
        "conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["mark"]), "")).alias("marks"), F.transform("t", lambda x: x["size"]).alias("sizes")
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows, and whether each has other marks than the row before it."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            yield row["marks"] != last, row
            last = row["marks"]


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[dict] = []
    size = 0
    for row in rows:
        waiting.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes | str | list))
        if len(waiting) >= 5000 or size > CHUNK:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


_CHUNKS = pa.schema({"marks": pa.binary(), "sizes": pa.list_(pa.int32()), "low": pa.int64(), "n": pa.int64(), "members": pa.string()})
_LEAVES = pa.schema({"block": pa.int32(), "marks": pa.binary(), "sizes": pa.list_(pa.int32()), "low": pa.int64(), "n": pa.int64(), "ends": pa.string()})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (marks, conv_id): equal conversations as one row, or a row for each CHUNK bytes of their conv_ids."""

    def rows() -> Iterator[dict]:
        held, ids, size = None, [], 0
        for new, row in _runs(batches):
            if held is not None and (new or size > CHUNK):
                yield held | {"n": len(ids), "members": ",".join(ids)}
                held = None
            if held is None:
                held, ids, size = {"marks": row["marks"], "sizes": row["sizes"], "low": row["conv_id"]}, [], 0
            ids.append(str(row["conv_id"]))
            size += len(ids[-1]) + 1
        if held is not None:
            yield held | {"n": len(ids), "members": ",".join(ids)}

    return _batches(rows(), _CHUNKS)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted chunks: one row for each different conversation, with its members' hash, which goes over the chunks as they come."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        held, digest = None, None
        for new, row in _runs(batches):
            if new:
                if held is not None:
                    yield held | {"ends": digest.hexdigest()}
                held, digest = {"block": block, "marks": row["marks"], "sizes": row["sizes"], "low": row["low"], "n": 0}, hashlib.sha256()
            else:
                digest.update(b",")
            held["n"] += row["n"]
            digest.update(row["members"].encode())
        if held is not None:
            yield held | {"ends": digest.hexdigest()}

    return _batches(rows(), _LEAVES)


def leaves(conversations: DataFrame) -> DataFrame:
    """(block, marks, sizes, low, n, ends): the different conversations, range-partitioned by their marks into blocks, with how
    many share one, the least conv_id and the hash of all conv_ids. A hot conversation's members are spread by conv_id
    first and meet as chunks of a megabyte; only the hash itself, which no method can part, goes over them in one task."""
    spark = conversations.sparkSession
    whole = stored(spark, rebuilt(conversations), "trie-rebuilt")
    turns = whole.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    chunks = whole.repartitionByRange(parts, "marks", "conv_id").sortWithinPartitions("marks", "conv_id").mapInArrow(tidy(_chunks), "marks binary, sizes array<int>, low long, n long, members string")
    chunks = stored(spark, chunks, "trie-chunks")
    out = chunks.repartitionByRange(parts, "marks").sortWithinPartitions("marks", "low").mapInArrow(tidy(_leaves), "block int, marks binary, sizes array<int>, low long, n long, ends string")
    out = stored(spark, out, "trie-leaves")
    discard(whole, chunks)
    return out


def nearest_smaller(values: list[int], strict: bool = True) -> list[int]:
    """For each place the next one with a smaller value (or, if not strict, with one no larger); len(values) if there is none."""
    out, open_ = [len(values)] * len(values), []
    for place, value in enumerate(values):
        while open_ and (values[open_[-1]] > value or not strict and values[open_[-1]] == value):
            out[open_.pop()] = place
        open_.append(place)
    return out


def equal_runs(values: list[int], counts: list[int]) -> list[int]:
    """For each place the sum of counts of the places with its value from there on, until a smaller value comes."""
    following, out = nearest_smaller(values, False), list(counts)
    for place in range(len(values) - 1, -1, -1):
        after = following[place]
        if after < len(values) and values[after] == values[place]:
            out[place] += out[after]
    return out


class Least:
    """Least values of ranges, from those of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows, width = [np.asarray(values, np.int64)], 1
        while 2 * width <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-width], self.rows[-1][width:]))
            width *= 2

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of start to end, the latter exclusive and larger."""
        level = np.frexp((end - start).astype(float))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][start[at]], self.rows[k][end[at] - (1 << int(k))])
        return out


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences of marks share from their beginning."""
    at, most = 0, min(len(a), len(b))
    while at < most and a[at : at + MARK] == b[at : at + MARK]:
        at += MARK
    return at // MARK


_PIECES = pa.schema({
    "kind": pa.string(), "block": pa.int32(), "depth": pa.int32(), "conv_id": pa.int64(), "parent": pa.int64(), "above": pa.string(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "bytes": pa.int64(), "saved": pa.int64(), "ends": pa.string(),
})
_PIECES_SQL = "kind string, block int, depth int, conv_id long, parent long, above string, n_convs long, n_children long, n_leaves long, bytes long, saved long, ends string"


def block_pieces(block: int, marks: list[bytes], sizes: list[list[int]], n: np.ndarray, low: np.ndarray, ends: list[str], before: bytes | None, after: bytes | None) -> pa.Table:
    """Nodes and parts of nodes of one block of sorted, different conversations; before and after are those next to the block.

    lcp[i] is what conversations i - 1 and i share, -1 at either end of all. Conversation i is the first of the nodes of depths
    lcp[i] + 1 to its length, and a node of depth d ends where a smaller lcp than d comes next. Following the nearest smaller values
    from i + 1 on gives these places, and the depths that end there share one interval (an edge of the compressed tree), from which all
    missing depths are expanded. Values that are equal are children of one node.

    kind 'node': ended here. 'open': begun here, not ended. 'shut': what this block adds to a node begun before it that ends here.
    'need': a depth at which a node begun before is a parent here. 'sum': the least lcp (as depth), how often it comes, and totals.
    above: where the parent must be looked up, at the depth above: among the nodes 'open' here or those begun 'before'.
    """
    m = len(marks)
    ring = [before, *marks, after]
    lcp = [-1 if a is None or b is None else common_turns(a, b) for a, b in zip(ring, ring[1:], strict=False)]
    length = [len(x) // MARK for x in marks]
    right, inner = nearest_smaller(lcp), lcp[:m]
    left = [m - x for x in nearest_smaller([*inner[::-1]])]  # 1 more than the last smaller one before, of the reversed places
    left = [left[m - 1 - i] - 1 for i in range(m)]
    equal = equal_runs(inner, [1] * m)

    # every node by its first conversation and its depth
    count = np.array([length[i] - lcp[i] for i in range(m)])
    base = np.append(0, np.cumsum(count))
    first = np.repeat(np.arange(m), count)
    depth = np.arange(base[-1]) - base[:-1][first] + np.array(inner)[first] + 1
    end, more = np.full(base[-1], m), np.zeros(base[-1], np.int64)
    is_open = np.zeros(base[-1], bool)
    for i in range(m):
        floor, top, j, extra = lcp[i], length[i], i + 1, 0
        while True:
            stop = max(floor, lcp[j]) if j <= m else floor
            if top > stop:
                at = slice(base[i] + stop - floor, base[i] + top - floor)
                end[at], is_open[at] = min(j, m), j > m
                more[at.stop - 1] = extra
            if stop == floor:
                break
            top, extra = stop, equal[j] if j < m else 0
            j = right[j] if j < m else m + 1

    weight, childless = np.append(0, np.cumsum(n)), np.array([lcp[i + 1] < length[i] for i in range(m)])
    leaf = np.append(0, np.cumsum(childless))
    least = Least(low)
    n_convs, conv = weight[end] - weight[first], least.get(first, end)
    size = np.fromiter((sizes[i][d - 1] if d else 0 for i, d in zip(first.tolist(), depth.tolist(), strict=True)), np.int64, len(first))
    value = np.where(is_open, 0, (n_convs - 1) * size)
    suffix = np.append(np.cumsum(value[::-1])[::-1], 0)
    saved_before = suffix[0] - suffix[base]  # of nodes that end here, by their first conversation
    own = suffix[:-1] - suffix[base[1:]][first]
    saved = np.where(is_open, saved_before[m] - saved_before[first], own + saved_before[end] - saved_before[np.minimum(first + 1, m)])

    at_top = depth == np.array(inner)[first] + 1
    begun = np.array(left)[first]  # the conversation that the parent of a topmost node is first of
    parent_at = np.where(at_top, np.where(begun >= 0, base[np.maximum(begun, 0)] + depth - 2 - np.array(inner)[np.maximum(begun, 0)], -1), np.arange(len(first)) - 1)
    root = depth == 0
    known = (parent_at >= 0) & ~root & ~is_open[np.maximum(parent_at, 0)]
    above = np.where(root | known, None, np.where(parent_at >= 0, "open", "before"))
    reached = np.array(length)[first]
    ended = np.array(ends, object)
    nodes = pa.table({
        "kind": pa.array(np.where(is_open, "open", "node").tolist(), pa.string()), "block": pa.array(np.full(len(first), block), pa.int32()),
        "depth": pa.array(depth, pa.int32()), "conv_id": conv, "parent": pa.array(conv[np.maximum(parent_at, 0)], mask=~known),
        "above": pa.array(above.tolist(), pa.string()), "n_convs": n_convs, "n_children": (depth < reached) + more, "n_leaves": leaf[end] - leaf[first],
        "bytes": size, "saved": saved, "ends": pa.array(np.where(depth == reached, ended[first], NOBODY).tolist(), pa.string()),
    }).cast(_PIECES)

    blank = dict.fromkeys(_PIECES.names)
    rest = [blank | {"kind": "need", "block": block, "depth": d} for d in {lcp[i] for i in range(m) if left[i] < 0 and lcp[i] >= 0}]
    smallest = min(inner)
    top, j = lcp[0], 0
    while top > smallest:
        to = right[j]
        piece = {"kind": "shut", "block": block, "conv_id": int(low[:to].min()), "n_convs": int(weight[to]), "n_leaves": int(leaf[to]), "saved": int(saved_before[to])}
        rest += [blank | piece | {"depth": d, "n_children": equal[j] if d == top else 0} for d in range(lcp[to] + 1, top + 1)]
        top, j = lcp[to], to
    rest.append(blank | {
        "kind": "sum", "block": block, "depth": smallest, "conv_id": int(low.min()), "n_convs": int(weight[m]), "n_children": inner.count(smallest),
        "n_leaves": int(leaf[m]), "saved": int(saved_before[m]),
    })
    return pa.concat_tables([nodes, pa.Table.from_pylist(rest, _PIECES)])


def _pieces(rows: pa.Table, edge: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _PIECES.empty_table()
    rows = rows.take(pc.sort_indices(rows["marks"]))
    place, before, after = (edge[c][0].as_py() for c in ("place", "before", "after"))
    columns = [rows[c].to_pylist() for c in ("marks", "sizes", "ends")]
    return block_pieces(place, columns[0], columns[1], rows["n"].to_numpy(), rows["low"].to_numpy(), columns[2], before, after)


class Blocks:
    """The blocks' least lcps and totals, a row each: what lies between the block in which a node begins and that in which it ends."""

    def __init__(self, sums: list):
        self.n, self.depth = len(sums), [r["depth"] for r in sums]
        self.right = nearest_smaller(self.depth)
        self.left = [self.n - 1 - x for x in nearest_smaller(self.depth[::-1])][::-1]
        self.equal = equal_runs(self.depth, [r["n_children"] for r in sums])
        self.convs, self.leaves = (np.append(0, np.cumsum([r[c] for r in sums])) for c in ("n_convs", "n_leaves"))
        self.least = Least(np.array([r["conv_id"] for r in sums], np.int64))

    def ends(self, block: int, depth: int) -> tuple[int, int]:
        """The next block with a smaller lcp than depth, and how many lcps equal to depth are in the blocks before it."""
        at, children = block + 1, 0
        while at < self.n and self.depth[at] >= depth:
            children += self.equal[at] if self.depth[at] == depth else 0
            at = self.right[at]
        return at, children

    def begins(self, block: int, depth: int) -> int:
        """The block in which the node of that depth, open when `block` begins, has begun."""
        at = block - 1
        while self.depth[at] >= depth:
            at = self.left[at]
        return at

    def between(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to open nodes what the blocks that they span add; `until` is the block in which they end."""
        for batch in batches:
            block, depth = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            found = [self.ends(b, d) for b, d in zip(block.tolist(), depth, strict=True)]
            until = np.array([x[0] for x in found], np.int64)
            table_ = pa.Table.from_batches([batch])
            whole, low = until > block + 1, table_["conv_id"].to_numpy().copy()
            if whole.any():
                low[whole] = np.minimum(low[whole], self.least.get(block[whole] + 1, until[whole]))
            new = {
                "conv_id": low, "n_convs": table_["n_convs"].to_numpy() + self.convs[until] - self.convs[block + 1],
                "n_children": table_["n_children"].to_numpy() + np.array([x[1] for x in found], np.int64),
                "n_leaves": table_["n_leaves"].to_numpy() + self.leaves[until] - self.leaves[block + 1],
            }
            for name, column in new.items():
                table_ = table_.set_column(table_.schema.get_field_index(name), name, pa.array(column, pa.int64()))
            yield from table_.append_column("until", pa.array(until, pa.int32())).to_batches()

    def owners(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = [self.begins(b, d) for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owner, pa.int32())], ["block", "depth", "owner"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt, sorted by their turns' digests and cut into blocks. Each block finds the nodes that begin and end in it,
    from nearest smaller values of its LCP array; nodes that go over its ends are put together from parts. For these, one row
    a block, its least lcp and its totals, comes to the driver (as many rows as partitions); the parts themselves, at most a path's
    length a block, are joined as tables.

    Turns are ordered by turn, null first, and turns that tie by their digest. Rows without a conv_id take no part; null role
    or text is empty. Repeated rows are turns of their own. An empty table gives no rows. Further columns are ignored.
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = leaves(conversations)
    order = Window.orderBy("block")  # a row a block
    edges = rows.groupBy("block").agg(F.min("marks").alias("a"), F.max("marks").alias("b")).select(
        "block", (F.row_number().over(order) - 1).alias("place"), F.lag("b").over(order).alias("before"), F.lead("a").over(order).alias("after")
    )
    pieces = rows.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_pieces, _PIECES_SQL)
    pieces = stored(spark, pieces, "trie-pieces")
    discard(rows)
    sums = pieces.filter("kind = 'sum'").select("block", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved").orderBy("block").collect()
    blocks = Blocks(sums)

    shut = pieces.filter("kind = 'shut'").select(
        F.col("block").alias("until"), "depth", *(F.col(c).alias(f"{c}_") for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved"))
    )
    spanning = pieces.filter("kind = 'open'").mapInArrow(blocks.between, _PIECES_SQL + ", until int").join(shut, ["until", "depth"], "left")
    plus = lambda c: (F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c)
    opened = spanning.select(
        "block", "depth", "until", F.least("conv_id", "conv_id_").alias("conv_id"), "above", *map(plus, ("n_convs", "n_children", "n_leaves", "saved")), "bytes", "ends"
    ).withColumn("value", F.expr("(n_convs - 1) * bytes"))
    opened = stored(spark, opened, "trie-open")
    values = dict(opened.groupBy("block").agg(F.sum("value")).collect())  # a row a block
    total = np.append(0, np.cumsum([r["saved"] + values.get(r["block"], 0) for r in sums])).astype(np.int64)

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, until = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column(batch.num_columns - 1).to_numpy() + total[until] - total[block + 1])], batch.schema.names)

    below = F.sum("value").over(Window.partitionBy("block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nested = opened.select("block", "until", "depth", "conv_id", "above", "n_convs", "n_children", "n_leaves", "ends", (F.col("saved") + below).alias("saved"))
    nested = nested.mapInArrow(whole_blocks, "block int, until int, depth int, conv_id long, above string, n_convs long, n_children long, n_leaves long, ends string, saved long")

    here = opened.select("block", F.lit("open").alias("above"), "depth", F.col("conv_id").alias("found"))
    needs = pieces.filter("kind = 'need'").select("block", "depth").mapInArrow(blocks.owners, "block int, depth int, owner int")
    earlier = needs.join(here.select(F.col("block").alias("owner"), "depth", "found"), ["owner", "depth"]).select("block", F.lit("before").alias("above"), "depth", "found")
    path = here.unionByName(earlier).withColumn("depth", F.col("depth") + 1)
    columns = ["block", "above", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    ended = pieces.filter("kind = 'node'")
    unknown = ended.filter("above IS NOT NULL").select(*columns).unionByName(nested.select(*columns)).join(path, ["block", "above", "depth"], "left")

    def result(df: DataFrame, parent: str) -> DataFrame:
        as_long = lambda c, name=None: F.col(c).cast("long").alias(name or c)
        return df.select("conv_id", as_long("depth"), as_long(parent, "parent_conv_id"), "n_convs", "n_children", "n_leaves", as_long("saved", "saved_tokens"), F.col("ends").alias("ends_sha256"))

    return result(ended.filter("above IS NULL"), "parent").unionByName(result(unknown, "found"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
  lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS t),
c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), k),
x AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS b FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS p FROM x),
r AS (SELECT c.conv_id, x, b, p FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND p <= h
  UNION ALL SELECT c.conv_id, x, b, p FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
q AS (SELECT conv_id, b, row_number() OVER w AS depth, string_agg(x, '') OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS size FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
m AS (SELECT conv_id, b, depth, path, depth = size AS last FROM q
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY depth, path),
s AS (SELECT depth, path, (SELECT count(*) FROM n y WHERE y.depth = n.depth + 1 AND y.path[:64 * n.depth] = n.path) AS n_children, (n_convs - 1) * b AS v FROM n),
a AS (SELECT unnest(range(depth + 1)) AS up, path, n_children, v FROM s),
u AS (SELECT up AS depth, path[:64 * up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(v) AS saved_tokens FROM a GROUP BY ALL)
SELECT n.conv_id, n.depth, z.conv_id AS parent_conv_id, n.n_convs, s.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.path = n.path JOIN u ON u.depth = n.depth AND u.path = n.path
LEFT JOIN n z ON z.depth = n.depth - 1 AND z.path = n.path[:64 * (n.depth - 1)]
"""
