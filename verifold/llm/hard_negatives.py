"""Hard negatives by exact inner-product search in STR-packed R-trees.

Rows are dealt to tiles by sort-tile-recursive packing: slabs of one coordinate, ranges of a second one
in each slab, and inside a tile by label and further coordinates. Each tile is one row of the
index with its own R-tree: leaves of ``LEAF_ROWS`` rows below nodes of ``FANOUT`` leaves, each with the
least and greatest value of every coordinate. These give an interval that holds all inner
products of a query with the rows of a box.

Queries go over all tiles in blocks that are small enough to send to every task. In a tile each
query has a queue of boxes: it opens the one with the highest possible score first, leaves out
boxes outside its window or without a fitting label, and is done once the rest lies strictly
below the last score that it keeps. Queries that open the same box are multiplied in one go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verifold.llm.storage import Table, free, save
from verifold.llm.words import tidy

TILE_ROWS, LEAF_ROWS, FANOUT = 4096, 64, 16
#: Anchors of one pass over the index; each has a window for each of its positives in the second pass.
BLOCK_ANCHORS = 8192
#: Queries that a task works on at once.
CHUNK = 1024
#: Components are stored in 32 bits.
MOST = 1 << 31
NEVER = -(1 << 62)
INDEX_SCHEMA = "tile long, n int, dims int, most long, ids array<long>, labels array<long>, vectors binary"
FOUND_SCHEMA = "query long, id long, score long"
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """id, label, v (floor of scale times each component) of the rows that take part: id, label and all components known and finite."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).where(~F.coalesce(odd, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones get zeros at the end."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0)) if dims is None else dims
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _spread(rows: DataFrame) -> list[int]:
    """Coordinates by falling variance; sums of each task come together, a row for each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v")).astype(np.float64)
            k = m.shape[1]
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(k), pa.int32()), "n": pa.array([len(m)] * k, pa.float64()), "s": pa.array(m.sum(axis=0)), "q": pa.array((m * m).sum(axis=0))})

    sums = rows.select("v").mapInArrow(run, "i int, n double, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    by = sums.select("i", (F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("var")).orderBy(F.desc("var"), "i")
    return [r["i"] for r in by.collect()]  # one for each coordinate


def _str_order(keys: list[np.ndarray], leaf: int) -> np.ndarray:
    """Order of rows by sort-tile-recursive packing: slabs of the first key, each packed by the rest."""
    n = len(keys[0])
    if len(keys) == 1 or n <= leaf:
        return np.argsort(keys[0], kind="stable")
    slabs = max(1, round(math.ceil(n / leaf) ** (1 / len(keys))))
    size = -(-n // slabs)
    order = np.argsort(keys[0], kind="stable")
    parts = (order[i : i + size] for i in range(0, n, size))
    return np.concatenate([p[_str_order([k[p] for k in keys[1:]], leaf)] for p in parts])


def build_index(rows: DataFrame, tile_rows: int = TILE_ROWS) -> Table:
    """Write the index of ``quantised`` rows: one row a tile. Rows of one vector are kept apart by their id, so copies fill as many tiles as they need."""
    n = rows.count()
    by = _spread(rows) if n else []
    tiles = max(1, -(-n // tile_rows))
    at = lambda i: F.coalesce(F.try_element_at("v", F.lit(i + 1)), F.lit(0)) if by else F.lit(0)
    first, second = at(by[0] if by else 0), at(by[1 % len(by)] if by else 0)
    cuts = [i / s for i in range(1, s)] if (s := math.isqrt(tiles)) > 1 else []
    bounds = rows.select(F.percentile_approx(first, F.array(*map(F.lit, cuts)), 10_000)).first()[0] if cuts else []  # at most the root of the number of tiles
    slab = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < first)) if bounds else F.lit(0)
    inner = by[2:4] or by[:1] or [None]

    def tile(table: pa.Table, number: int) -> pa.RecordBatch:
        m = _matrix(_one(table.column("v")))
        most = int(np.abs(m).max(initial=0))
        if most >= MOST:
            raise ValueError(f"a component reaches {most}: it doesn't fit 32 bits")
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        keys = [labels, *(m[:, c] if c is not None and c < m.shape[1] else labels for c in inner)]
        order = by_id[_str_order([k[by_id] for k in keys], LEAF_ROWS)]
        one = {"tile": number, "n": len(m), "dims": m.shape[1], "most": most, "ids": ids[order], "labels": labels[order], "vectors": np.ascontiguousarray(m[order].astype("<i4")).tobytes()}
        return pa.RecordBatch.from_pylist([one], schema=pa.schema([("tile", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("most", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in tidy(batches):
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, tile_rows - size)
                held.append(part)
                size, start = size + part.num_rows, start + part.num_rows
                if size == tile_rows:
                    yield tile(pa.Table.from_batches(held), number)
                    held, size, number = [], 0, number + 1
        if held:
            yield tile(pa.Table.from_batches(held), number)

    dealt = rows.withColumns({"slab": slab, "second": second}).repartitionByRange(tiles, "slab", "second", "id").sortWithinPartitions("slab", "second", "id")
    return save(dealt.select("id", "label", "v").mapInArrow(run, INDEX_SCHEMA), "vector_index")


class Tile(NamedTuple):
    """Rows of a tile and the boxes of its R-tree: inner nodes first, then leaves; children of node i are leaves i * FANOUT and on."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    nodes: int
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    least_id: np.ndarray


def open_tile(ids: np.ndarray, labels: np.ndarray, raw: bytes, dims: int, dtype) -> Tile:
    v = np.frombuffer(raw, dtype="<i4").reshape(len(ids), dims).astype(dtype)
    starts = np.arange(0, len(ids), LEAF_ROWS)
    groups = np.arange(0, len(starts), FANOUT)
    both = lambda f, x: np.concatenate([f.reduceat(own := f.reduceat(x, starts), groups), own])
    return Tile(ids, labels, v, len(groups), np.append(starts, len(ids)), both(np.minimum, v), both(np.maximum, v), both(np.minimum, labels), both(np.maximum, labels), both(np.minimum, ids))


class Queries(NamedTuple):
    """A block of searches: vectors, own label and id, and the scores wanted. same: rows of the own label (but the own id), else of other labels."""

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def take(self, at: slice) -> Queries:
        return self._replace(vectors=self.vectors[at], labels=self.labels[at], ids=self.ids[at], low=self.low[at], high=self.high[at])


class Best:
    """The k best (score, id) of each query so far, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int, dtype):
        self.scores = np.full((n, k), NEVER, dtype=dtype)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def merge(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.scores[at], scores], axis=1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.scores.shape[1]]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(t: Tile, q: Queries, best: Best, first: int = 0) -> int:
    """Best-first search of one tile for a chunk of queries, whose results stand in ``best`` from row ``first``. Returns the number of (query, leaf) pairs opened."""
    n, leaves, opened = len(q.ids), len(t.starts) - 1, 0
    if not n or not leaves:
        return 0
    v = q.vectors.astype(t.vectors.dtype)
    plus, minus = np.maximum(v, 0), np.minimum(v, 0)
    queue = np.full((n, t.nodes + leaves), NEVER, dtype=t.vectors.dtype)

    def push(rows: np.ndarray, boxes: slice) -> None:
        """Put boxes into the queues of queries, by their highest possible score; boxes that can't hold a wanted row stay out."""
        top = plus[rows] @ t.high[boxes].T + minus[rows] @ t.low[boxes].T
        bottom = plus[rows] @ t.low[boxes].T + minus[rows] @ t.high[boxes].T
        own = q.labels[rows, None]
        fits = (t.label_low[boxes] <= own) & (own <= t.label_high[boxes]) if q.same else (t.label_low[boxes] != own) | (t.label_high[boxes] != own)
        last, last_id = best.scores[first + rows, -1][:, None], best.ids[first + rows, -1][:, None]
        fits &= (top >= q.low[rows, None]) & (bottom <= q.high[rows, None]) & ((top > last) | (top == last) & (t.least_id[boxes] < last_id))
        queue[rows[:, None], np.arange(boxes.start, boxes.stop)] = np.where(fits, top, NEVER)

    push(np.arange(n), slice(0, t.nodes))
    live = np.arange(n)
    while True:
        pick = queue[live].argmax(axis=1)
        top = queue[live, pick]
        going = (top > NEVER) & (top >= best.scores[first + live, -1])
        live, pick = live[going], pick[going]
        if not len(live):
            return opened
        queue[live, pick] = NEVER
        order = np.argsort(pick, kind="stable")
        boxes, at = np.unique(pick[order], return_index=True)
        for box, rows in zip(boxes.tolist(), np.split(live[order], at[1:]), strict=True):
            if box < t.nodes:
                push(rows, slice(t.nodes + box * FANOUT, min(t.nodes + (box + 1) * FANOUT, t.nodes + leaves)))
                continue
            opened += len(rows)
            own = slice(t.starts[box - t.nodes], t.starts[box - t.nodes + 1])
            scores = v[rows] @ t.vectors[own].T
            ids = t.ids[own]
            good = t.labels[own] == q.labels[rows, None]
            good = good & (ids != q.ids[rows, None]) if q.same else ~good
            last = best.scores[first + rows, -1][:, None]
            good &= (scores >= q.low[rows, None]) & (scores <= q.high[rows, None]) & ((scores > last) | (scores == last) & (ids < best.ids[first + rows, -1][:, None]))
            better = good.any(axis=1)
            if better.any():
                best.merge(first + rows[better], np.where(good, scores, NEVER)[better], ids)


def search_all(index: DataFrame, queries: Queries, exact_float: bool, dims: int) -> DataFrame:
    """query (its place in the block), id and score of the k best rows of all tiles for each query."""
    spark = index.sparkSession
    # A block has a fixed number of queries, so its size doesn't grow with the data.
    sent = spark.sparkContext.broadcast(queries)
    dtype = np.float64 if exact_float else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best = Best(len(q.ids), q.k, dtype)
        for batch in tidy(batches):
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values.to_numpy() for c in ("ids", "labels"))
                own = batch.column("dims")[i].as_py()
                t = open_tile(ids, labels, batch.column("vectors")[i].as_py(), own, dtype)
                if own < dims:
                    t = t._replace(**{c: np.pad(getattr(t, c), ((0, 0), (0, dims - own))) for c in ("vectors", "low", "high")})
                for at in range(0, len(q.ids), CHUNK):
                    search(t, q.take(slice(at, at + CHUNK)), best, at)
        found = best.scores > NEVER
        query, _ = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int64()), "id": pa.array(best.ids[found], pa.int64()), "score": pa.array(best.scores[found].astype(np.int64), pa.int64())})

    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = index.select("ids", "labels", "dims", "vectors").mapInArrow(run, FOUND_SCHEMA)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= queries.k)


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10,
         least: int = 30, most: int = 90, scale: int = 256, tile_rows: int = TILE_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * component); higher ones come first, ties by smaller
    id. An anchor's positives are its first ``positives`` rows of the same label and another id.
    For each of them the first ``negatives`` rows of other labels with least * positive_score <=
    100 * negative_score <= most * positive_score are returned; there may be none.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Shorter
    vectors count as if zeros followed. Rows that occur repeatedly are as many partners; an anchor that does
    is searched once. Components so large that scores don't fit 64 bits are an error. Extra columns are left out.
    """
    spark = df.sparkSession
    marked = df.where(anchors)
    rows = save(quantised(df, id_col, vector, label, scale), "vectors")
    index = build_index(rows.df, tile_rows)
    size = index.df.agg(F.max("dims"), F.max("most")).first()
    wanted = save(quantised(marked, id_col, vector, label, scale).dropDuplicates(), "anchors")
    free(spark, rows)
    dims, greatest = size[0] or 0, (size[0] or 0) * (size[1] or 0) ** 2
    if greatest >= -NEVER:
        raise ValueError(f"components reach {size[1]}: scores would not fit 64 bits")
    exact = greatest < 1 << 53
    blocks = max(1, -(-wanted.df.count() // block_anchors))
    done = []
    for b in range(blocks):
        block = wanted.df.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == b).orderBy("id", "label", "v").toArrow()
        if not block.num_rows:
            continue
        own = _matrix(_one(block.column("v")), dims).astype(np.int32)
        ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
        everything = np.full(len(ids), NEVER), np.full(len(ids), -NEVER)
        near = search_all(index.df, Queries(own, labels, ids, *everything, True, positives), exact, dims).orderBy("query", "rank").toArrow()
        a, score, partner = (near.column(c).to_numpy() for c in ("query", "score", "id"))
        # 100 * negative lies in [least * positive, most * positive]: the whole numbers inside.
        low, high = -((-least * score) // 100), (most * score) // 100
        open_ = low <= high
        a, score, partner, low, high = a[open_], score[open_], partner[open_], low[open_], high[open_]
        if len(a):
            found = search_all(index.df, Queries(own[a], labels[a], ids[a], low, high, False, negatives), exact, dims)
            pairs = spark.createDataFrame(pa.table({"query": np.arange(len(a)), "anchor_id": ids[a], "positive_id": partner, "positive_score": score}))
            named = found.join(F.broadcast(pairs), "query")  # one row for each window of the block
            done.append(save(named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    free(spark, wanted, index)
    return reduce(DataFrame.unionByName, (t.df for t in done)) if done else spark.createDataFrame([], RESULT_SCHEMA)


ORACLE_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
