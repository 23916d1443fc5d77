"""Exact top-k by inner product: a KD-tree per shard of the vectors, searched best first.

Index: vectors are dealt to shards of bounded size by a hash; a task orders the rows of a shard by median splits along the
widest side and writes them in that order, which is all a tree needs: its nodes halve the range of rows, and their tight
boxes are taken from the rows when the shard is read.

Search: the largest inner product a box allows bounds all its rows.  A query walks a tree best bound first and stops
where the bound is under its k-th score so far; at an equal bound only smaller ids matter.  A first pass walks one leaf per
shard, and the best k-th score of any shard is the floor from which the second, full pass starts in all of them.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id, which no result
could name.  Rows with the query's id are its own and no candidates of it; a query id on several different vectors is a
query each.  Equal rows are folded to one with a count before they are dealt, and come out as often as they are there.
Ties go to the smaller id.  Of vectors of different length the shorter lacks components, which count as 0.  Scores
beyond 64 bits raise an error.  Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut
from .common import consecutive, map_arrow, table

SCALE = 1024
TOP = 10
QUERY_EVERY = 100
LEAF = 64
#: Bounds of the rows of a shard.
SHARD_ROWS = (4_096, 65_536)
#: Queries whose node bounds are computed at a time.
BLOCK = 256


# --- vectors as bytes -----------------------------------------------------------------------

def pack(v: np.ndarray) -> bytes:
    """Integers in the narrowest of two, four or eight bytes each, which the first byte names."""
    top = int(np.abs(v).max()) if len(v) else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + v.astype(f"<i{width}").tobytes()


def unpack(rows: list[bytes]) -> np.ndarray:
    """A matrix of packed vectors; shorter ones are filled up with zeros."""
    if len({(r[0], len(r)) for r in rows}) == 1:
        flat = np.frombuffer(b"".join(r[1:] for r in rows), f"<i{rows[0][0]}")
        return flat.reshape(len(rows), len(flat) // len(rows)).astype(np.int64)
    parts = [np.frombuffer(r, f"<i{r[0]}", offset=1) for r in rows]
    out = np.zeros((len(rows), max((len(p) for p in parts), default=0)), np.int64)
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def quantise(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): floor(scale * component) of the usable vectors (vec_id, column), packed."""
    c = F.col(column)
    usable = F.col("vec_id").isNotNull() & c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)))
    rows = vectors.where(usable).select("vec_id", c.alias("_v"))

    def run(batches):
        for batch in batches:
            lists = batch.column("_v")
            at, values = lists.offsets.to_numpy(), np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
            used = values[at[0]:at[-1]]
            if len(used) and np.abs(used).max() >= 2.0 ** 63:
                raise OverflowError("a component does not fit 64 bits")
            packed = [pack(values[a:b].astype(np.int64)) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "vec"])

    return map_arrow(rows, run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, vec binary")


# --- trees ----------------------------------------------------------------------------------

def median_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which every range that ``Tree`` halves is split at the median of its widest side."""
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a > leaf:
            own = points[order[a:b]]
            side = int(np.argmax(own.max(0) - own.min(0))) if own.shape[1] else 0
            mid = (a + b) // 2
            if own.shape[1]:
                order[a:b] = order[a:b][np.argpartition(own[:, side], mid - a)]
            todo += [(a, mid), (mid, b)]
    return order


class Tree:
    """Nodes over rows in median order: ``a``, ``b`` (range), boxes ``low``, ``high``, ``least`` id, first ``child`` (the other is next) or -1."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, copies: np.ndarray, leaf: int = LEAF):
        self.points, self.ids, self.copies = points, ids, copies
        self.top = int(np.abs(points).max()) if points.size else 0
        a, b, child = [0], [len(points)], []
        for i in range(2 * len(points)):
            if i == len(a):
                break
            if b[i] - a[i] > leaf:
                child.append(len(a))
                mid = (a[i] + b[i]) // 2
                a += [a[i], mid]
                b += [mid, b[i]]
            else:
                child.append(-1)
        self.a, self.b, self.child = a, b, child
        self.low, self.high = np.empty((len(a), points.shape[1]), np.int64), np.empty((len(a), points.shape[1]), np.int64)
        self.least = [0] * len(a)
        for i in reversed(range(len(a))):
            c = child[i]
            if c < 0:
                own = points[a[i]:b[i]]
                self.low[i], self.high[i], self.least[i] = own.min(0), own.max(0), int(ids[a[i]:b[i]].min())
            else:
                self.low[i], self.high[i] = np.minimum(self.low[c], self.low[c + 1]), np.maximum(self.high[c], self.high[c + 1])
                self.least[i] = min(self.least[c], self.least[c + 1])
        self._cast: dict = {}

    def _as(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self._cast:
            self._cast = {kind: (self.points.astype(kind), self.low.astype(kind), self.high.astype(kind))}
        return self._cast[kind]

    def search(self, queries: np.ndarray, own: list[int], floors: list[int | None], k: int, leaves: int = 0) -> Iterator[list[tuple[int, int]]]:
        """For each query its best (score, id), best first: all that may be among the best k, or those of its first ``leaves`` leaves."""
        width = max(queries.shape[1], self.points.shape[1])
        q = np.zeros((len(queries), self.points.shape[1]), np.int64)
        q[:, :queries.shape[1]] = queries[:, :self.points.shape[1]]
        most = self.top * (int(np.abs(q).max()) if q.size else 0) * max(width, 1)
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object          # exact in any case
        points, low, high = self._as(kind)
        q = q.astype(kind)
        bounds = high @ np.maximum(q, 0).T + low @ np.minimum(q, 0).T
        for j in range(len(q)):
            yield self._walk(points, bounds[:, j].tolist(), q[j], own[j], floors[j], k, leaves or len(self.a))

    def _walk(self, points, bound, q, own, floor, k, leaves) -> list[tuple[int, int]]:
        best: list[tuple] = []                                  # the k best as (score, -id), worst first
        floor = -math.inf if floor is None else floor
        heap = [(-bound[0], 0)]
        while heap and leaves:
            top, node = heapq.heappop(heap)
            if -top < floor:
                break
            if len(best) == k and -top == best[0][0] and self.least[node] > -best[0][1]:
                continue
            c = self.child[node]
            if c >= 0:
                for i in (c, c + 1):
                    if bound[i] >= floor:
                        heapq.heappush(heap, (-bound[i], i))
                continue
            leaves -= 1
            a = self.a[node]
            scores = points[a:self.b[node]] @ q
            for i in np.flatnonzero(scores >= floor):
                found = int(self.ids[a + i])
                if found != own:
                    entry = (int(scores[i]), -found)
                    for _ in range(min(int(self.copies[a + i]), k)):
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                    if len(best) == k and best[0][0] > floor:
                        floor = best[0][0]
        return [(s, -i) for s, i in sorted(best, reverse=True)]


# --- Spark ----------------------------------------------------------------------------------

def shards_for(rows: int) -> int:
    low, high = SHARD_ROWS
    return max(1, -(-rows // min(max(32 * math.isqrt(rows), low), high)))


def build_index(vectors: DataFrame, shards: int = 0) -> DataFrame:
    """The written index of vectors (vec_id, vec): (shard, pos, vec_id, copies, vec)."""
    same = cut(vectors.groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies")))
    shards = shards or shards_for(same.count())
    dealt = (same.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
             .repartition(4 * shards, "shard").sortWithinPartitions("shard", "vec_id", "vec"))

    def run(batches):
        for _, rows in consecutive(batches, ["shard"]):
            order = median_order(unpack(rows.column("vec").to_pylist()))
            out = rows.take(pa.array(order)).append_column("pos", pa.array(np.arange(len(order)), pa.int64()))
            yield from out.select(["shard", "pos", "vec_id", "copies", "vec"]).combine_chunks().to_batches(10_000)

    return cut(map_arrow(dealt, run, f"shard int, pos long, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, copies long, vec binary"))


def _walk_all(index: DataFrame, queries: DataFrame, shards: int, k: int, leaves: int) -> DataFrame:
    """(shard, query_id, vec, vec_id, score) of every query in every shard: up to k rows, from ``leaves`` leaves or from all that can matter."""
    id_type = index.schema["vec_id"].dataType.simpleString()
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(every.alias("shard"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("copies"), "vec", "floor")
    held = index.select("shard", F.lit(0).alias("kind"), "pos", "vec_id", "copies", "vec", F.lit(None).cast("long").alias("floor"))
    # the rows of a shard in the order of its tree, then the queries
    dealt = held.unionByName(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "kind", "pos")

    def run(batches):
        tree, of = None, None
        for (shard, kind), part in consecutive(batches, ["shard", "kind"]):
            if kind == 0:
                tree, of = Tree(unpack(part.column("vec").to_pylist()), part.column("vec_id").to_numpy(), part.column("copies").to_numpy()), shard
            elif of == shard:                                                           # else a shard without rows
                for at in range(0, part.num_rows, BLOCK):
                    block = part.slice(at, BLOCK)
                    ids, vecs = block.column("vec_id").to_pylist(), block.column("vec").to_pylist()
                    out = [(i, v, found, score) for i, v, best in zip(ids, vecs, tree.search(unpack(vecs), ids, block.column("floor").to_pylist(), k, leaves)) for score, found in best]
                    if out:
                        cols = list(zip(*out))
                        ids_type = part.schema.field("vec_id").type
                        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(out), pa.int32()), pa.array(cols[0], ids_type), pa.array(cols[1], pa.binary()), pa.array(cols[2], ids_type), pa.array(cols[3], pa.int64())],
                                                         ["shard", "query_id", "vec", "vec_id", "score"])

    return map_arrow(dealt, run, f"shard int, query_id {id_type}, vec binary, vec_id {id_type}, score long")


def search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of the index for each of the queries (query_id, vec)."""
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select("query_id", "vec").distinct()
    first = _walk_all(index, asked.withColumn("floor", F.lit(None).cast("long")), shards, k, 1)
    # the k-th score of any shard that has k is one that the k-th of all cannot be under
    kth = first.groupBy("query_id", "vec", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    floors = cut(asked.join(kth.where(F.col("n") == k).groupBy("query_id", "vec").agg(F.max("score").alias("floor")), ["query_id", "vec"], "left"))
    order = Window.partitionBy("query_id", "vec").orderBy(F.col("score").desc(), "vec_id")
    ranked = _walk_all(index, floors, shards, k, 0).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every vector whose id divides by 100."""
    vectors = quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    index = build_index(vectors)
    asked: Column = F.col("vec_id") % QUERY_EVERY == 0
    return search(index, index.where(asked).select(F.col("vec_id").alias("query_id"), "vec"))


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM v q JOIN v e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
