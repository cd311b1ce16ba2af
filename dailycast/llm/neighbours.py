"""Approximate nearest neighbours by vantage-point trees, one per shard (operator 7).

The vectors are dealt over shards of about equal size by a hash of their id; each
shard builds its tree.  Every query visits every shard's tree in blocks, and the
shards' best are merged.  On unit vectors the chord length orders like the cosine
and is a metric, so a subtree whose points keep at least the distance b from a
query cannot improve a list whose last distance is t if b > t.  ``factor``
relaxes this: a subtree is left out if b * factor > t.  Factor 1 is exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailycast.llm import common

FOUND = "query_id long, vec_id long, score double"
#: Scores that differ by less are compared exactly.
NEAR = 1e-9


class Tree:
    """A vantage-point tree over distinct unit vectors; equal vectors are one point with its smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, leaf: int = 128, seed: int = 7):
        same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        first = np.flatnonzero(np.append(True, np.diff(same[order]) > 0))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[rank < keep]  # a list of so many results needs no more equal vectors
        self.group = np.searchsorted(np.unique(same), same[kept])
        self.ids, self.raw = ids[kept], vectors[kept]
        self.starts = np.flatnonzero(np.append(True, np.diff(self.group) > 0))
        self.stops = np.append(self.starts[1:], len(kept))
        points = self.raw[self.starts]
        self.points = points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(self.points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        vantage = int(at[self.rng.integers(len(at))])
        d = chord(self.points[at] @ self.points[vantage])
        inner = d <= np.median(d)
        if inner.all():
            return at
        sides = [(float(d[m].min()), float(d[m].max()), self._build(at[m])) for m in (inner, ~inner)]
        return vantage, sides

    def search(self, queries: np.ndarray, k: int, factor: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate pairs (query, point): all that may be among a query's ``k`` nearest but its own id."""
        self.q = queries / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
        self.best = np.full((len(queries), k + 1), -2.0)  # one more: the query itself may be a point
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.factor = factor
        self._visit(self.root, np.arange(len(queries)))
        if not self.pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, p, s = (np.concatenate(x) for x in zip(*self.pairs))
        keep = s >= self.best[q, 0] - NEAR
        both = np.unique(np.stack([q[keep], p[keep]]), axis=1)
        size = (self.stops - self.starts)[both[1]]
        q = np.repeat(both[0], size)
        at = np.repeat(self.starts[both[1]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        other = self.ids[at] != own[q]
        return q[other], at[other]

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            s = self.q[active] @ self.points[node].T
            joined = np.concatenate([self.best[active], s], axis=1)
            k = self.best.shape[1]
            self.best[active] = np.sort(np.partition(joined, -k, axis=1)[:, -k:], axis=1)
            row, column = np.nonzero(s >= self.best[active, :1] - NEAR)
            self.pairs.append((active[row], node[column], s[row, column]))
            return
        vantage, sides = node
        d = chord(self.q[active] @ self.points[vantage])
        bound = [np.maximum(0, np.maximum(low - d, d - high)) for low, high, _ in sides]
        near_first = bound[0] <= bound[1]
        for first, mask in ((0, near_first), (1, ~near_first)):
            for side in (first, 1 - first):
                limit = chord(self.best[active, 0])
                go = mask & (bound[side] * self.factor <= limit + NEAR)
                self._visit(sides[side][2], active[go])


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(cosine, -1, 1)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dim of the rows that take part; rows of one id are one item (the least vector)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    picked = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null").where(fine)
    return picked.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 1.5, shard_rows: int = 8192,
            block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest by cosine, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows but the query's own, of the same dimension.  Vectors that are NULL,
    zero or hold NULL or non-finite components take no part; a NULL vec_id takes
    no part; repeated rows of an id are one item.  Fewer candidates give fewer
    rows; an empty table gives none.  Other columns are not read."""
    spark = vectors.sparkSession
    common.python_ready(spark)
    rows = common.staged(usable(vectors), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    points = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("query", F.lit(0))
    asked = (rows.where(F.col("vec_id") % every == 0)
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("query", F.lit(1)))
    both = points.union(asked.select(*points.columns)).repartitionById(shards, F.col("shard"))

    def answer(tree: Tree, ids: list[int], queries: list) -> pa.RecordBatch:
        own, q = np.asarray(ids, np.int64), np.asarray(queries, np.float64)
        row, at = tree.search(q, k, factor, own)
        a, b = q[row], tree.raw[at]
        scores = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        order = np.lexsort((tree.ids[at], -scores, row))
        row, at, scores = row[order], at[order], scores[order]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < k
        return pa.RecordBatch.from_arrays([pa.array(own[row[top]]), pa.array(tree.ids[at[top]]), pa.array(scores[top])],
                                          ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (dim, points before queries): a tree per dimension, then its queries in blocks."""
        ids, held, tree, dim, asking = [], [], None, None, 0
        for batch in batches:
            for i, v, d, q in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "dim", "query"))):
                if (d, q) != (dim, asking) or (q and len(ids) >= block):
                    if asking and ids and tree is not None:
                        yield answer(tree, ids, held)
                    if not asking and d == dim and ids:
                        tree = Tree(np.asarray(ids, np.int64), np.asarray(held, np.float64), k + 1)
                    elif d != dim:
                        tree = None
                    ids, held, dim, asking = [], [], d, q
                ids.append(i)
                held.append(v)
        if asking and ids and tree is not None:
            yield answer(tree, ids, held)

    found = both.sortWithinPartitions("dim", "query").select("vec_id", "v", "dim", "query").mapInArrow(search, FOUND)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
