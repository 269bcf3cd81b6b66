"""Exact top-k by inner product: a KD-tree per shard, best-first search by box bounds, a propagated kth score."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

SHARD_ROWS = 16384
BLOCK_QUERIES = 256
LEAF_ROWS = 64
_EXACT = 2 ** 53  # sums below this are exact in float64
_LONG = 2 ** 63 - 1


class Tree:
    """Rows in leaf order, and for each node its rows, tight box and children (-1: leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        spans, self.left, self.right, lo, hi = [(0, len(ids))], [], [], [], []
        at = 0
        while at < len(spans):
            start, stop = spans[at]
            part = rows[order[start:stop]]
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            spread = hi[-1] - lo[-1]
            if stop - start <= leaf or not spread.size or spread.max() == 0:
                self.left.append(-1)
                self.right.append(-1)
            else:  # the median of the widest side
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(part[:, spread.argmax()], middle)]
                self.left.append(len(spans))
                self.right.append(len(spans) + 1)
                spans += [(start, start + middle), (start + middle, stop)]
            at += 1
        self.spans, self.lo, self.hi = spans, np.array(lo), np.array(hi)
        self.ids, self.rows = ids[order], rows[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product any point of the node's box can have."""
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        return np.maximum(queries, zero) @ self.hi.T + np.minimum(queries, zero) @ self.lo.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: int | None, first_leaf: bool) -> list[tuple]:
        """The k best ``(score, id)``, but none below ``floor``; with ``first_leaf`` those of the first leaf only."""
        best: list[tuple] = []  # heap of (score, -id): the worst kept one is first
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if floor is not None and -reach < floor:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if floor is None or bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            start, stop = self.spans[node]
            scores = clamped(self.rows[start:stop] @ query)
            for i in np.flatnonzero(scores >= floor) if floor is not None else range(stop - start):
                vec = int(self.ids[start + i])
                if vec != own:
                    entry = (int(scores[i]), -vec)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k and (floor is None or best[0][0] > floor):
                floor = best[0][0]
            if first_leaf:
                break
        return [(s, -v) for s, v in best]


def clamped(values: np.ndarray) -> np.ndarray:
    """Python's integers within the range of a long; floats are below it anyway."""
    return values if values.dtype != object else np.minimum(np.maximum(values, -_LONG), _LONG)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), dim)


def _build(dim: Column, items: Column) -> Column:
    """A pickled tree per row from ``array<struct<vec_id, v>>``."""
    @F.arrow_udf("binary")
    def trees(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for dims, lists in batches:
            made = []
            for d, x in zip(dims.to_pylist(), lists, strict=True):
                ids, v = x.values.field("vec_id").to_numpy(), _matrix(x.values.field("v"), d)
                made.append(pickle.dumps(Tree(ids, v), protocol=5))
            yield pa.array(made, pa.binary())

    return trees(dim, items)


FOUND = "array<struct<query_id:bigint,vec_id:bigint,score:bigint>>"
_FOUND = pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def _search(tree: Column, dim: Column, queries: Column, k: int, first_leaf: bool) -> Column:
    @F.arrow_udf(FOUND)
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for trees, dims, lists in batches:
            out = []
            for blob, d, x in zip(trees, dims.to_pylist(), lists, strict=True):
                t: Tree = pickle.loads(blob.as_buffer())
                ids, floors = x.values.field("vec_id").to_pylist(), x.values.field("floor").to_pylist()
                q = _matrix(x.values.field("v"), d)
                top = [max((abs(int(f(a))) for f in (np.min, np.max)), default=0) if a.size else 0 for a in (q, t.rows)]
                kind = np.float64 if top[0] * top[1] * max(d, 1) < _EXACT else object  # Python's integers where floats would round
                q, t.rows, t.lo, t.hi = (a.astype(kind) for a in (q, t.rows, t.lo, t.hi))
                bound = clamped(t.bounds(q))
                out.append([{"query_id": i, "vec_id": v, "score": s}
                            for i, row, b, f in zip(ids, q, bound, floors, strict=True)
                            for s, v in t.search(row, i, b, k, f, first_leaf)])
            yield pa.array(out, _FOUND)

    return found(tree, dim, queries)


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold a null or non-finite one."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS,
                block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` with the highest inner product, ties to smaller vec_id.

    Both tables are ``vec_id, v`` with integer components. Rows with a null in either take no part, a query is
    not its own result, scores beyond a long are its largest or smallest value, a repeated query is answered once and a repeated candidate is a row like any other. Vectors
    meet those of the same length only. Each block of queries visits each shard twice: in the first round only
    the best leaf, and the kth score over all shards is what the second round begins with.
    """
    vectors = staged(vectors.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dim")))
    queries = queries.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dim")).dropDuplicates(["vec_id"])
    counts = [max(1, -(-n // size)) for n, size in ((vectors.count(), shard_rows), (queries.count(), block_queries))]
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    shards = vectors.groupBy("dim", part(counts[0]).alias("shard")).agg(F.collect_list(F.struct("vec_id", "v")).alias("items"))
    shards = staged(shards.select("dim", "shard", _build(F.col("dim"), F.col("items")).alias("tree")))

    def visit(q: DataFrame, first_leaf: bool) -> DataFrame:
        packed = q.groupBy("dim", part(counts[1]).alias("block")).agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("q"))
        each = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1)))).repartition(counts[0] * counts[1], "shard", "block")
        met = each.join(shards, ["dim", "shard"])
        return met.select(F.inline(_search(F.col("tree"), F.col("dim"), F.col("q"), k, first_leaf)))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = visit(queries.withColumn("floor", F.lit(None).cast("long")), True).withColumn("rank", F.row_number().over(best))
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    second = visit(queries.join(floors, queries["vec_id"] == floors["query_id"], "left").drop("query_id"), False)
    ranked = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
