"""Exact top-k inner products over all vectors with MaxScore.

The components of a vector are the terms of a document, and a shard of vectors holds the postings of every term:
positions and values of the vectors in which it isn't zero. A query's weight times the least and the greatest value
of a term bound what that term adds. A mark, the k-th best score among some candidates already scored, has to be
reached. Terms in ascending order of bound are non-essential as long as their bounds together stay below the mark:
a vector with none of the other, essential terms can't reach it. Postings of essential terms are traversed; the
others are probed, greatest bound first, only for vectors that remain competitive, their score so far plus the
bounds of what is left still reaching the mark.

Vectors and queries are dealt into shards and blocks of fixed size, and every shard meets every block in one job,
as the task asks for all rows against a stated set of queries; a task holds one of each. The best of the shards are
merged by query.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm._shared import materialize

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 1024
_EXACT = {np.float32: 2**24, np.float64: 2**53}
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")))


def _matrix(codes: Iterable, width: int | None = None) -> np.ndarray:
    """Rows padded with zeros to a common width; exact integers as float32, float64 or, beyond both, as objects."""
    rows = [np.asarray(c, np.int64) for c in codes]
    width = max([len(r) for r in rows] + [width or 0])
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exact_type(x: np.ndarray, q: np.ndarray) -> type:
    most = lambda m: max((abs(int(m.min())), abs(int(m.max())))) if m.size else 0
    bound = most(x) * most(q) * max(1, x.shape[1])
    return next((t for t, limit in _EXACT.items() if bound < limit), object)


class Shard:
    """Postings of vectors in ascending order of id, term by term."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], np.asfortranarray(x[order])
        self.low, self.high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(x.shape[1], x.dtype),) * 2
        self.dense = x
        # the list of a term that most vectors have is kept by place, with zeros for the others
        self.places = [None if 2 * np.count_nonzero(c) > len(c) else np.flatnonzero(c) for c in x.T]
        self.values = [c if p is None else c[p] for c, p in zip(x.T, self.places, strict=True)]

    def postings(self) -> int:
        return sum(map(len, self.values))

    def search(self, query_id: int, q: np.ndarray, mark: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best vectors that reach the mark, ties to smaller ids, and how many postings were read."""
        bound = np.maximum(q * self.low, q * self.high)
        order = np.argsort(bound, kind="stable")
        sums = np.cumsum(np.maximum(bound[order], 0))
        first = int(np.searchsorted(sums, mark, "left")) if mark > -np.inf else 0  # sums below the mark
        scores, read = np.zeros(len(self.ids), self.dense.dtype), 0
        hit = np.zeros(len(self.ids), bool)
        for t in order[first:]:
            if q[t] != 0:
                at, values = self.places[t], self.values[t]
                read += len(values)
                if at is None:
                    scores += q[t] * values
                    hit[:] = True
                else:
                    scores[at] += q[t] * values
                    hit[at] = True
        # a vector without an essential term scores no more than the others' bounds, which is below the mark
        left = np.concatenate(([0], np.cumsum(bound[order[:first]])))
        r = first - 1
        while r >= 0 and 4 * np.count_nonzero(hit := hit & (scores + left[r + 1] >= mark)) > len(hit):
            for t in order[max(0, r - 3) : r + 1][::-1]:  # while many compete, lists are read whole, four at a time
                if q[t] != 0:
                    read += len(hit)
                    scores += q[t] * self.dense[:, t]
            r = max(-1, r - 4)
        alive = np.flatnonzero((hit if first else np.ones(len(hit), bool)) & (self.ids != query_id))
        own = scores[alive]
        for t, rest in zip(order[r::-1] if r >= 0 else (), left[r + 1 : 0 : -1], strict=False):
            still = own + rest >= mark
            alive, own = alive[still], own[still]
            if q[t] != 0 and len(alive):
                read += len(alive)
                own = own + q[t] * self.dense[alive, t]
        if mark > -np.inf:
            alive, own = alive[own >= mark], own[own >= mark]
        return *_best(self.ids[alive], own, k), read


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores, ties to smaller ids; ids ascend."""
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        keep = np.concatenate((above, np.flatnonzero(scores == edge)[: k - len(above)]))
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))
    return ids[order], scores[order]


def marks(query_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the other queries of its block, which are candidates too; -inf if they are fewer."""
    out = np.full(len(q), -np.inf, object if q.dtype == object else float)
    scores = q @ q.T
    for i in range(len(q)):
        own = scores[i][query_ids != query_ids[i]]
        if len(own) >= k:
            out[i] = np.partition(own, len(own) - k)[len(own) - k]
    return out


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """(best of each query, postings read, postings of the shard times queries) of a shard for a block of queries."""
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    kind = _exact_type(np.concatenate((x, q)), q)
    shard, q = Shard(ids, x.astype(kind)), q.astype(kind)
    found, read = [], 0
    for i, mark in enumerate(marks(query_ids, q, k)):
        own, scores, n = shard.search(query_ids[i], q[i], mark, k)
        found.append((own, scores))
        read += n
    return found, read, shard.postings() * len(q)


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: int = 64,
    query: Column | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the k greatest inner products of each query row with all rows of another id.

    query says which rows are queries (id divisible by 20). Rows whose id is null, or whose vector is null or
    holds null or non-finite components, take no part. A shorter vector counts as padded with zeros; vectors of any
    length are compared whole. Ties go to the smaller id. Repeated rows are candidates each; equal query rows count
    once. Scores beyond a long are cut to its range. Other columns are ignored; an empty table gives no rows.
    """
    asks = F.col(id_col) % 20 == 0 if query is None else query
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("codes"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = materialize(rows.filter("id IS NOT NULL AND codes IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    queries = rows.filter("asks").select("id", "codes").distinct().withColumn("query", F.monotonically_increasing_id())
    queries = materialize(queries, "topk-queries")
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, SHARD), (queries, BLOCK)))

    def dealt(df: DataFrame, number: str, own: str, n: int, other: str, m: int) -> DataFrame:
        """Every row in a part of its own side, once for each part of the other side."""
        part = F.pmod(F.xxhash64(number), F.lit(n)).cast("int").alias(own)
        return df.select(number, "id", "codes", part, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = dealt(rows, "row", "shard", shards, "block", blocks).groupBy("shard", "block")
    right = dealt(queries, "query", "block", blocks, "shard", shards).groupBy("shard", "block")

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        ids, query_ids, number = (t.column(c).to_numpy() for t, c in ((x, "id"), (q, "id"), (q, "query")))
        n, out, scores = [], [], []
        if len(ids) and len(query_ids):
            found, _, _ = search_block(ids, _matrix(x.column("codes").to_numpy()), query_ids, _matrix(q.column("codes").to_numpy()), k)
            n, out = [len(f[0]) for f in found], [f[0] for f in found]
            scores = [max(_LEAST, min(_MOST, int(s))) for f in found for s in f[1]]
        n = np.array(n, np.int64)
        columns = (np.repeat(number[: len(n)], n), np.repeat(query_ids[: len(n)], n), np.concatenate([*out, np.empty(0, np.int64)]))
        return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(scores, pa.int64())], names=["query", "query_id", "id", "score"])

    best = left.cogroup(right).applyInArrow(search, "query long, query_id long, id long, score long")
    by_query = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: The same by scoring every pair.
ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
