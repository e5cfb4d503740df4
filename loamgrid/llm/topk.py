"""Exact search of the highest inner products by pivots.

The inner product of q and x is half of ``|q|^2 + |x|^2 - d(q, x)^2``, and by the triangle inequality ``d(q, x)`` is at least ``|d(q, p) - d(x, p)|`` for every
pivot p. With all distances to PIVOTS pivots computed beforehand and written, the largest of these differences bounds the score of a pair from above. A block of queries
meets a batch of candidates in the order of their bounds, and stops where no bound left reaches the score that a query's ``k``-th best has so far: what is
left can't be among its best, so the result is exact. How much is spared depends on the vectors (their intrinsic dimension), never the result.

Queries are a stated part of the rows. They are sent out in blocks of QUERY_BYTES at most, one pass over the written pivot table each, so memory is bounded however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import cut, discard, small_batches

#: Pivots, and rows that they are chosen from, farthest first. The same rows give each query a first limit; neither choice can change a result.
PIVOTS, SEEDS = 32, 2048
#: Bytes of a block of queries with their distances; rows of candidates that a task holds at once are Arrow batches.
QUERY_BYTES = 16_000_000
#: Queries and candidates that are compared at once, and rows of candidates a task at most.
SOME, STEP, TASK_ROWS = 64, 512, 65_536
#: Beyond this, sums of products aren't exact in doubles; beyond the second, not in 64 bits.
EXACT, LARGEST = 2**53, 2**63


def matrix(column: pa.Array, dim: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(dtype, copy=False)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to the pivots, from differences, so that small ones are right, too."""
    x = x.astype(np.float64)
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots.astype(np.float64)], axis=1)


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different rows, each the farthest from those before it."""
    rows = rows.astype(np.float64)
    at, gap = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(at) < n and gap.max() > 0:
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[at[-1]]) ** 2).sum(axis=1))
    return rows[at]


class Search:
    """The best ``k`` candidates so far of every query of a block. Scores are doubles where these are exact, else 64-bit integers."""

    def __init__(self, queries: dict[str, np.ndarray], limit: np.ndarray, pivot_norm: float, k: int):
        self.k, self.q = k, queries
        self.dtype = queries["v"].dtype
        self.least = self.dtype.type(-EXACT if self.dtype == np.float64 else -LARGEST)
        self.limit = limit  # a score that the k-th best reaches at least; the least number: none known
        self.norm = (queries["v"].astype(np.float64) ** 2).sum(axis=1)
        self.pivot_norm = pivot_norm
        self.best: list[tuple[np.ndarray, ...]] = [()] * -(-len(self.norm) // SOME)

    def bounds(self, own: slice, norm: np.ndarray, to_pivots: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of some queries with all candidates, rounding included."""
        low = np.zeros((own.stop - own.start, len(norm)), np.float32)
        gap = np.empty_like(low)
        for q, x in zip(self.q["d"][own].T, to_pivots.T, strict=True):
            np.subtract(q[:, None], x, out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        sums = (self.norm[own, None] + norm).astype(np.float32)
        return (sums - low * low) / 2 + (sums + np.float32(self.pivot_norm)) * np.float32(4e-6) + 1

    def add(self, rid: np.ndarray, ids: np.ndarray, v: np.ndarray, to_pivots: np.ndarray) -> None:
        """Take in a batch of candidates. ``ids``: what ties are ordered by."""
        norm = (v.astype(np.float64) ** 2).sum(axis=1)
        to_pivots = np.ascontiguousarray(to_pivots.astype(np.float32))
        for b in range(len(self.best)):
            own = slice(b * SOME, min((b + 1) * SOME, len(self.norm)))
            bound = self.bounds(own, norm, to_pivots)
            slack = (bound - self.limit[own, None]).max(axis=0)
            order = np.argsort(-slack, kind="stable")
            v_q, rid_q, found = self.q["v"][own], self.q["rid"][own], []
            for at in range(0, len(order), STEP):
                if slack[order[at]] < 0:  # and so of all that follow: limits only rise
                    break
                part = order[at : at + STEP]
                live = np.flatnonzero((bound[:, part] >= self.limit[own, None]).any(axis=1))
                if not len(live):
                    continue
                scores = v_q[live] @ v[part].T
                mine = rid_q[live, None] == rid[part]
                i, j = np.nonzero((scores >= self.limit[own][live, None]) & ~mine)
                if not len(i):
                    continue
                found.append((live[i], scores[i, j], ids[part[j]], rid[part[j]]))
                if sum(len(x[0]) for x in found) >= 4 * SOME * self.k:
                    self.settle(b, own, found)
                    found = []
            self.settle(b, own, found)

    def settle(self, b: int, own: slice, found: list[tuple[np.ndarray, ...]]) -> None:
        """Keep each query's best ``k`` of what it had and has found; the last of ``k`` is its new limit."""
        if not found:
            return
        q, score, ids, rid = (np.concatenate(x) for x in zip(*([self.best[b]] if self.best[b] else []), *found, strict=True))
        order = np.lexsort((rid, ids, -score, q))
        first = np.searchsorted(q[order], np.arange(own.stop - own.start))
        rank = np.arange(len(order)) - first[q[order]]
        kept = order[rank < self.k]
        last = order[rank == self.k - 1]
        at = own.start + q[last]
        self.limit[at] = np.maximum(self.limit[at], score[last])
        self.best[b] = q[kept], score[kept], ids[kept], rid[kept]

    def results(self) -> Iterator[tuple[np.ndarray, ...]]:
        for b, x in enumerate(self.best):
            if x:
                yield b * SOME + x[0], x[1], x[2], x[3]


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``rid, id, v`` of the rows that take part, written: each component as floor(scale * x). ``rid`` tells rows of one id apart."""
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    x = x.where("x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    x = x.select(F.monotonically_increasing_id().alias("rid"), "id", F.expr(f"transform(x, c -> CAST(floor(c * {scale}) AS bigint))").alias("v"))
    return cut(x)


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, id_col, score``: for every row that ``is_query`` (a condition on ``id_col``) holds for, the ``k`` other rows of the highest inner products of
    vectors whose components are floor(scale * x); ties go to the smaller id, then to the earlier row.

    Rows whose vector is null or holds a null or non-finite component take no part. Rows of one id are rows of their own: each is compared with the others
    (and, as queries, each has its own result). A null id is no query and comes last in ties. Vectors are compared with those of their own length, without
    components (empty) with score 0. Fewer candidates than ``k``: all. No rows or no queries give no rows. Products that 64 bits can't hold are an error.
    Other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    ddl = f"query_id bigint, rank int, `{id_col}` bigint, score bigint"
    rows = quantised(df, id_col, vector_col, scale)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> greatest(a, abs(CAST(x AS double))))")).alias("top")).collect()  # a row for each length of vectors
    parts = [search(rows.where(F.size("v") == r.dim), r.dim, r.n, r.top, is_query, k, id_col, ddl) for r in sorted(lengths)]
    parts = [p for p in parts if p is not None]
    discard(rows)
    out = spark.createDataFrame([], ddl) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(rows: DataFrame, dim: int, n: int, top: float, is_query: Column, k: int, id_col: str, ddl: str) -> DataFrame | None:
    """``nearest`` of the ``n`` rows of one length, whose components are at most ``top``."""
    spark = rows.sparkSession
    if dim * top * top >= LARGEST:
        raise ValueError(f"inner products of {dim} components up to {top:g} are not 64-bit integers")
    dtype = np.dtype(np.float64 if dim * top * top < EXACT else np.int64)
    # A bounded sample by hash, for pivots and first limits.
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SEEDS).select("rid", "v").toArrow()
    seeds, seed_ids = matrix(sample["v"].combine_chunks(), dim, dtype), sample["rid"].to_numpy()
    pivots = farthest_first(seeds, PIVOTS)
    pivot_norm = float((pivots**2).sum(axis=1).max())
    shared = spark.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("v"), dim, np.float64), shared.value)
            flat = pa.array(d.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), flat)], names=["rid", "id", "v", "d"])

    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    table = cut(rows.repartition(tasks).mapInArrow(measure, "rid bigint, id bigint, v array<bigint>, d array<double>"))
    asked = table.withColumn(id_col, F.col("id")).where(is_query).select("rid", "id", "v", "d")
    n_asked = asked.count()
    per = max(1, QUERY_BYTES // (8 * (dim + len(pivots) + 4)))
    n_blocks = -(-n_asked // per)
    found = None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("rid"), F.lit(n_blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        queries = {"rid": block["rid"].to_numpy(), "v": matrix(block["v"].combine_chunks(), dim, dtype), "d": matrix(block["d"].combine_chunks(), len(pivots), np.float32)}
        part = cut(passed(table, queries, (seeds, seed_ids), pivot_norm, block["id"].to_numpy(), k))
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
        best = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
        found = best if found is None else found.unionByName(best)
    return found


def passed(table: DataFrame, queries: dict[str, np.ndarray], seeds: tuple[np.ndarray, np.ndarray], pivot_norm: float, names: np.ndarray, k: int) -> DataFrame:
    """``q, query_id, id, rid, score``: one block of queries against all candidates; each task gives its best ``k`` of every query that reach the query's first limit."""
    dim, dtype = queries["v"].shape[1], queries["v"].dtype
    least = Search(queries, np.zeros(0), 0.0, k).least
    limit = np.full(len(names), least, dtype)
    vectors, seed_ids = seeds
    for lo in range(0, len(names), SOME):
        own = slice(lo, lo + SOME)
        scores = np.where(queries["rid"][own, None] == seed_ids, least, queries["v"][own] @ vectors.T)
        if scores.shape[1] >= k:
            limit[own] = np.partition(scores, -k, axis=1)[:, -k]
    sent = table.sparkSession.sparkContext.broadcast((queries, limit, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, limit, names = sent.value
        state = Search(queries, limit.copy(), pivot_norm, k)
        for batch in batches:
            ids = batch.column("id")
            # Ties: null ids after all others.
            order = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            state.add(batch.column("rid").to_numpy(), order, matrix(batch.column("v"), dim, dtype), matrix(batch.column("d"), queries["d"].shape[1], np.float32))
        for q, score, ids, rid in state.results():
            yield pa.RecordBatch.from_arrays([pa.array(queries["rid"][q]), pa.array(names[q].astype(np.int64)), pa.array(ids), pa.array(rid), pa.array(score.astype(np.int64))], names=["q", "query_id", "id", "rid", "score"])

    return table.mapInArrow(run, "q bigint, query_id bigint, id bigint, rid bigint, score bigint")
