"""Exact best products of vectors, by Arrow batches of documents against a block of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from loamgrid.operators.lexical import CELLS, half_up

#: What a matrix product may be off from the sum in the order of components, for components of a size near 1, and what rounding to six places adds.
SLACK, ROUNDING = 1e-9, 1.1e-6


def matrix(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows without nulls by their size: places and vectors."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    gaps = np.r_[0, np.cumsum(lists.values.is_null().to_numpy(zero_copy_only=False))]
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (gaps[ends[1:]] == gaps[ends[:-1]])
    sizes = np.diff(ends)
    return {int(n): (at := np.flatnonzero(whole & (sizes == n)), flat[ends[at][:, None] + np.arange(n)]) for n in np.unique(sizes[whole])}


def _order(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query; NaN is the greatest, as in Spark, ties by id."""
    nan = np.isnan(score)
    order = np.lexsort((ids, -np.where(nan, 0, score), ~nan, q))
    first = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(order) else np.array([], np.int64)
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums in the order of components, so that equal vectors have equal products wherever they lie."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def searcher(ids: pa.Array, vectors: pa.Array, k: int, least: float | None, rounded: bool, others: bool, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows ``id, vector``: ``query, id, score`` of the task's best ``k`` of each query. ``rounded``: they are ranked by scores of six places; ``others``: a query's own id is none of them."""
    asked, names = matrix(vectors), ids.to_numpy(zero_copy_only=False)
    slack = SLACK + (ROUNDING if rounded else 0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, held = np.full(len(names), -np.inf), (np.array([], np.int64), np.array([], names.dtype), np.array([]))
        for part in parts:
            own = part.column(0).to_numpy(zero_copy_only=False)
            for size, (rows, docs) in matrix(part.column(1)).items():
                at, queries = asked.get(size, ([], None))
                step = max(1, CELLS // max(1, len(docs)))
                for start in range(0, len(at), step):
                    q, block = at[start : start + step], queries[start : start + step]
                    s = block @ docs.T
                    bound = limit[q]
                    if len(docs) > k + 1 and not np.isfinite(bound).all():
                        bound = np.maximum(bound, np.partition(s, len(docs) - k - 1, axis=1)[:, len(docs) - k - 1])  # one more than k: its own may be among them
                    x, y = np.nonzero(~(s < (np.where(np.isnan(bound), -np.inf, bound) - slack)[:, None]))
                    for cut in range(0, len(x), CELLS // 16):
                        u, v = x[cut : cut + CELLS // 16], y[cut : cut + CELLS // 16]
                        score = _products(block[u], docs[v])
                        score = half_up(score) if rounded else score
                        keep = np.ones(len(u), bool) if least is None else ~(score < least)
                        keep &= (own[rows[v]] != names[q[u]]) | (not others)
                        held = tuple(np.r_[a, b] for a, b in zip(held, (q[u][keep], own[rows[v]][keep], score[keep]), strict=True))
                        best = _order(*held, k)
                        held = tuple(a[best] for a in held)
            n = np.bincount(held[0], minlength=len(names))
            full = np.flatnonzero(n == k)
            limit[full] = held[2][np.cumsum(n)[full] - 1]
            limit[np.isnan(limit)] = -np.inf
        if len(held[0]):
            cols = [ids.take(pa.array(held[0])), pa.array(held[1]), pa.array(held[2])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return run
