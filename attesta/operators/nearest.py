"""The nearest vectors of many queries: every query against every vector, in blocks of bounded size that are dealt to tasks.

A pair is a number in a block's matrix and becomes a row only if it is among the block's best of its query. Products are added
in the order of the components, as ``similarity.cosine`` adds them, so that scores are the same to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from attesta.operators.overlaps import rounded

VECTORS, QUERIES = 2_048, 1_024
_NONE, _NAN = -3.0, 3.0


def _matrix(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows, padded by zeros; their lengths, -1 for null; and whether there is a null in or instead of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat = column.flatten()
    row = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), n.max(initial=0)))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(pc.fill_null(flat.cast("float64"), 0.0))
    gone = np.asarray(pc.is_null(column))
    void = gone.copy()
    void[row[np.asarray(pc.is_null(flat))]] = True
    return out, np.where(gone, -1, n), void


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    for x, y in zip(a, b):
        out += x * y
    return out


def _cosines(queries, vectors) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all queries (rows) and vectors (columns), rounded to five places, and which of them are null."""
    (q, n, q_void), (v, m, v_void) = _matrix(queries), _matrix(vectors)
    wide = max(q.shape[1], v.shape[1])
    q, v = (np.ascontiguousarray(np.pad(x, ((0, 0), (0, wide - x.shape[1]))).T) for x in (q, v))
    with np.errstate(all="ignore"):
        norms = np.sqrt(_added(q, q))[:, None] * np.sqrt(_added(v, v))[None, :]
        apart = ((n[:, None] != m[None, :]) & (n[:, None] >= 0) & (m[None, :] >= 0)) | (n[:, None] == 0)
        void = (q_void[:, None] | v_void[None, :]) & ~apart
        score = np.where(apart | (norms == 0), 0.0, _added(q[:, :, None], v[:, None, :]) / norms)
    return rounded(score.ravel(), 5).reshape(score.shape), void


def _best(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best vectors of each query: NaN first, null last, ties to the smaller id."""
    docs, items = vectors.column("doc_id").combine_chunks(), queries.column("item_id").combine_chunks()
    ids = np.asarray(docs.to_numpy(zero_copy_only=False))
    if not len(docs) or not len(items):
        r = c = np.array([], int)
        score, void = np.zeros((0, 0)), np.zeros((0, 0), bool)
    else:
        score, void = _cosines(queries.column("q"), vectors.column("embedding"))
        key = np.where(void, _NONE, np.where(np.isnan(score), _NAN, score))
        key[np.asarray(items.to_numpy(zero_copy_only=False))[:, None] == ids[None, :]] = -np.inf
        last = np.partition(key, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(items), -np.inf)
        r, c = np.nonzero((key >= last[:, None]) & (key > -np.inf))
        order = np.lexsort((ids[c], -key[r, c], r))
        r, c = r[order], c[order]
        starts = np.searchsorted(r, r)
        keep = np.arange(len(r)) - starts < k
        r, c = r[keep], c[keep]
    found = pa.array(score[r, c], pa.float64(), mask=void[r, c]) if len(r) else pa.array([], pa.float64())
    return pa.table({"item_id": items.take(pa.array(r)), "doc_id": docs.take(pa.array(c)), "score": found})


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id and score of candidates among which are the k best of each query: ``vectors`` has doc_id and embedding,
    ``queries`` item_id and q. Score: ``similarity.cosine``, rounded to five places; a query is not its own neighbour."""
    vectors, queries = vectors.where("doc_id IS NOT NULL"), queries.where("item_id IS NOT NULL")
    nv, nq = max(1, -(-vectors.count() // VECTORS)), max(1, -(-queries.count() // QUERIES))

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.select("*", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = dealt(vectors.select("doc_id", "embedding"), "doc_id", "_v", nv, "_q", nq).groupBy("_v", "_q")
    right = dealt(queries.select("item_id", "q"), "item_id", "_q", nq, "_v", nv).groupBy("_v", "_q")
    kinds = dict(vectors.dtypes)["doc_id"], dict(queries.dtypes)["item_id"]
    return left.cogroup(right).applyInArrow(lambda a, b: _best(a, b, k), f"item_id {kinds[1]}, doc_id {kinds[0]}, score double")
