"""Operator 6: exact top-k search by inner product, in tiled matrix products.

Rows are dealt into tiles and queries into blocks of bounded size; each cell (tile, block) is one
matrix product whose best k columns a query are selected at once, and the top lists of the tiles are
merged in a tree. Vectors are turned into whole numbers floor(scale * x), so scores are exact: products
run in double precision while no sum can reach 2**53, in 64-bit integers while none can reach 2**63,
and in unbounded integers, held to the range of a long, beyond.

Null ids, null vectors and vectors with null or non-finite components take no part; vectors of
different lengths never meet. Rows that repeat an id count once (the smallest vector). Ties go to the
smaller id. A query never finds its own id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.vectors import cells, clean, matrix, merge

TILE_ROWS = 4096
BLOCK_ROWS = 4096
#: Queries multiplied at a time within a cell.
STRIP = 256


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, held to the range of a long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ v.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(v).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller column."""
    n = scores.shape[1]
    if k >= n:
        return np.argsort(-scores.astype(object) if scores.min(initial=0) == -(2**63) else -scores, axis=1, kind="stable")
    if np.abs(scores.astype(np.float64)).max(initial=0) * n < 2**62:
        keyed = scores * n + (n - 1 - np.arange(n))  # one number orders by score, then column
        top = np.argpartition(-keyed, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(keyed, top, 1), axis=1), 1)
    return np.stack([np.lexsort((np.arange(n), ~row))[:k] for row in scores])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""

    def cell(left, right):
        rows, asked = left, right
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "tile": pa.array([], pa.int32())})
        tile = rows.column("tile")[0].as_py()
        ids, v = matrix(rows)
        q_ids, q = matrix(asked)
        v, q = np.floor(scale * v), np.floor(scale * q)
        out = []
        for a in range(0, len(q), STRIP):
            scores = products(q[a : a + STRIP], v)
            top = best(scores, k + 1)  # one more, as the query itself may be among them
            at = np.repeat(np.arange(len(top)), top.shape[1])
            found, value, who = ids[top.ravel()], scores[at, top.ravel()], q_ids[a : a + STRIP][at]
            other = found != who
            out.append((who[other], found[other], value[other]))
        who, found, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": who, "vec_id": found, "score": value, "tile": pa.array(np.full(len(who), tile, dtype=np.int32))})

    rows, asked, n_tiles = cells(clean(vectors), clean(queries), tile_rows, block_rows)
    keys = ["dim", "tile", "block"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long, tile int")
    return merge(found, n_tiles, k)
