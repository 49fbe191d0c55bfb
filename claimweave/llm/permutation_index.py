"""Operator 7: approximate nearest neighbours through permutations of pivots.

Pivots are a fixed-size sample of the vectors (smallest hashes of the id). Every vector is represented
by its nearest pivots in order. The index is a table of shards: a shard holds its vectors and, for each
pivot, the list of its vectors that have that pivot among their nearest, with the pivot's place in
their order (a pivot inverted file). A query walks the lists of its own nearest pivots; the places
differ by the footrule distance (absent pivots count as last). The nearest ``share`` of each shard by
footrule is ranked anew by the true inner product, and the shards' top lists are merged.

Every row is indexed. Tables so small that ``LEAST_TIMES`` covers them are ranked whole; beyond that,
recall depends on the share and the data (the README has it by size; tests measure it with the
registered settings). Equal vectors of a shard share their place. Null ids, null or zero vectors and
vectors with null or non-finite components take no part; vectors of different lengths never meet. Rows
that repeat an id count once (the smallest vector). Ties go to the smaller id. A query never finds
its own id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.vectors import clean, matrix, merge

PIVOTS = 256
PREFIX = 64
SHARE = 0.2
SHARD_ROWS = 4096
BLOCK_ROWS = 2048
#: A shard ranks anew at least so many times as many vectors as are asked for.
LEAST_TIMES = 12
INDEX = "dim int, tile int, ids binary, vectors binary, starts binary, members binary, places binary"


def orders(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first (by angle)."""
    near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def _used(vectors: DataFrame) -> DataFrame:
    return clean(vectors).filter(F.exists("v", lambda x: x != 0))


def build(vectors: DataFrame, path: str, pivots: int = PIVOTS, prefix: int = PREFIX, shard_rows: int = SHARD_ROWS) -> None:
    """Write the index: shards under ``path``/shards, pivots under ``path``/pivots."""
    rows = _used(vectors)
    spark = vectors.sparkSession
    for dim in [r[0] for r in rows.select("dim").distinct().collect()]:  # one length as a rule
        own = rows.filter(F.col("dim") == dim)
        chosen = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("dim", "vec_id", "v")  # a fixed number
        chosen.write.mode("append").parquet(f"{path}/pivots")
    if rows.isEmpty():
        rows.select("dim", "vec_id", "v").write.mode("append").parquet(f"{path}/pivots")
    shared = spark.sparkContext.broadcast(_pivots(spark, path))
    n_tiles = max(1, -(-rows.count() // shard_rows))

    def shard(key, table):
        dim, tile = key[0].as_py(), key[1].as_py()
        ids, v = matrix(table)
        order = orders(v, shared.value[dim], prefix)
        n = len(shared.value[dim])
        member = np.repeat(np.arange(len(ids), dtype=np.int32), order.shape[1])
        place = np.tile(np.arange(order.shape[1], dtype=np.uint8 if prefix <= 256 else np.int32), len(ids)).astype(np.int32)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        starts = np.searchsorted(order.ravel()[by_pivot], np.arange(n + 1))
        parts = [ids, v, starts.astype(np.int64), member[by_pivot], place[by_pivot]]
        return pa.table([pa.array([dim], pa.int32()), pa.array([tile], pa.int32()), *(pa.array([x.tobytes()]) for x in parts)], names=["dim", "tile", "ids", "vectors", "starts", "members", "places"])

    tiled = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles)).cast("int"))
    tiled.groupBy("dim", "tile").applyInArrow(shard, INDEX).write.mode("append").parquet(f"{path}/shards")


def _pivots(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    found: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r["vec_id"]):  # a fixed number a length
        x = np.array(r["v"])
        found.setdefault(r["dim"], []).append(x / np.linalg.norm(x))
    return {dim: np.stack(x) for dim, x in found.items()}


def _search_shard(ids, v, starts, members, places, q_ids, q, order, k: int, prefix: int, share: float):
    """Of each query, the k + 1 best of the shard among the share that is nearest by footrule."""
    keep = min(len(ids), max(LEAST_TIMES * (k + 1), int(np.ceil(share * len(ids)))))
    width = order.shape[1]
    out_q, out_id, out_score = [], [], []
    for i in range(len(q_ids)):
        lists = [slice(starts[p], starts[p + 1]) for p in order[i]]
        who = np.concatenate([members[s] for s in lists])
        mine = np.repeat(np.arange(width), [s.stop - s.start for s in lists])
        theirs = np.concatenate([places[s] for s in lists])
        # Footrule over the pivots of either list, absent ones counting as last: what is shared shortens it.
        shorter = 2 * (width - np.maximum(mine, theirs))
        saved = np.bincount(who, weights=shorter, minlength=len(ids))
        near = np.argpartition(-saved, keep - 1)[:keep] if keep < len(ids) else np.arange(len(ids))
        near.sort()
        score = v[near] @ q[i]
        other = ids[near] != q_ids[i]
        near, score = near[other], score[other]
        top = np.lexsort((ids[near], -score))[:k]
        out_q.append(np.full(len(top), q_ids[i]))
        out_id.append(ids[near[top]])
        out_score.append(score[top])
    return tuple(np.concatenate(x) for x in (out_q, out_id, out_score))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, prefix: int = PREFIX, share: float = SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each of ``queries`` (vec_id, embedding)."""
    shared = spark.sparkContext.broadcast(_pivots(spark, path))
    shards = spark.read.schema(INDEX).parquet(f"{path}/shards")
    asked = _used(queries)
    n_blocks = max(1, -(-asked.count() // block_rows))
    n_tiles = (shards.agg(F.max("tile")).first()[0] or 0) + 1

    def cell(left, right):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "tile": pa.array([], pa.int32())})
        if not left.num_rows or not right.num_rows:
            return empty
        row = left.slice(0, 1).to_pylist()[0]
        kinds = {"ids": np.int64, "vectors": np.float64, "starts": np.int64, "members": np.int32, "places": np.int32}
        part = {c: np.frombuffer(row[c], dtype=t) for c, t in kinds.items()}
        q_ids, q = matrix(right)
        found = _search_shard(part["ids"], part["vectors"].reshape(len(part["ids"]), -1), part["starts"], part["members"], part["places"], q_ids, q, orders(q, shared.value[row["dim"]], prefix), k, prefix, share)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2], "tile": pa.array(np.full(len(found[0]), row["tile"], dtype=np.int32))})

    keys = ["dim", "tile", "block"]
    copied = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int"))
    blocks = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    found = copied.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double, tile int")
    return merge(found, n_tiles, k)
