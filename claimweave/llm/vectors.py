"""What the vector searches share: clean vectors in tiles, query blocks, and merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Top lists of so many tiles are merged in one step of the tree.
FAN_IN = 64


def clean(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim) of rows with an id and a vector without null or non-finite components."""
    v = F.col(column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter("vec_id is not null and v is not null").filter(~bad).withColumn("dim", F.size("v"))


def cells(rows: DataFrame, queries: DataFrame, tile_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows dealt into tiles and queries into blocks by id, both copied to the cells (dim, tile, block) where they meet."""
    n_tiles = max(1, -(-rows.count() // tile_rows))
    n_blocks = max(1, -(-queries.count() // block_rows))
    tiled = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles)).cast("int"))
    tiled = tiled.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int"))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    return tiled, asked, n_tiles


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors; of repeated ids, the smallest vector counts."""
    ids, dim = table.column("vec_id").to_numpy(), int(table.column("dim")[0].as_py()) if table.num_rows else 0
    v = table.column("v").combine_chunks()
    v = np.asarray(v.flatten(), dtype=np.float64).reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        order = np.lexsort([*v.T[::-1], ids])
        ids, v = ids[order], v[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, v = ids[first], v[first]
    return ids, v


def merge(found: DataFrame, n_tiles: int, k: int) -> DataFrame:
    """Tree of merges: the best k of (query_id, vec_id, score, tile) for each query, by score, then smaller id, with ranks."""
    best = [F.col("score").desc(), F.col("vec_id")]
    while n_tiles > FAN_IN:
        found = found.withColumn("tile", (F.col("tile") / FAN_IN).cast("int"))
        n_tiles = -(-n_tiles // FAN_IN)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(*best))).filter(F.col("rank") <= k).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
