"""Ordering inside groups without pulling a large group into one task.

``row_number() <= n`` with a constant n is cut per input partition before the shuffle, so top-n is
safe on hot keys as it stands. Numbering or looking back over *all* rows of a key is not: these
helpers range-partition the rows by key and order into parts of about equal size, work inside the
parts, and carry only one summary row per key and part across them. A key with a third of all rows,
even at a single instant, is so dealt over as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.checkpoints import cut


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, pos: str = "pos") -> DataFrame:
    """First n rows of every key (None: all, numbered in parts); the position column counts from 1."""
    if n is None:
        return numbered(df, keys, order, pos)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(pos, F.row_number().over(w)).filter(F.col(pos) <= n).withColumn(pos, F.col(pos).cast("long"))


def _in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with their part; laid down, so that a part never changes between its two uses."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """1-based position of each row within its key, whatever the size of the key."""
    b = _in_parts(df, keys, order)
    sizes = b.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = b.withColumn("_pos", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
    joined = _join_parts(rows, sizes, keys)
    return joined.withColumn(out, (F.col("_base") + F.col("_pos")).cast("long")).drop("_part", "_pos", "_base")


def sequence_numbers(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, out: str = "seq") -> DataFrame:
    """1-based position of each row within its key, ordered by (ts, tiebreak)."""
    return numbered(df, keys, [F.col(ts), F.col(tiebreak)], out)


def previous_row(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, take: str, out: str = "previous") -> DataFrame:
    """Value of ``take`` on the preceding row of the same key, NULL on the first one."""
    order = [F.col(ts), F.col(tiebreak)]
    b = _in_parts(df, keys, order)
    last = b.groupBy(*keys, "_part").agg(F.max_by(F.struct(F.col(take).alias("v")), F.struct(ts, tiebreak)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(W.partitionBy(*keys).orderBy("_part"))).drop("_last")
    stepped = b.withColumn("_in", F.lag(F.struct(F.col(take).alias("v"))).over(W.partitionBy(*keys, "_part").orderBy(*order)))
    joined = _join_parts(stepped, carried, keys)
    return joined.withColumn(out, F.coalesce("_in", "_carried")["v"]).drop("_part", "_in", "_carried")


def _join_parts(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on key and part where a key may be NULL, keeping the rows' columns."""
    a, b = rows.alias("a"), parts.alias("b")
    cond = F.col("a._part") == F.col("b._part")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    extra = [F.col(f"b.{c}") for c in parts.columns if c not in keys and c != "_part"]
    return a.join(b, cond, "left").select("a.*", *extra)
