"""Connected components of links, by alternating star steps; the number of rounds grows with the logarithm of the size.

Before the steps links are dealt into parts of about ``PART`` rows, and each part is replaced by stars that
connect the same nodes, which takes most of the rounds away. Links that fit one part are done with that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from claimweave.checkpoints import cut

#: Links that a task puts into stars at once.
PART = 1 << 16


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(least[x] != least[y])):
        x, y = x[open_], y[open_]
        low, high = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        np.minimum.at(least, high, low)
        while len(np.flatnonzero((further := least[least]) != least)):
            least = further
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def _in_stars(batches):
    """Links in, stars out; a task holds about PART links at a time."""

    def made(held):
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(a, b)], names=["a", "b"])

    held, waiting = [], 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= 2 * PART:
            yield made(held)
            held, waiting = [], 0
    if waiting:
        yield made(held)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _laid_down(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, checkpointed, and what tells them from other links, told by the same job."""
    told = Observation()
    links = cut(links.observe(told, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")))
    return links, (told.get["n"], told.get["x"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable. Links are (a, b), nulls and loops ignored."""
    links, (n, _) = _laid_down(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"))
    parts, before = -(-n // PART), None
    if parts:
        links = cut(links.repartition(parts).mapInArrow(_in_stars, "a long, b long"))
    while parts > 1:
        links, now = _laid_down(_small_star(_large_star(links)))
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
