"""Exact shingle sets of asked classes, computed from the texts again; shared by the joins on word shingles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.llm.batches import text_slices, texts_of
from claimweave.llm.shingles import mix, shingle_sets

#: Words of 64 bits in the filter that keeps texts nobody asked for out of a shuffle: its size never grows.
FILTER_WORDS = 1 << 17


def set_hash(x: np.ndarray) -> int:
    """Names the class of all texts with this set."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(x)), np.add.reduce(x), len(x)], dtype=np.uint64)).sum().astype(np.int64))


def exact_sets(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(cls, set) of the classes ``keys`` (cls, digest of one of their texts), from rows (text, digest).

    Texts are filtered by the bits of the asked digests in the engine before any of them moves; a task
    hashes repeated texts once.
    """
    word = f"digest & {FILTER_WORDS - 1}L"
    bit = "shiftleft(1L, cast(shiftrightunsigned(digest, 58) as int))"
    # at most FILTER_WORDS rows, whatever is asked for
    words = F.broadcast(keys.groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or({bit})").alias("bits")))
    wanted = docs.withColumn("word", F.expr(word)).join(words, "word").filter(F.expr(f"(bits & {bit}) <> 0"))

    def run(batches):
        seen = set()  # of one task
        for batch in batches:
            new = []
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    new.append(i)
            for part in text_slices([batch.take(pa.array(new, pa.int64()))]):
                sets = [x for x in shingle_sets(texts_of(part), size) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "set"])

    made = wanted.select("digest", "text").mapInArrow(run, "cls long, set binary")
    return made.join(keys.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):  # views, not copies
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


#: How many pairs a task names between a class and each other root, pass by pass; the last names all that are left.
PASSES = (4, None)
#: In place of that number: pairs that span what a task finds, fewer than it has roots.
SPAN = 0


def few_per_root(found: np.ndarray, cls: np.ndarray, root: np.ndarray, most: int | None) -> np.ndarray:
    """Of the found classes at most so many of each root, those with the smallest names."""
    if most is None or len(found) < 2:
        return found
    found = found[np.lexsort((cls[found], root[found]))]
    roots = root[found]
    place = np.arange(len(found))
    opens = np.concatenate([[True], roots[1:] != roots[:-1]])
    return found[place - np.maximum.accumulate(np.where(opens, place, 0)) < most]


def named(found: np.ndarray, u: int, cls: np.ndarray, home: np.ndarray, most: int | None) -> np.ndarray:
    """Those of the found that are named with u; a pass that spans gives them and all of their homes the home of u."""
    if most != SPAN:
        return few_per_root(found, cls, home, most)
    found = few_per_root(found, cls, home, 1)
    if len(found):
        home[np.isin(home, home[found])] = home[u]
    return found


def block_pairs(near: Callable, percent: int, bits: list[str], most: int | None):
    """One task's block (other = 1) and chunk in; pairs of different roots that may be similar out.

    ``near(n, bits, u, pool, percent)`` tells which of the pool may be similar to u.
    """

    def run(table: pa.Table) -> pa.Table:
        n, cls, root = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "cls", "root"))
        if table.schema.field(bits[0]).type == pa.binary():
            words = np.frombuffer(b"".join(table.column(bits[0]).to_pylist()), dtype=np.uint64).reshape(len(n), -1)
        else:
            words = np.stack([table.column(c).to_numpy() for c in bits], axis=1).view(np.uint64)
        other = table.column("other").to_numpy() == 1
        chunk, a, b = np.flatnonzero(~other), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for u in np.flatnonzero(other).tolist():
            found = named(near(n, words, u, chunk[root[chunk] != root[u]], percent), u, cls, root, most)
            a.append(np.full(len(found), cls[u]))
            b.append(cls[found])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def blocks(large: DataFrame, key: str, bits: list[str], near: Callable, percent: int, block: int, most: int | None) -> DataFrame:
    """(a, b) of different roots that may be similar, in groups ``key`` of any size.

    What isn't in a group's commonest root meets all of the group, a block by as large a chunk in a task.
    Between one class and one other root a task names ``most`` pairs: once one of them links the two, the
    others are not needed; callers go through PASSES. With SPAN a task names no more pairs than it has rows.
    ``large``: (key, cls, root, n, bitmap columns, many), many being the rows of the group.
    """
    counts = large.groupBy(key, "root", "many").agg(F.count("*").alias("rows"))
    top = counts.groupBy(key, "many").agg(F.max(F.struct("rows", "root")).alias("top"))
    top = top.select(key, F.col("top.root").alias("main"), F.ceil((F.col("many") - F.col("top.rows")) / block).alias("blocks"), F.ceil(F.col("many") / block).alias("chunks"))
    told = large.join(top.filter("blocks > 0"), key)
    dealt = lambda seed, parts: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    columns = [key, "cls", "root", "n", *bits]
    others = told.filter("root <> main").select(*columns, dealt(1, "blocks").alias("block"), every("chunks").alias("chunk"), F.lit(1).alias("other"))
    whole = told.select(*columns, every("blocks").alias("block"), dealt(2, "chunks").alias("chunk"), F.lit(0).alias("other"))
    return others.unionByName(whole).groupBy(key, "block", "chunk").applyInArrow(block_pairs(near, percent, bits, most), "a long, b long")
