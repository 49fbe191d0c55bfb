"""Operator 4: best-fit decreasing packing of documents into token windows.

Encoding cuts each document (with its end id) into full windows and a rest; a full window is a
sequence by itself. Rests, longest first, go to the tightest open window that still holds them, found
in a segment tree indexed by remaining capacity. Rests are dealt evenly into groups of a bounded size,
so that any number of documents packs in parallel; only piece descriptions travel, never ids. Padding
is small as long as short rests exist to fill the gaps (measured: under 0.1 % of the ids).

Null text counts as empty (its end id alone), a null id stays null, repeated rows are packed each.
An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.checkpoints import new_folder
from claimweave.llm.batches import give_back, text_slices, texts_of
from claimweave.llm.tokens import MEMO_WORDS, encoder

WINDOW = 2048
#: Rests packed together by one task.
GROUP_RESTS = 1 << 15
#: Text bytes encoded at a time: as much as elsewhere, since both workers of an executor hold the arrays of a slice.
PACK_SLICE = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity of at least what is asked."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window, taken out of the tree."""
        node, count = need + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of every length (1 to window)."""
    tree, number, offset, used = CapacityTree(window), np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, used = (window, used), used + 1
        capacity, number[i] = found
        offset[i] = window - capacity
        if capacity > need:
            tree.put(capacity - need, found[1])
    return number, offset


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, group_rests: int = GROUP_RESTS, keep_words: int = MEMO_WORDS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``keep_words``: known words after which a worker starts afresh; fewer take less memory and more time.
    """
    spark = docs.sparkSession

    def cut(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, limit=PACK_SLICE):
            if len(encoder(tokenizer).known) > keep_words:
                encoder(tokenizer).forget()
            ids, at = encoder(tokenizer).encode_with_end(texts_of(batch), end_id)
            data, doc_ids, out = ids.astype("<u4").tobytes(), batch.column("doc_id").to_pylist(), []
            for doc_id, a, b in zip(doc_ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
                for s in range(a, b, window):
                    e = min(s + window, b)
                    out.append((doc_id, s - a, e - s, zlib.crc32(data[4 * s : 4 * e]), b - a, (part << 32) + row))
                    row += 1
            columns = [pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])
        encoder(tokenizer).forget()  # other stages use this worker too
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = new_folder(spark, "pieces")
    rows.mapInArrow(cut, PIECES).write.parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    full = pieces.filter(F.col("length") == window)
    rests = pieces.filter(F.col("length") < window)
    groups = max(1, -(-rests.count() // group_rests))

    def place(key, table):
        number, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        sequence = 2 * ((key[0].as_py() << 32) + number) + 1
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("deal")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = rests.withColumn("bin", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    return alone.unionByName(dealt.groupBy("bin").applyInArrow(place, PACKED))
