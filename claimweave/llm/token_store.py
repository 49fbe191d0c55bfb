"""Operator 1: token ids of documents in Re-Pair compressed shards, written and read as tables of binary rows.

``write`` sorts documents by id (ranges of ids over tasks), encodes whole texts, appends an end id and
writes one row a shard: (part, shard, n_docs, n_ids, payload), payload in the format of grammar.Shard.
Spark's own committed write makes lost or repeated tasks harmless. ``read_documents`` decodes them
again; ``read_slices`` decodes only asked parts of documents.

Null text counts as empty, so does a null id sort first (kept as null); repeated rows are kept, equal
ids in the order of a hash of their text. Empty tables give no shards. Other columns are not read.
A shard holds whole documents: a longer document makes a longer shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.batches import text_slices, texts_of
from claimweave.llm.grammar import MIN_COUNT, Shard, shard_starts
from claimweave.llm.tokens import TOKEN_SLICE, encoder

SHARD_IDS = 1 << 18
#: Stands for a null document id inside a shard.
NULL_ID = -(1 << 63)
SHARDS = "part int, shard int, n_docs long, n_ids long, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT) -> None:
    def shards(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed(ids, doc_ids, lengths):
            nonlocal number
            rows = []
            for a, b in zip(s := shard_starts(lengths, shard_ids), [*s[1:], len(lengths)], strict=True):
                at = int(lengths[:a].sum())
                n = int(lengths[a:b].sum())
                rows.append((part, number, b - a, n, Shard.of(ids[at : at + n], doc_ids[a:b], lengths[a:b], min_count).to_bytes()))
                number += 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "shard", "n_docs", "n_ids", "payload"])

        waiting = 0
        for batch in text_slices(batches, limit=TOKEN_SLICE):
            ids, at = encoder(tokenizer).encode_with_end(texts_of(batch), end_id)
            doc_ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            held.append((ids, doc_ids, np.diff(at)))
            waiting += len(ids)
            if waiting >= 4 * shard_ids:
                yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, waiting = [], 0
        if held:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in file order, from the decoded shards."""

    def decode(batches):
        for batch in batches:
            for part, number, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                shard = Shard.from_bytes(payload)
                data, lengths = shard.ids().astype("<u4").tobytes(), shard.doc_lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                doc_ids = pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID)
                columns = [pa.array(np.full(len(ends), part, dtype=np.int32)), pa.array(np.full(len(ends), number, dtype=np.int32)), doc_ids, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(SHARDS).parquet(path)
    sizes = stored.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a write task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = sizes.select("part", "shard", within.alias("before_shard")).join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("before"))
    docs = stored.select("part", "shard", "payload").mapInArrow(decode, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def read_slices(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Ids of the asked parts (part, shard, start, length in ids of the shard), expanding only what covers them."""

    def cut(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [Shard.from_bytes(r["payload"]).read(r["start"], r["length"]).astype(np.int64) for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], t) for c, t in (("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("length", pa.int64()))), pa.array(out, pa.list_(pa.int64()))], names=["part", "shard", "start", "length", "ids"])

    asked = wanted.select(*(F.col(c).cast(t).alias(c) for c, t in (("part", "int"), ("shard", "int"), ("start", "long"), ("length", "long"))))
    stored = spark.read.schema(SHARDS).parquet(path).select("part", "shard", "payload")
    return asked.join(stored, ["part", "shard"]).mapInArrow(cut, "part int, shard int, start long, length long, ids array<long>")
