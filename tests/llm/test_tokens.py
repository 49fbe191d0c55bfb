"""Token store and packing against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from claimweave.checkpoints import new_folder
from claimweave.llm import packing, token_store
from claimweave.llm.grammar import Shard
from claimweave.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_tokenizer():
    texts = ["a  b", "a \n b", "a\n b", " x", "", "  ", "x  ", "x  y.", "<|endoftext|> hi<|endoftext|>", "it's 'll  \n\n q é　 z.", "tab\t x,", "word. word, word", "日本 語 1234", "x\x1c y", "a." * 50]
    own = Encoder(PATH, memo_words=3)
    for _ in range(2):
        ids, at = own.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 9, 5000), np.zeros(1000), np.arange(50), np.zeros(0), np.tile([7, 8, 9], 700), rng.integers(0, 70000, 300)):
        ids = ids.astype(np.uint32)
        shard = Shard.from_bytes(Shard.of(ids, np.array([5]), np.array([len(ids)]), min_count=2).to_bytes())
        assert (shard.ids() == ids).all()
        for a in range(0, len(ids), 97):
            assert (shard.read(a, 31) == ids[a : a + 31]).all()
    assert len(Shard.of(np.tile([7, 8, 9, 7], 700).astype(np.uint32), np.array([1]), np.array([2800])).sequence) < 100


def test_store_round_trip(spark, odd_docs, no_docs):
    path = new_folder(spark, "test-store")
    token_store.write(odd_docs, path, PATH, shard_ids=64)
    got = sorted(tuple(r) for r in token_store.read_documents(spark, path).collect() if r["doc_id"] is not None)
    rows = odd_docs.select("doc_id", "text").collect()
    at = sum(len(ids_of(r["text"], 2)) for r in rows if r["doc_id"] is None)
    want = []
    for r in sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        ids = ids_of(r["text"], 2)
        want.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    shards = spark.read.parquet(path).filter("n_ids > 20").selectExpr("part", "shard", "3L as start", "9L as length")
    assert all(len(r["ids"]) == 9 for r in token_store.read_slices(spark, path, shards).collect())
    empty = new_folder(spark, "test-store")
    token_store.write(no_docs, empty, PATH)
    assert token_store.read_documents(spark, empty).count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    number, offset = packing.best_fit_decreasing(np.array([6, 7, 3, 4, 10]), 10)
    assert number.tolist() == [2, 1, 1, 2, 0] and offset.tolist() == [0, 0, 7, 6, 0]


def test_packing_covers_every_id_once(spark, odd_docs, no_docs):
    got = packing.pack(odd_docs, PATH, window=16, group_rests=4).toPandas()
    for (doc_id, text), copies in odd_docs.select("doc_id", "text").toPandas().groupby(["doc_id", "text"], dropna=False).size().items():
        ids = ids_of(None if text != text else text, 1)
        mine = got[(got.doc_id.isna() if doc_id != doc_id else got.doc_id == doc_id) & (got.doc_tokens == len(ids))]
        for a in range(0, len(ids), 16):
            piece = ids[a : a + 16]
            assert ((mine.start == a) & (mine.length == len(piece)) & (mine.ids_crc32 == crc(piece))).sum() == copies
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 16 and (s.offset.values == np.cumsum(s.length.values) - s.length.values).all()
    assert packing.pack(no_docs, PATH).count() == 0
    few = packing.pack(odd_docs, PATH, window=16, group_rests=4, keep_words=0).toPandas()  # forgets before every slice
    content = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, few[content].fillna(-1).values)) == sorted(map(tuple, got[content].fillna(-1).values))
