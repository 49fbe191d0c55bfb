"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest

from claimweave.checkpoints import new_folder
from claimweave.llm import exact_search, permutation_index

KIND = "vec_id long, embedding array<float>, label int, score string, tile string"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, -0.5], 0, "x", "y") for i in range(100, 112)]
    rows += [(50, [1.0, 2.0, 3.0], 0, "x", "y"), (50, [1.0, 2.0, 3.0], 0, "x", "y"), (0, [0.0, 0.0, 0.0], 0, None, None), (7, None, None, None, None), (150, [1.0, None, 2.0], 0, "x", "y")]
    rows += [(200, [1.0, nan, 2.0], 0, "x", "y"), (250, [1.0, inf, 2.0], 0, "x", "y"), (None, [1.0, 1.0, 1.0], 0, "x", "y"), (300, [2.0, 1.0], 0, "x", "y"), (301, [1.0, 1.0], 0, "x", "y"), (350, [], 0, "x", "y")]
    return spark.createDataFrame(rows, KIND)


def brute(rows, asked, k, turn=lambda x: x, zero=True):
    known = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            known[r["vec_id"]] = turn(np.array(v, dtype=float))
    out = []
    for q in sorted(i for i in known if asked(i)):
        scored = sorted((-float(known[q] @ v), i) for i, v in known.items() if i != q and len(v) == len(known[q]))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_exact_odd_rows(spark, odd_vectors):
    got = exact_search.search(odd_vectors, odd_vectors.filter("vec_id % 50 = 0"), k=5, tile_rows=3, block_rows=2)
    want = brute(odd_vectors.collect(), lambda i: i % 50 == 0, 5, lambda v: np.floor(256 * v))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert exact_search.search(odd_vectors.filter("false"), odd_vectors.filter("false")).count() == 0


def test_exact_huge_components():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**30, 3.0], [2.0**60, 0.0]])
    assert exact_search.products(q, v).tolist() == [[2**70 if 2**70 < 2**63 else 2**63 - 1, 2**63 - 1]]
    assert exact_search.products(np.array([[2.0**27, 1.0]]), np.array([[2.0**27, 1.0]])).tolist() == [[2**54 + 1]]


@pytest.mark.parametrize("settings", [{"shard_rows": 600}, {}])  # small shards, and as registered
def test_permutation_recall(spark, settings):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = new_folder(spark, "test-index")
    permutation_index.build(vectors, path, **settings)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in permutation_index.search(spark, path, vectors.filter("vec_id % 20 = 0"), k=20).collect()}
    want = {(q, i): s for q, _, i, s in brute(vectors.collect(), lambda i: i % 20 == 0, 20)}
    assert len(got) == len(want) and len(got.keys() & want.keys()) / len(want) >= 0.9
    assert all(np.isclose(got[x], want[x]) for x in got.keys() & want.keys())


def test_permutation_odd_rows(spark, odd_vectors):
    path = new_folder(spark, "test-index")
    permutation_index.build(odd_vectors, path, shard_rows=4)
    got = permutation_index.search(spark, path, odd_vectors.filter("vec_id % 50 = 0"), k=20)
    want = brute(odd_vectors.collect(), lambda i: i % 50 == 0, 20, zero=False)  # small shards are ranked whole
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == [x for x in want if x[0] != 350]
    empty = new_folder(spark, "test-index")
    permutation_index.build(odd_vectors.filter("false"), empty)
    assert permutation_index.search(spark, empty, odd_vectors.filter("false")).count() == 0
