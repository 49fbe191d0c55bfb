"""Chosen-path near duplicates against brute force over word shingles."""

import random

import numpy as np
import pytest
from test_jaccard import brute, planted

from claimweave.llm import chosen_path

SCHEMA = "doc_id long, text string"


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, k, percent", [(3, 3, 85), (4, 2, 70)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = planted(seed)
    made = chosen_path.dedup(spark.createDataFrame(rows, SCHEMA), k, percent)
    assert rows_of(made) == brute(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in made.collect())


@pytest.mark.parametrize("edits", [4, 9, 14])
def test_large_group(spark, monkeypatch, edits):
    """One group holds a third of all rows, all different: linked, in part, or not at all (nodes that stay large)."""
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", 32)
    rnd = random.Random(edits)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rnd.sample(range(200), edits):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rnd.choice(base) for _ in range(30))) for i in range(300)]
    got = rows_of(chosen_path.dedup(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, 3, 85)


def test_pairs_after_the_forest_grow_with_the_group(spark, monkeypatch):
    """In a group of near copies of which few are linked with one of them, later trees name no share of all pairs."""
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    monkeypatch.setattr(chosen_path, "FOREST", chosen_path.Trees(0, 1, 1))
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rnd.sample(range(200), rnd.randrange(1, 9)):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    named, stored = [], chosen_path.Join.stored

    def counted(self, df, name):
        out = stored(self, df, name)
        if name == "more":
            named.append(out.count())
        return out

    monkeypatch.setattr(chosen_path.Join, "stored", counted)
    assert rows_of(chosen_path.dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 3, 85)
    assert named[0] < len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(chosen_path.dedup(odd_docs)) == brute(rows, 3, 85)
    assert chosen_path.dedup(no_docs).count() == 0


def test_recall_of_the_settings():
    assert chosen_path.recall(0.85) > 0.9999
    rnd = np.random.default_rng(1)
    agree = []
    for _ in range(200):  # tokens agree as often as the sets are similar
        both = rnd.integers(1 << 63, size=340, dtype=np.uint64)
        x, y = chosen_path.minwise([both[:320], both[20:]])
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 300 / 340) < 0.01
