"""Passages in texts against every pair, and the guarantee of the anchors."""

import random

from claimweave.operators import grounding as G
from claimweave.operators.passages import _runs, passages_in_texts


def test_equals_every_pair(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé中 ") for _ in range(rnd.randint(1, 7)))
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 80)))) for i in range(60)] + [(900, None), (901, ""), (902, "x" * 50_000 + "needle in it")]
    passages = []
    for i in range(120):
        t = rnd.choice(texts)[1] or "nothing"
        at = rnd.randrange(max(1, len(t)))
        piece = t[at : at + rnd.choice([1, 2, 3, 4, 5, 9, 15, 16, 17, 18, 30, 60])]
        passages.append((i, rnd.choice([piece, piece.upper(), piece.replace(" ", "  "), f" “{piece}” ", piece + "zz"])))
    passages += [(500, None), (501, " "), (502, "needle IN it"), (503, "aa"), (504, "“")]
    p, t = spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    pairs = p.withColumnRenamed("text", "quote").crossJoin(t)  # the brute-force side
    want = G.locate(pairs).filter("ok").select("item_id", "doc_id", "method", "char_start", "char_end")
    got = passages_in_texts(p, t)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 200
    assert passages_in_texts(p.limit(0), t).count() == 0 and passages_in_texts(p, t.limit(0)).count() == 0


def test_runs_are_told_apart():
    text = "".join(chr(random.Random(1).randrange(97, 123)) for _ in range(5000))
    runs = {text[i : i + 8] for i in range(len(text) - 7)}
    assert len(set(_runs(text, 8).tolist())) == len(runs)


def test_hashes_are_given_out_in_parts(spark):
    """A task never gathers the hashes of a whole batch of texts: they leave as rows, not as lists of a column."""
    from claimweave.operators.passages import _anchors, anchored

    rows = [(i, f"{i} some words of text number {i * 7919}") for i in range(50)] + [(99, None), (None, "x" * 40)]
    df = anchored(spark.createDataFrame(rows, "doc_id int, form string"), "doc_id")
    want = {(i, k) for i, v in rows for k in _anchors(v, 8, 9).tolist()}
    assert {tuple(r) for r in df.collect()} == want
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
