"""Chains of merges: a thousand in about ten rounds, cycles, log and index removal."""

from claimweave.operators import chains, search as J
from claimweave.operators.chains import chain_ends, merge_to_ends


def test_long_chain_hub_and_cycles(spark):
    rows = [(i, i + 1) for i in range(1000)] + [(5000 + i, 1000) for i in range(300)]
    rows += [(2001, 2002), (2002, 2003), (2003, 2001), (2000, 2001), (3000, 3000), (None, 1), (4, None), (4000, 4001)]
    got = {r["claim_id"]: (r["last"], r["hops"], r["cycle"]) for r in chain_ends(spark.createDataFrame(rows, "claim_id long, merged_into long")).collect()}
    want = {i: (1000, 1000 - i, False) for i in range(1000)} | {5000 + i: (1000, 1, False) for i in range(300)}
    want |= {k: (None, None, True) for k in (2000, 2001, 2002, 2003, 3000)} | {4000: (4001, 1, False)}
    assert got == want
    assert chain_ends(spark.createDataFrame([], "claim_id long, merged_into long")).count() == 0


def test_rounds_follow_the_longest_chain_not_the_number_of_items(spark, monkeypatch):
    made = []
    monkeypatch.setattr(chains, "cut", lambda df: made.append(1) or df.localCheckpoint())
    rows = [(i, i + 1) for i in range(4000) if i % 5 < 4] + [(9001, 9002), (9002, 9001), (9000, 9001)]
    got = chain_ends(spark.createDataFrame(rows, "claim_id long, merged_into long"))
    assert got.filter("not cycle and last = claim_id + hops and last % 5 = 4").count() == 3200 and got.filter("cycle").count() == 3
    assert len(made) <= 6


def test_merges_move_edges_log_and_index(spark):
    schema = "claim_id long, project_id string, text string, review_state string, merged_into long, rank string"
    claims = spark.createDataFrame([(i, "p", f"word{i} shared", "approved", 2 if i == 1 else None, "normal") for i in range(6)], schema)
    edges = spark.createDataFrame([(i, 10 + i % 2, i) for i in range(6)], "claim_id long, evidence_id long, line long")
    merged = spark.createDataFrame([(2, 3), (3, 4)], "claim_id long, canonical_id long")
    after, moved, log, gone = merge_to_ends(claims, edges, merged, "tester")
    assert {r["claim_id"]: r["merged_into"] for r in after.collect()} == {0: None, 1: 4, 2: 4, 3: 4, 4: None, 5: None}
    assert sorted(tuple(r) for r in moved.collect()) == [(0, 10, 0), (4, 10, 4), (4, 11, 1), (5, 11, 5)]
    assert sorted(r["claim_id"] for r in log.collect()) == [1, 2, 3] and all("4" in r["after_json"] for r in log.collect())
    index = J.claim_index(claims).remove(gone)
    queries = spark.createDataFrame([(1, "shared", None)], "query_id long, query string, project_id string")
    hits = J.text_rank(index, queries, claims.select("claim_id", "project_id"))
    assert sorted(r["claim_id"] for r in hits.collect()) == [0, 4, 5]
