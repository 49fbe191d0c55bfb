"""What earlier runs decided stays; no cut is left where one used to be; hot keys are dealt over tasks."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimweave.operators import grounding as G, merge as M, ranking as R, search as J, similarity as N
from claimweave.sources import payload as P, web as WB


def test_supersede_keeps_earlier_successions(spark):
    old = datetime(2020, 1, 2)
    claims = spark.createDataFrame([(1, "normal", 9, old), (2, "normal", None, None), (3, "normal", None, None)], "claim_id long, rank string, superseded_by long, valid_until timestamp")
    out = {r.claim_id: r for r in M.supersede(claims, spark.createDataFrame([(2, 3)], "claim_id long, superseded_by long"), "2024-01-01 00:00:00").collect()}
    assert (out[1].superseded_by, out[1].valid_until) == (9, old)
    assert (out[2].superseded_by, out[2].rank, out[3].rank) == (3, "deprecated", "preferred")


def test_decisions_keep_earlier_ones(spark):
    claims = spark.createDataFrame([(1, "pending"), (2, "pending")], "claim_id long, review_state string")
    queue = spark.createDataFrame([(10, "claim", "1", "done", "approve"), (11, "claim", "2", "todo", None)], "queue_id long, item_type string, item_id string, state string, decision string")
    said = spark.createDataFrame([(2, "reject", datetime(2024, 1, 1))], "claim_id long, action string, decided_at timestamp")
    got = {r.queue_id: (r.state, r.decision) for r in M.apply_decisions(claims, queue, said)[1].collect()}
    assert got == {10: ("done", "approve"), 11: ("done", "reject")}


def test_only_runs_done_lately_count_as_repeats(spark):
    at = datetime(2024, 1, 1, 12, 0)
    rows = [
        (1, "p", "g", at, at + timedelta(minutes=10), "done"),
        (2, "p", "g", at + timedelta(minutes=5), at + timedelta(minutes=6), "failed"),
        (3, "p", "g", at + timedelta(minutes=20), None, "running"),
        (4, "p", "g", at + timedelta(minutes=40), None, "running"),
        (5, "p", "g", at + timedelta(minutes=41), None, "running"),
        (6, "q", "g", at + timedelta(minutes=20), None, "running"),
        (7, "p", "h", at + timedelta(minutes=20), None, "running"),
    ]
    runs = spark.createDataFrame(rows, "run_id long, project_id string, goal string, started_at timestamp, finished_at timestamp, status string")
    assert sorted(r.run_id for r in M.repeat_runs(runs).collect()) == [3, 4]


def test_search_never_shows_another_project(spark):
    at = datetime(2024, 1, 1)
    kind = "claim_id long, project_id string, text string, claim_type string, topic string, confidence_band string, confidence double, review_state string, rank string, merged_into long, updated_at timestamp"
    claims = spark.createDataFrame([(i, "ab"[i % 2], f"alpha beta number{i}", "t", "x", "likely", 0.5, "approved", "normal", None, at) for i in range(10)], kind)
    evidence = spark.createDataFrame([(i, None, "alpha gamma delta") for i in range(10)], "evidence_id long, project_id string, quote string")
    links = spark.createDataFrame([(i, i) for i in range(10)], "evidence_id long, claim_id long")
    asked = spark.createDataFrame([(1, "gamma", "a"), (2, "gamma", None), (3, "alpha", "b")], "query_id long, query string, project_id string")
    owner = {r.claim_id: r.project_id for r in claims.collect()}
    for sizes in ({}, {"keyword_top": None, "evidence_top": None, "substring_top": None, "fewer_than": None}):
        hits = J.search(claims, evidence, links, asked, "2024-02-01 00:00:00", **sizes).collect()
        assert {owner[r.claim_id] for r in hits if r.query_id == 1} == {"a"} and {owner[r.claim_id] for r in hits if r.query_id == 3} == {"b"}
        assert {owner[r.claim_id] for r in hits if r.query_id == 2} == {"a", "b"}
    seen = J.search(claims, evidence, links, asked, "2024-02-01 00:00:00", projects=["b"]).collect()
    assert {owner[r.claim_id] for r in seen} == {"b"} and {r.query_id for r in seen} == {2, 3}


def test_nothing_is_cut(spark):
    many = spark.createDataFrame([(json.dumps({"x": [{"note": i} for i in range(700)]}),)], "p string")
    assert many.select(F.size(P.objects_with_key(F.col("p"), "note")).alias("n")).first().n == 700
    href = "../" * 9 + "z/./page"
    url = spark.createDataFrame([("http://h.org/" + "d/" * 12 + "q", href)], "u string, h string")
    assert url.select(WB.resolve_url(F.col("u"), F.col("h")).alias("t")).first().t == "http://h.org/d/d/d/z/page"
    quotes = [f"this is quote number {i}" for i in range(9)]
    said = spark.createDataFrame([(1, 1, "a claim about it", "official_fact", "other", quotes, [f"e{i}" for i in range(9)], 0.5)], "proposal_id long, snapshot_id long, text string, claim_type string, topic string, quotes array<string>, entities array<string>, confidence_self double")
    row = G.validate_claims(said, spark.createDataFrame([(1, ". ".join(quotes))], "snapshot_id long, text string")).first()
    assert len(row.quotes) == 9 and len(row.entities) == 9


def test_a_blank_quote_is_not_grounded(spark):
    quotes = ["     ", "\t\n \u3000", "a b   ", "abc"]
    said = spark.createDataFrame([(1, 1, "a claim about it", "official_fact", "other", quotes, None, 0.5)], "proposal_id long, snapshot_id long, text string, claim_type string, topic string, quotes array<string>, entities array<string>, confidence_self double")
    row = G.validate_claims(said, spark.createDataFrame([(1, "abc     a b")], "snapshot_id long, text string")).first()
    assert row.quotes == ["a b   "] and row.kept


def test_one_key_at_one_instant_uses_many_tasks(spark):
    rows = spark.range(20000).select(F.lit("k").alias("k"), "id", F.lit(datetime(2024, 1, 1)).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    parts = R._in_parts(rows, ["k"], [F.col("ts"), F.col("id")]).groupBy("_part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 15000
    got = R.sequence_numbers(rows, ["k"], "ts", "id").agg(F.min(F.col("seq") - F.col("id")), F.max(F.col("seq") - F.col("id"))).first()
    assert tuple(got) == (1, 1)


def test_leaders_on_one_hot_token(spark):
    texts = [(i, f"shared x{i}a x{i}b x{i}c") for i in range(300)] + [(1000 + i, f"shared x{i}a x{i}b x{i}c") for i in range(5)]
    got = {r.id: r.cluster for r in N.leader_clusters(spark.createDataFrame(texts, "id long, text string"), "id", "id", short_text=None).collect()}
    assert all(got[i] == i for i in range(300)) and all(got[1000 + i] == i for i in range(5))
