import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimweave.operators import audit as A, scoring as S

AS_OF = "2026-07-01 00:00:00"
CLAIM = (
    "claim_id string, project_id string, claim_type string, value struct<value:string>, derived_from array<string>, review_state string,"
    " merged_into string, confidence double, opinion struct<n_holding:long,n_discussing:long>"
)
LINK = (
    "claim_id string, claim_type string, stance string, directness string, extractor_confidence double, source_id string, source_type string,"
    " owner_key string, authority_prior double, dup_cluster string, suspected_promo boolean, published_at timestamp, has_value boolean"
)
NEW = datetime(2026, 6, 1)


def claim(cid="c", kind="official_fact", value=None, derived=None, opinion=None, state="pending", prior=None):
    return (cid, "p", kind, value and (value,), derived or [], state, None, prior, opinion)


def link(cid="c", stance="supports", direct="direct", conf=None, owner="a", kind="official", auth=0.9, cluster=None, promo=False, at=NEW, value=None, ctype="official_fact"):
    return (cid, ctype, stance, direct, conf, owner, kind, owner, auth, cluster, promo, at, value)


def run(spark, claims, links, conflicts=None):
    cf = None if conflicts is None else spark.createDataFrame(conflicts, "claim_a string, claim_b string, status string")
    out = S.score_claims(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(links, LINK), AS_OF, cf)
    return {r.claim_id: r for r in out.collect()}


def r3(x):
    return math.floor(x * 1000 + 0.5) / 1000


def test_fact_score_worked_by_hand(spark):
    got = run(spark, [claim()], [link(owner="a"), link(owner="b", auth=0.7)])["c"]
    parts = [r3(0.9 * math.log(0.9 / 0.1)), 0.8, r3(0.7 * math.log2(3)), 0.0, 0.0]
    assert got.confidence == r3(1 / (1 + math.exp(-sum(parts))))
    assert got.confidence_band == "verified"
    assert [f.factor for f in got.breakdown.factors] == ["authority_prior", "directness", "independent_sources", "freshness", "originality"]
    assert got.breakdown.caps == []


def test_honesty_rules(spark):
    got = run(
        spark,
        [claim(c) for c in ("none", "single", "copies", "refuted", "plain", "promo", "old", "press")],
        [
            link("none", stance="mentions"),
            link("single"),
            *[link("copies", owner=f"o{i}", cluster="k") for i in range(5)],
            link("plain", owner="a"), link("plain", owner="b"),
            link("refuted", owner="a"), link("refuted", owner="b"), link("refuted", stance="refutes", owner="z"),
            link("promo", owner="a", promo=True), link("promo", owner="b", promo=True),
            link("old", owner="a", at=datetime(2024, 1, 1)), link("old", owner="b", at=None),
            link("press", owner="a", kind="press"), link("press", owner="b", kind="press"),
        ],
    )
    assert got["none"].confidence is None and got["none"].confidence_band == "insufficient"
    assert got["single"].confidence <= 0.7 and got["copies"].confidence <= 0.7 and got["copies"].n_support == 1
    assert got["refuted"].confidence < got["plain"].confidence
    assert got["promo"].confidence < got["plain"].confidence
    assert got["old"].confidence < got["plain"].confidence
    assert got["press"].confidence == 0.75


def test_value_agreement_inference_and_conflict(spark):
    got = run(
        spark,
        [claim("v", value="30"), claim("i", "system_inference", derived=["p1", "p2"]), claim("j", "system_inference"), claim("w", "creative_insight"), claim("d"),
         claim("p1", prior=0.6, state="rejected"), claim("p2", prior=None, state="rejected")],
        [link("v", owner="a", value=True), link("v", owner="b", value=False), *[link(c, owner=o, ctype="x") for c in "ijwd" for o in "ab"]],
        [("d", "q", "open"), ("i", "q", "dismissed")],
    )
    assert {f.factor: f.logodds for f in got["v"].breakdown.factors}["consistency"] == r3(-0.8 + 1.4 * 0.5)
    assert got["i"].confidence == r3(0.85 * 0.6) and got["j"].confidence == r3(0.85 * 0.5)
    assert got["w"].confidence == 0.75 and got["w"].confidence_band == "likely"
    assert got["d"].confidence_band == "disputed"
    assert "p1" not in got


@pytest.mark.parametrize("sample,owners,band", [((5, 5), ["x:a", "y:b"], "uncertain"), ((70, 150), ["x:a", "y:b"], "verified"), ((70, 150), ["x:a", "x:b"], "likely"), ((7, 60), ["x:a"], "uncertain"), ((9, 60), ["x:a"], "likely")])
def test_opinions(spark, sample, owners, band):
    got = run(spark, [claim("o", "player_opinion", opinion=sample)], [link("o", owner=o, ctype="player_opinion") for o in owners])["o"]
    assert got.confidence_band == band


def test_a_mean_at_the_limit_does_not_depend_on_the_order(spark):
    sums = [(0.5 + 0.6 + 0.7, 3), (0.7 + 0.6 + 0.5, 3), (1.7, 3), (None, 0)]
    df = spark.createDataFrame(sums, "self_conf_sum double, self_conf_n long")
    factor = S.factor_columns(F.lit(AS_OF).cast("timestamp"))["extraction_quality"]
    assert sums[0] != sums[1] and [r[0] for r in df.select(factor).collect()] == [None, None, -0.4, None]


def test_routing_keeps_human_states(spark):
    rows = [("a", "approved", "disputed"), ("b", "quarantined", "verified"), ("c", "pending", "likely"), ("d", "pending", "disputed"), ("e", "pending", "insufficient")]
    df = spark.createDataFrame(rows, "claim_id string, review_state string, confidence_band string")
    got = {r.claim_id: (r.next_state, r.queue_reason, r.queue_priority) for r in S.route_claims(df).collect()}
    assert got == {
        "a": ("approved", None, None), "b": ("quarantined", "conflict_open", 1), "c": ("auto_accepted", None, None),
        "d": ("quarantined", "conflict_open", 1), "e": ("pending", "insufficient_evidence", 3),
    }


def test_vocabulary_audit(spark):
    df = spark.createDataFrame([(1, "verified"), (2, "sure")], "claim_id long, confidence_band string")
    assert [tuple(r) for r in A.vocabulary_violations(df, ["confidence_band"], "claim_id").collect()] == [("confidence_band", "sure", "2")]
