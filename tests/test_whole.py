"""Registered queries and operators on rows that an earlier cut left out."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimweave.operators import search as J, similarity as N


def test_quotes_of_every_review_count(spark, tmp_path):
    said = [(i, "en", "src1", "It is a fine addition.") for i in (1, 2, 3)] + [(i, "fr", "src1", "Une belle addition.") for i in (5, 6)]
    spark.createDataFrame(said, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in entry.queries()["quoted_opinions"](spark, str(tmp_path)).collect()]
    assert got == [("en", "value", "positive")]


def test_hidden_claims_take_no_place_in_a_list(spark):
    hot = [(i, "hot", "alpha beta", "approved") for i in range(300)]
    small = [(1000 + i, "small", "gamma delta", "pending") for i in range(60)] + [(2000, "small", "gamma delta", "approved"), (2001, "small", "xgamma deltax", "approved")]
    claims = spark.createDataFrame(hot + small, "claim_id long, project_id string, text string, review_state string").withColumns(
        {"rank": F.lit("normal"), "merged_into": F.lit(None).cast("long"), "confidence": F.lit(0.5), "updated_at": F.lit(datetime(2024, 1, 1))}
    )
    quotes = spark.createDataFrame([(i, None, "omega gamma") for i in range(300)] + [(5000, None, "omega gamma")], "evidence_id long, project_id string, quote string")
    links = spark.createDataFrame([(i, i) for i in range(300)] + [(5000, 2001)], "evidence_id long, claim_id long")
    asked = spark.createDataFrame([(1, "omega", "small"), (2, "gamma delta", "small")], "query_id long, query string, project_id string")
    hits = J.search(claims, quotes, links, asked, "2024-02-01 00:00:00").collect()
    got = {(r.query_id, r.claim_id): r.matched_via for r in hits}
    assert got == {(1, 2001): ["evidence"], (2, 2000): ["keyword", "substring"], (2, 2001): ["evidence", "substring"]}


def test_related_pairs_of_old_claims(spark):
    rnd, at = random.Random(3), datetime(2024, 1, 1)
    alone = [(i, "p", "x", ",".join(f"w{i}n{k}" for k in range(6)), at - timedelta(minutes=i)) for i in range(100)]
    old = [(1000 + i, "p", "x", ",".join(rnd.choices("abcdefghijkl", k=6)), at - timedelta(days=9, minutes=i)) for i in range(40)]
    twins = [(2000 + i, "q", "xy"[i % 7 == 0], "one,two,three,four" if i % 2 else "one,two,three,five", at - timedelta(minutes=i)) for i in range(30)]
    rows = alone + old + twins
    order = sorted(rows, key=lambda r: (r[1], -r[4].timestamp(), r[0]))
    want, sets = {"p": [], "q": []}, {r[0]: set(r[3].split(",")) for r in rows}
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a[1:3] == b[1:3] and 0.35 <= len(sets[a[0]] & sets[b[0]]) / len(sets[a[0]] | sets[b[0]]) < 0.7:
                want[a[1]].append((a[0], b[0]))
    got = {"p": [], "q": []}
    for r in N.related_pairs(spark.createDataFrame(rows, "claim_id long, project_id string, topic string, text string, updated_at timestamp")).orderBy("pos").collect():
        got[r.project_id].append((r.claim_a, r.claim_b))
    assert got == {k: v[:8] for k, v in want.items()} and len(got["p"]) == len(got["q"]) == 8
