"""Details of claims and evidence: rows are narrow where they move."""

from claimweave.operators import reads as R


def test_details_move_narrow_rows(spark):
    made = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    claims = made([(1, "one", "likely"), (2, "two", "verified")], "claim_id long, text string, confidence_band string")
    links = made([(1, 10, "supports", "direct"), (9, 10, "refutes", "direct"), (2, 99, "mentions", "direct")], "claim_id long, evidence_id long, stance string, directness string")
    evidence = made([(10, 5, 7, "q"), (11, 5, 7, "r")], "evidence_id long, snapshot_id long, source_id long, quote string")
    sources = made([(7, "s", "press", "o", 0.5)], "source_id long, name string, source_type string, owner_key string, authority_prior double")
    snapshots = made([(5, 3, "then", "h")], "snapshot_id long, document_id long, fetched_at string, content_hash string")
    conflicts = made([(100, 1, 2, "open"), (101, 1, 8, "open")], "conflict_id long, claim_a long, claim_b long, status string")
    revisions = made([(1000, 1, "edit", "me"), (1001, 9, "edit", "me")], "revision_id long, claim_id long, action string, actor string")
    told = R.origins(evidence, sources, snapshots, made([(3, "t")], "document_id long, title string"))
    detail = R.claim_detail(claims, told, links, conflicts, revisions)
    got = sorted(tuple(r) for r in detail.collect())
    assert got == [
        (1, "conflict", "100", "open|one|two"), (1, "evidence", "10", "supports|direct|s|t|q"), (1, "revision", "1000", "edit|me"), (2, "conflict", "100", "open|one|two"),
    ]
    used = R.evidence_detail(told, evidence, links, claims).drop("fetched_at")
    assert sorted((r["evidence_id"], r["claim_id"] or 0, r["claim_text"] or "", r["document_title"] or "") for r in used.collect()) == [(10, 1, "one", "t"), (10, 9, "", "t"), (11, 0, "", "")]
    # claims are asked for before texts are put together: no payload is below a semi join
    plan = detail._jdf.queryExecution().optimizedPlan().toString()
    semi = [line for line in plan.splitlines() if "Join LeftSemi" in line]
    assert len(semi) == 2 and plan.index("concat_ws(|, stance") < plan.index("Join LeftSemi")
