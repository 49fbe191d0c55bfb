"""Provenance reads, rollups, entity graph and audits over stored claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.operators import audit as A, reads as R, scoring as S
from claimweave.plans.registry import BIND, Tables, query

BIND["stored_claims"] = """
SELECT c.claim_id, project_id, claim_id AS seq, claim_type, topic, text, merged_into, review_state0 AS review_state,
       CASE claim_id % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'likely' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'disputed'
                         WHEN 4 THEN 'insufficient' ELSE 'likely' END AS confidence_band,
       prior AS confidence, updated_at,
       CASE WHEN claim_id % 13 = 0 THEN 'deprecated' WHEN claim_id % 11 = 0 THEN 'preferred' ELSE 'normal' END AS rank
FROM (SELECT *, CASE WHEN review_state = 'pending' AND claim_id % 3 < 2 THEN 'auto_accepted' ELSE review_state END AS review_state0
      FROM {flat_claims}) c
JOIN (SELECT l_partkey, max(l_shipdate) AS updated_at FROM {lineitem} GROUP BY l_partkey) u ON u.l_partkey = c.claim_id
"""
BIND["docs"] = """
SELECT c_custkey AS document_id, c_name AS title, c_custkey % (SELECT count(*) FROM {supplier}) AS source_id,
       'Brand#' || CAST(c_nationkey + 1 AS STRING) AS project_id, c_mktsegment AS doc_type
FROM {customer}
"""
BIND["queue"] = """
SELECT o_orderkey AS queue_id, 'Brand#' || CAST(o_custkey % 25 + 1 AS STRING) AS project_id,
       CASE o_orderstatus WHEN 'F' THEN 'claim' WHEN 'O' THEN 'source' ELSE 'conflict' END AS item_type,
       CAST(CASE o_orderstatus WHEN 'P' THEN o_orderkey ELSE o_custkey END AS STRING) AS item_id,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
       CASE WHEN o_totalprice > 100000 THEN 'todo' ELSE 'done' END AS state, o_orderdate AS created_at
FROM {orders}
"""
BIND["revisions"] = "SELECT event_id AS revision_id, user_id AS claim_id, event_type AS action, 'system:scorer' AS actor, ts AS made_at FROM {events}"
BIND["api_logs"] = """
SELECT event_id AS log_id, user_id AS key_id, event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       value AS duration_ms, ts AS called_at FROM {events}
"""
BIND["api_keys"] = """
SELECT c_custkey AS key_id, c_name AS name,
       CASE WHEN c_custkey % 20 = 0 THEN '*' ELSE 'Brand#' || CAST(c_nationkey + 1 AS STRING) || ',Brand#' || CAST(c_custkey % 25 + 1 AS STRING) END AS scope,
       last_purchase AS expires_at, CASE WHEN c_custkey % 3 = 0 THEN last_signup END AS revoked_at, first_seen AS rotated_at
FROM {customer} LEFT JOIN (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_purchase,
     max(CASE WHEN event_type = 'signup' THEN ts END) AS last_signup, min(ts) AS first_seen FROM {events} GROUP BY user_id) e ON user_id = c_custkey
"""
BIND["projects"] = "SELECT DISTINCT p_brand AS project_id FROM {part}"
BIND["entities"] = """
SELECT s_suppkey AS entity_id, s_name AS canonical_name, 'region' || CAST(n_regionkey AS STRING) AS project_id
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
"""
BIND["claim_entities"] = "SELECT DISTINCT l_orderkey AS claim_id, l_suppkey AS entity_id FROM {lineitem}"
BIND["order_claims"] = """
SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey + 1 END AS merged_into,
       CASE o_orderstatus WHEN 'O' THEN 'auto_accepted' WHEN 'P' THEN 'approved' ELSE 'pending' END AS review_state,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'likely' ELSE 'uncertain' END AS confidence_band
FROM {orders}
"""
TRUST = "review_state IN ('auto_accepted', 'approved') AND confidence_band IN ('verified', 'likely')"


def told(t: Tables) -> DataFrame:
    return R.origins(t.evidence, t.sources, t.snapshots, t.docs)


BIND["x_chain"] = """
SELECT ce.*, e.quote, e.published_at, s.name AS source_name, s.source_type, s.authority_prior, sn.document_id, sn.fetched_at, d.title
FROM {claim_evidence} ce JOIN {evidence} e ON e.evidence_id = ce.evidence_id JOIN {sources} s ON s.source_id = e.source_id
JOIN {snapshots} sn ON sn.snapshot_id = e.snapshot_id JOIN {docs} d ON d.document_id = sn.document_id
"""


@query(
    "claim_detail",
    """SELECT claim_id, 'evidence' AS part, CAST(evidence_id AS VARCHAR) AS item_id, concat_ws('|', stance, directness, source_name, title, quote) AS payload
 FROM {x_chain} WHERE claim_id IN (SELECT claim_id FROM {stored_claims})
 UNION ALL SELECT c.claim_id, 'conflict', CAST(conflict_id AS VARCHAR), concat_ws('|', k.status, a.text, b.text)
 FROM {conflicts} k JOIN {stored_claims} c ON c.claim_id IN (k.claim_a, k.claim_b) JOIN {stored_claims} a ON a.claim_id = claim_a JOIN {stored_claims} b ON b.claim_id = claim_b
 UNION ALL SELECT claim_id, 'revision', CAST(revision_id AS VARCHAR), action || '|' || actor FROM {revisions} WHERE claim_id IN (SELECT claim_id FROM {stored_claims})""",
)
def claim_detail(t: Tables) -> DataFrame:
    return R.claim_detail(t.stored_claims, told(t), t.claim_evidence, t.conflicts, t.revisions)


@query(
    "evidence_detail",
    "SELECT e.evidence_id, e.quote, x.claim_id, x.stance, x.source_name, x.title AS document_title, c.text AS claim_text, c.confidence_band FROM {evidence} e LEFT JOIN {x_chain} x ON x.evidence_id = e.evidence_id LEFT JOIN {stored_claims} c ON c.claim_id = x.claim_id",
)
def evidence_detail(t: Tables) -> DataFrame:
    return R.evidence_detail(told(t), t.evidence, t.claim_evidence, t.stored_claims).drop("fetched_at")


@query(
    "source_detail",
    "SELECT s.source_id, s.name, s.source_type, (SELECT count(*) FROM {docs} d WHERE d.source_id = s.source_id) AS document_count FROM {sources} s",
)
def source_detail(t: Tables) -> DataFrame:
    return R.with_counts(t.sources.select("source_id", "name", "source_type"), "source_id", {"document_count": t.docs})


@query(
    "source_list",
    "SELECT s.source_id, s.project_id, s.name, s.authority_prior, (SELECT count(*) FROM {docs} d WHERE d.source_id = s.source_id) AS document_count, (SELECT count(*) FROM {evidence} e WHERE e.source_id = s.source_id) AS evidence_count FROM {sources} s ORDER BY authority_prior DESC, evidence_count DESC",
)
def source_list(t: Tables) -> DataFrame:
    out = R.source_list(t.sources.select("source_id", "project_id", "name", "authority_prior"), t.docs, t.evidence)
    return out.orderBy(F.col("authority_prior").desc(), F.col("evidence_count").desc())


@query(
    "latest_snapshot",
    "SELECT document_id, title, (SELECT count(*) FROM {snapshots} s WHERE s.document_id = d.document_id) AS snapshot_count, (SELECT snapshot_id FROM {snapshots} s WHERE s.document_id = d.document_id ORDER BY fetched_at DESC, snapshot_id DESC LIMIT 1) AS latest_snapshot_id FROM {docs} d",
)
def latest_snapshot(t: Tables) -> DataFrame:
    return R.latest_snapshot(t.docs.select("document_id", "title"), t.snapshots)


@query(
    "snapshot_detail",
    "SELECT snapshot_id, content_hash, d.title, s.name AS source_name, s.source_type FROM {snapshots} x JOIN {docs} d ON d.document_id = x.document_id JOIN {sources} s ON s.source_id = d.source_id",
)
def snapshot_detail(t: Tables) -> DataFrame:
    s = t.sources.select("source_id", F.col("name").alias("source_name"), "source_type")
    out = t.snapshots.join(t.docs, "document_id").join(s, "source_id")
    return out.select("snapshot_id", "content_hash", "title", "source_name", "source_type")


@query(
    "claim_list",
    """SELECT * FROM (SELECT claim_id, project_id, seq, claim_type, confidence_band, (SELECT count(*) FROM {claim_evidence} e WHERE e.claim_id = c.claim_id) AS evidence_count,
 row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) AS pos FROM {stored_claims} c
 WHERE merged_into IS NULL AND claim_type IN ('official_fact', 'creative_insight') AND confidence_band IN ('verified', 'likely') AND contains(lower(text), 'red')) x WHERE pos > 2 AND pos <= 12""",
)
def claim_list(t: Tables) -> DataFrame:
    kept = R.claim_filter(t.stored_claims, claim_types=["official_fact", "creative_insight"], bands=["verified", "likely"], text="red")
    page = R.claim_page(kept, t.claim_evidence, limit=10, offset=2)
    return page.select("claim_id", "project_id", "seq", "claim_type", "confidence_band", "evidence_count", "pos")


@query("claim_list_total", "SELECT project_id, count(*) AS total FROM {stored_claims} c WHERE merged_into IS NULL AND review_state = 'approved' AND claim_id IN (SELECT claim_id FROM {claim_entities} WHERE entity_id IN (1, 2, 3)) GROUP BY project_id")
def claim_list_total(t: Tables) -> DataFrame:
    kept = R.claim_filter(t.stored_claims, states=["approved"], entity_ids=[1, 2, 3], claim_entities=t.claim_entities)
    return R.claim_totals(kept)


@query(
    "review_queue",
    """SELECT q.project_id, q.queue_id, q.item_type, q.priority, q.pos, coalesce(c.text, s.name, concat_ws('|', k.claim_a, k.claim_b, k.status)) AS payload
 FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority, created_at, queue_id) AS pos FROM {queue} WHERE state = 'todo') q
 LEFT JOIN {stored_claims} c ON q.item_type = 'claim' AND CAST(c.claim_id AS VARCHAR) = q.item_id
 LEFT JOIN {sources} s ON q.item_type = 'source' AND CAST(s.source_id AS VARCHAR) = q.item_id
 LEFT JOIN {conflicts} k ON q.item_type = 'conflict' AND CAST(k.conflict_id AS VARCHAR) = q.item_id WHERE pos <= 100""",
)
def review_queue(t: Tables) -> DataFrame:
    out = R.review_queue(t.queue, t.stored_claims, t.sources, t.conflicts)
    out = out.withColumn("payload", F.coalesce("payload", F.lit("")))
    return out.select("project_id", "queue_id", "item_type", "priority", "pos", "payload")


@query(
    "conflict_list",
    "SELECT conflict_id, claim_a, claim_b, status, a.text AS claim_a_text, a.confidence_band AS claim_a_band, b.text AS claim_b_text, b.confidence_band AS claim_b_band FROM {conflicts} JOIN {stored_claims} a ON a.claim_id = claim_a JOIN {stored_claims} b ON b.claim_id = claim_b WHERE status = 'open'",
)
def conflict_list(t: Tables) -> DataFrame:
    return R.conflict_list(t.conflicts, t.stored_claims, status="open")


BIND["project_conflicts"] = "SELECT k.*, c.project_id FROM {conflicts} k JOIN {flat_claims} c ON c.claim_id = k.claim_a"
BIND["x_rollup"] = f"""
SELECT p.project_id, (SELECT count(*) FROM {{evidence}} e JOIN {{claim_evidence}} ce USING (evidence_id) JOIN {{stored_claims}} c ON c.claim_id = ce.claim_id WHERE c.project_id = p.project_id) AS evidence,
 (SELECT count(*) FROM {{sources}} s WHERE s.project_id = p.project_id) AS sources, (SELECT count(*) FROM {{docs}} d WHERE d.project_id = p.project_id) AS documents,
 (SELECT count(*) FROM {{queue}} q WHERE q.project_id = p.project_id AND state = 'todo') AS pending_review,
 (SELECT count(*) FROM {{project_conflicts}} k WHERE k.project_id = p.project_id AND status = 'open') AS open_conflicts,
 count(claim_id) AS claims, count_if({TRUST}) AS trusted, count_if(confidence_band = 'verified') AS verified, count_if(confidence_band = 'likely') AS likely,
 count_if(confidence_band = 'uncertain') AS uncertain, count_if(confidence_band = 'disputed') AS disputed, count_if(confidence_band = 'insufficient') AS insufficient
FROM {{projects}} p LEFT JOIN (SELECT * FROM {{stored_claims}} WHERE merged_into IS NULL) c ON c.project_id = p.project_id GROUP BY p.project_id
"""
MEASURES = ["claims", "trusted", *S.BANDS, "evidence", "sources", "documents", "pending_review", "open_conflicts"]


def rollup(t: Tables) -> DataFrame:
    owner = t.claim_evidence.join(t.stored_claims.select("claim_id", "project_id"), "claim_id").select("evidence_id", "project_id")
    ev = t.evidence.join(owner, "evidence_id")
    return R.project_rollup(t.projects, t.stored_claims, ev, t.sources, t.docs, t.queue, t.project_conflicts)


@query("project_rollup", "SELECT * FROM {x_rollup}")
def project_rollup(t: Tables) -> DataFrame:
    return rollup(t)


@query("grand_total", f"SELECT project_id, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in MEASURES)} FROM {{x_rollup}} GROUP BY ROLLUP (project_id)")
def grand_total(t: Tables) -> DataFrame:
    return R.grand_total(rollup(t), MEASURES)


@query(
    "recent_activity",
    """SELECT * FROM (SELECT 'call' AS kind, log_id AS id, name FROM (SELECT * FROM {api_logs} ORDER BY log_id DESC LIMIT 10) l LEFT JOIN {api_keys} k ON k.key_id = l.key_id)
 UNION ALL SELECT * FROM (SELECT 'claim', claim_id, project_id FROM {stored_claims} WHERE merged_into IS NULL ORDER BY updated_at DESC, claim_id DESC LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'run', o_orderkey, c_name FROM (SELECT * FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8) JOIN {customer} ON c_custkey = o_custkey)""",
)
def recent_activity(t: Tables) -> DataFrame:
    calls = R.recent(t.api_logs, t.api_keys.select("key_id", "name"), "key_id", [F.col("log_id").desc()], 10)
    live = t.stored_claims.filter(F.col("merged_into").isNull())
    named = R.recent(live, t.projects, "project_id", [F.col("updated_at").desc(), F.col("claim_id").desc()], 10)
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    runs = R.recent(t.orders, names, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 8)
    shape = lambda df, kind, i, n: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name"))
    return shape(calls, "call", "log_id", "name").unionByName(shape(named, "claim", "claim_id", "project_id")).unionByName(
        shape(runs, "run", "o_orderkey", "c_name")
    )


@query("api_log_list", "SELECT log_id, l.key_id, name, route, status, floor(duration_ms * 10 + 0.5) / 10 AS duration_ms FROM {api_logs} l LEFT JOIN {api_keys} k ON k.key_id = l.key_id")
def api_log_list(t: Tables) -> DataFrame:
    out = R.api_log_rows(t.api_logs).join(t.api_keys.select("key_id", "name"), "key_id", "left")
    return out.select("log_id", "key_id", "name", "route", "status", "duration_ms")


@query(
    "api_log_stats",
    "SELECT key_id, route, count(*) AS calls, floor(avg(CASE WHEN status >= 400 THEN 1.0 ELSE 0.0 END) * 1000 + 0.5) / 1000 AS error_share, quantile_disc(floor(duration_ms * 10 + 0.5) / 10, 0.5) AS median_ms, quantile_disc(floor(duration_ms * 10 + 0.5) / 10, 0.95) AS p95_ms, max(floor(duration_ms * 10 + 0.5) / 10) AS max_ms, epoch_us(max(called_at)) AS last_used FROM {api_logs} GROUP BY key_id, route",
)
def api_log_stats(t: Tables) -> DataFrame:
    return R.api_log_stats(t.api_logs).withColumn("last_used", F.unix_micros(F.col("last_used").cast("timestamp")))


@query(
    "api_latency_ranks",
    "SELECT key_id, route, count(duration_ms) AS calls, true AS median_near, true AS p95_near FROM {api_logs} WHERE duration_ms IS NOT NULL GROUP BY key_id, route",
)
def api_latency_ranks(t: Tables) -> DataFrame:
    """Quantiles from merged hourly sketches stand within two hundredths of the rank asked for."""
    told = R.latency_quantiles(R.latency_sketches(t.api_logs)).withColumnRenamed("calls", "n")
    rows = R.api_log_rows(t.api_logs).filter("duration_ms is not null").join(told, ["key_id", "route"])
    counts = rows.groupBy("key_id", "route", "n").agg(
        *(F.count_if(F.col("duration_ms") < F.col(q)).alias(f"below_{q}") for q in ("q50", "q95")),
        *(F.count_if(F.col("duration_ms") <= F.col(q)).alias(f"upto_{q}") for q in ("q50", "q95")),
    )
    slack = 0.02 * F.col("n") + 1
    near = lambda q, p: (F.col(f"below_{q}") <= p * F.col("n") + slack) & (F.col(f"upto_{q}") >= p * F.col("n") - slack)
    return counts.select("key_id", "route", F.col("n").alias("calls"), near("q50", 0.5).alias("median_near"), near("q95", 0.95).alias("p95_near"))


@query(
    "allowed_projects",
    "SELECT DISTINCT w.key_id, w.project_id FROM (SELECT DISTINCT o_custkey AS key_id, p_brand AS project_id FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey) w JOIN {api_keys} k ON k.key_id = w.key_id WHERE list_contains(string_split(scope, ','), '*') OR list_contains(string_split(scope, ','), w.project_id)",
)
def allowed_projects(t: Tables) -> DataFrame:
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    wanted = lines.select(F.col("o_custkey").alias("key_id"), F.col("p_brand").alias("project_id")).distinct()
    keys = t.api_keys.withColumn("project_ids", F.split("scope", ","))
    return R.allowed_pairs(keys, t.projects, wanted).select("key_id", "project_id")


@query(
    "valid_key_calls",
    "SELECT log_id, l.key_id FROM {api_logs} l JOIN (SELECT *, CASE WHEN rotated_at IS NULL OR revoked_at IS NOT NULL THEN expires_at ELSE least(expires_at, rotated_at + INTERVAL 240 HOUR) END AS ends FROM {api_keys}) k ON k.key_id = l.key_id WHERE (revoked_at IS NULL OR revoked_at > called_at) AND (ends IS NULL OR ends > called_at)",
)
def valid_key_calls(t: Tables) -> DataFrame:
    return R.valid_calls(t.api_logs, R.rotated_expiry(t.api_keys, grace_hours=240)).select("log_id", "key_id")


BIND["x_top"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY claims DESC, entity_id) AS pos FROM (
  SELECT e.entity_id, e.project_id, e.canonical_name, count(*) AS claims, count_if({TRUST}) AS trusted
  FROM {{entities}} e JOIN {{claim_entities}} ce ON ce.entity_id = e.entity_id JOIN {{order_claims}} c ON c.claim_id = ce.claim_id AND c.merged_into IS NULL
  GROUP BY ALL) a) b WHERE pos <= 24
"""


def top_entities(t: Tables) -> DataFrame:
    return R.entity_top(t.entities, t.claim_entities, t.order_claims)


@query("entity_top", "SELECT entity_id, project_id, canonical_name, claims, trusted, pos FROM {x_top}")
def entity_top(t: Tables) -> DataFrame:
    return top_entities(t).select("entity_id", "project_id", "canonical_name", "claims", "trusted", "pos")


@query(
    "entity_cooccurrence",
    "SELECT ta.project_id, a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS shared FROM {claim_entities} a JOIN {claim_entities} b ON a.claim_id = b.claim_id AND a.entity_id < b.entity_id JOIN {x_top} ta ON ta.entity_id = a.entity_id JOIN {x_top} tb ON tb.entity_id = b.entity_id AND tb.project_id = ta.project_id GROUP BY ALL HAVING count(*) >= 2",
)
def entity_cooccurrence(t: Tables) -> DataFrame:
    return R.entity_cooccurrence(top_entities(t), t.claim_entities)


@query(
    "entity_list",
    "SELECT entity_id, project_id, claim_count FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY claim_count DESC, entity_id) AS pos FROM (SELECT e.*, (SELECT count(*) FROM {claim_entities} c WHERE c.entity_id = e.entity_id) AS claim_count FROM {entities} e) a) b WHERE pos <= 100",
)
def entity_list(t: Tables) -> DataFrame:
    return R.entity_list(t.entities, t.claim_entities).select("entity_id", "project_id", "claim_count")


# ---- audits


@query("audit_unsupported", "SELECT claim_id FROM {stored_claims} c WHERE review_state IN ('auto_accepted', 'approved') AND merged_into IS NULL AND NOT EXISTS (SELECT 1 FROM {claim_evidence} e WHERE e.claim_id = c.claim_id AND e.stance = 'supports')")
def audit_unsupported(t: Tables) -> DataFrame:
    return A.trusted_without_support(t.stored_claims, t.claim_evidence).select("claim_id")


@query("audit_null_scores", "SELECT claim_id, confidence FROM {stored_claims} WHERE confidence_band = 'insufficient' AND confidence IS NOT NULL")
def audit_null_scores(t: Tables) -> DataFrame:
    return A.insufficient_with_score(t.stored_claims).select("claim_id", "confidence")


@query(
    "audit_single_source",
    "SELECT claim_id FROM {stored_claims} c WHERE confidence_band = 'verified' AND merged_into IS NULL AND claim_type <> 'player_opinion' AND (SELECT count(*) FROM {x_groups} g WHERE g.claim_id = c.claim_id AND g.stance = 'supports') < 2",
)
def audit_single_source(t: Tables) -> DataFrame:
    from claimweave.plans.score_queries import links

    return A.verified_single_source(t.stored_claims, links(t)).select("claim_id")


@query("audit_trust_boundary", "SELECT claim_id FROM {stored_claims} WHERE review_state = 'auto_accepted' AND confidence_band IN ('uncertain', 'disputed', 'insufficient')")
def audit_trust_boundary(t: Tables) -> DataFrame:
    return A.untrusted_accepted(t.stored_claims).select("claim_id")


SAFE = "({0}.confidence_band = 'disputed' OR {0}.review_state IN ('quarantined', 'rejected') OR {0}.rank = 'deprecated')"


@query("audit_conflicts", f"SELECT conflict_id FROM {{conflicts}} k JOIN {{stored_claims}} a ON a.claim_id = k.claim_a JOIN {{stored_claims}} b ON b.claim_id = k.claim_b WHERE k.status = 'open' AND NOT ({SAFE.format('a')} AND {SAFE.format('b')})")
def audit_conflicts(t: Tables) -> DataFrame:
    return A.loose_conflicts(t.conflicts, t.stored_claims).select("conflict_id")


@query(
    "audit_enums",
    "SELECT 'status' AS field, o_orderstatus AS bad_value, CAST(o_orderkey AS VARCHAR) AS row_id FROM {orders} UNION ALL SELECT 'item_type', event_type, CAST(event_id AS VARCHAR) FROM {events} WHERE event_type NOT IN ('claim', 'conflict', 'source')",
)
def audit_enums(t: Tables) -> DataFrame:
    a = A.vocabulary_violations(t.orders.withColumnRenamed("o_orderstatus", "status"), ["status"], "o_orderkey")
    b = A.vocabulary_violations(t.events.withColumnRenamed("event_type", "item_type"), ["item_type"], "event_id")
    clean = A.vocabulary_violations(t.stored_claims, ["claim_type", "review_state", "confidence_band", "rank"], "claim_id")
    return a.unionByName(b).unionByName(clean)


@query("audit_orphans", "SELECT claim_id, merged_into FROM {flat_claims} WHERE merged_into IS NOT NULL AND merged_into NOT IN (SELECT l_suppkey FROM {lineitem})")
def audit_orphans(t: Tables) -> DataFrame:
    return A.orphans(t.flat_claims, "merged_into", t.lineitem, "l_suppkey").select("claim_id", "merged_into")


@query("band_distribution", "SELECT confidence_band, count(*) AS n FROM {stored_claims} WHERE merged_into IS NULL GROUP BY confidence_band")
def band_distribution(t: Tables) -> DataFrame:
    return A.band_distribution(t.stored_claims)


@query("coverage", "SELECT project_id, topic, claim_type, confidence_band, count(*) AS n FROM {stored_claims} WHERE merged_into IS NULL GROUP BY ALL")
def coverage(t: Tables) -> DataFrame:
    from claimweave.operators.extract import coverage_counts

    return coverage_counts(t.stored_claims)
