"""Upserts, change capture, sequence numbers, merges, decisions and run upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.operators import merge as M
from claimweave.operators.chains import chain_ends, merge_to_ends
from claimweave.plans import sqltext as Q
from claimweave.plans.registry import AS_OF, BIND, Tables, query

BIND["source_batch"] = """
SELECT lang AS project_id, 'web' AS connector, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS url, source AS name, doc_id FROM {documents}
"""
BIND["known_sources"] = "SELECT lang AS project_id, 'web' AS connector, source AS url FROM {documents} WHERE lang = 'de'"


@query(
    "source_upsert",
    "SELECT * FROM (SELECT project_id, connector, coalesce(url, '') AS url, arg_min(name, doc_id) AS name, min(doc_id) AS doc_id FROM {source_batch} GROUP BY ALL) x WHERE NOT EXISTS (SELECT 1 FROM {known_sources} k WHERE k.project_id = x.project_id AND k.url = x.url)",
)
def source_upsert(t: Tables) -> DataFrame:
    return M.upsert_sources(t.source_batch, t.known_sources, ["doc_id"])


BIND["doc_batch"] = "SELECT conv_id % 3 AS project_id, role || CAST(turn AS STRING) AS canonical_url, conv_id, turn FROM {conversations}"


@query("document_upsert", "SELECT project_id, canonical_url, min(conv_id) AS conv_id, arg_min(turn, conv_id) AS turn FROM {doc_batch} GROUP BY ALL")
def document_upsert(t: Tables) -> DataFrame:
    return M.upsert_documents(t.doc_batch, None, ["conv_id", "turn"])


BIND["fetches"] = "SELECT user_id AS document_id, ts AS fetched_at, event_id AS fetch_id, event_type || '  ' || event_type AS text FROM {events}"
BIND["x_changes"] = f"""
SELECT * FROM (SELECT *, lag(h) OVER (PARTITION BY document_id ORDER BY fetched_at, fetch_id::VARCHAR) AS p FROM (
  SELECT *, sha256({Q.normalize('text')}) AS h FROM {{fetches}}) a) b WHERE p IS NULL OR p <> h
"""


@query("snapshot_changes", "SELECT document_id, fetch_id::VARCHAR AS fetch_id, h AS content_hash FROM {x_changes}")
def snapshot_changes(t: Tables) -> DataFrame:
    return M.snapshot_changes(t.fetches).select("document_id", "fetch_id", "content_hash")


BIND["new_claims"] = """
SELECT o_orderkey AS claim_id, o_orderpriority AS project_id, o_orderdate AS created_at, o_orderstatus || ' ' || CAST(o_custkey AS STRING) AS text FROM {orders}
"""


BIND["numbered_claims"] = "SELECT o_orderpriority AS project_id, o_custkey AS seq FROM {orders} WHERE o_orderstatus = 'F'"


@query(
    "claim_seq",
    "SELECT claim_id, n.project_id, row_number() OVER (PARTITION BY n.project_id ORDER BY created_at, claim_id) + coalesce(top, 0) AS seq FROM {new_claims} n LEFT JOIN (SELECT project_id, max(seq) AS top FROM {numbered_claims} GROUP BY 1) k ON k.project_id = n.project_id",
)
def claim_seq(t: Tables) -> DataFrame:
    return M.claim_sequence(t.new_claims, t.numbered_claims).select("claim_id", "project_id", "seq")


BIND["x_exact"] = f"""
SELECT claim_id, canonical_id FROM (SELECT claim_id, min(claim_id) OVER (PARTITION BY project_id, {Q.match_normalize('text')}) AS canonical_id FROM {{new_claims}}) x WHERE claim_id <> canonical_id
"""


@query("claim_exact_dedupe", "SELECT * FROM {x_exact}")
def claim_exact_dedupe(t: Tables) -> DataFrame:
    return M.exact_duplicates(t.new_claims)


BIND["order_edges"] = "SELECT l_orderkey AS claim_id, l_partkey AS evidence_id, min(l_linenumber) AS line FROM {lineitem} GROUP BY l_orderkey, l_partkey"


@query(
    "claim_merge",
    "SELECT claim_id, evidence_id, CAST(arg_min(line, (moved::INT, orig)) AS INT) AS line FROM (SELECT coalesce(x.canonical_id, e.claim_id) AS claim_id, evidence_id, line, x.canonical_id IS NOT NULL AS moved, e.claim_id AS orig FROM {order_edges} e LEFT JOIN {x_exact} x ON x.claim_id = e.claim_id) y GROUP BY ALL",
)
def claim_merge(t: Tables) -> DataFrame:
    return M.repoint_edges(t.order_edges, M.exact_duplicates(t.new_claims))


@query(
    "claim_merge_states",
    "SELECT c.claim_id, coalesce(x.canonical_id, c.merged_into) AS merged_into, CASE WHEN x.claim_id IS NOT NULL THEN 'merged' ELSE review_state END AS review_state FROM {order_claims} c LEFT JOIN {x_exact} x ON x.claim_id = c.claim_id",
)
def claim_merge_states(t: Tables) -> DataFrame:
    return M.merge_claims(t.order_claims, M.exact_duplicates(t.new_claims)).select("claim_id", "merged_into", "review_state")


BIND["x_success"] = """
SELECT CASE status WHEN 'resolved_a' THEN claim_b ELSE claim_a END AS claim_id, CASE status WHEN 'resolved_a' THEN claim_a ELSE claim_b END AS superseded_by
FROM {conflicts} WHERE status IN ('resolved_a', 'resolved_b')
"""


# claims of which some were superseded long ago
BIND["dated_claims"] = """
SELECT *, CASE WHEN claim_id % 7 = 3 THEN claim_id - 1 END AS superseded_by, CASE WHEN claim_id % 7 = 3 THEN CAST('1999-05-06 00:00:00' AS TIMESTAMP) END AS valid_until FROM {stored_claims}
"""


@query(
    "conflict_apply",
    f"SELECT c.claim_id, coalesce(l.w, c.superseded_by) AS superseded_by, CASE WHEN l.w IS NOT NULL THEN 'deprecated' WHEN c.claim_id IN (SELECT superseded_by FROM {{x_success}}) THEN 'preferred' ELSE c.rank END AS rank, CASE WHEN l.w IS NOT NULL THEN '{AS_OF[:10]}' WHEN c.superseded_by IS NOT NULL THEN '1999-05-06' END AS valid_until FROM {{dated_claims}} c LEFT JOIN (SELECT claim_id, max(superseded_by) AS w FROM {{x_success}} GROUP BY 1) l ON l.claim_id = c.claim_id",
)
def conflict_apply(t: Tables) -> DataFrame:
    out = M.supersede(t.dated_claims, M.verdict_succession(t.conflicts), AS_OF)
    return out.select("claim_id", "superseded_by", "rank", F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"))


BIND["old_states"] = "SELECT o_custkey AS claim_id, max(o_orderpriority) AS review_state, max(o_totalprice) AS confidence FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey"
BIND["new_states"] = "SELECT o_custkey AS claim_id, max(o_orderpriority) AS review_state, max(o_totalprice) AS confidence FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_custkey"


@query(
    "revision_log",
    "SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, 'rescore' AS action, a.claim_id IS NOT NULL AS had_before, b.claim_id IS NOT NULL AS has_after FROM {old_states} a FULL JOIN {new_states} b ON a.claim_id = b.claim_id WHERE (a.review_state, a.confidence) IS DISTINCT FROM (b.review_state, b.confidence)",
)
def revision_log(t: Tables) -> DataFrame:
    log = M.revision_log(t.old_states, t.new_states, ["review_state", "confidence"], "system:scorer", "rescore")
    return log.select("claim_id", "action", F.col("before_json").isNotNull().alias("had_before"), F.col("after_json").isNotNull().alias("has_after"))


BIND["decisions"] = """
SELECT user_id AS claim_id, CASE event_type WHEN 'view' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'quarantine' END AS action, ts AS decided_at
FROM {events} WHERE event_type IN ('view', 'error', 'signup')
"""
BIND["x_decided"] = "SELECT claim_id, arg_max(action, decided_at) AS action FROM {decisions} GROUP BY claim_id"


@query(
    "apply_decisions",
    "SELECT c.claim_id, CASE d.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'quarantine' THEN 'quarantined' ELSE c.review_state END AS review_state FROM {stored_claims} c LEFT JOIN {x_decided} d ON d.claim_id = c.claim_id",
)
def apply_decisions(t: Tables) -> DataFrame:
    return M.apply_decisions(t.stored_claims, t.queue, t.decisions)[0].select("claim_id", "review_state")


BIND["decided_queue"] = "SELECT *, CASE WHEN state = 'done' THEN 'approve' END AS decision FROM {queue}"


@query(
    "close_queue",
    "SELECT queue_id, CASE WHEN state = 'todo' AND d.action IS NOT NULL THEN 'done' ELSE state END AS state, CASE WHEN state = 'todo' THEN d.action ELSE decision END AS decision FROM {decided_queue} q LEFT JOIN {x_decided} d ON q.item_type = 'claim' AND q.item_id = d.claim_id::VARCHAR",
)
def close_queue(t: Tables) -> DataFrame:
    return M.apply_decisions(t.stored_claims, t.decided_queue, t.decisions)[1].select("queue_id", "state", "decision")


BIND["entity_batch"] = """
SELECT p_type AS project_id, l_orderkey AS claim_id, 'company' AS entity_type, p_brand AS canonical_name FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
"""


@query("entity_upsert", "SELECT DISTINCT project_id, entity_type, canonical_name FROM {entity_batch}")
def entity_upsert(t: Tables) -> DataFrame:
    return M.upsert_entities(t.entity_batch)[0].select("project_id", "entity_type", "canonical_name")


@query(
    "entity_links",
    "SELECT DISTINCT claim_id, sha256(concat_ws(chr(1), project_id, entity_type, canonical_name)) AS entity_id FROM {entity_batch}",
)
def entity_links(t: Tables) -> DataFrame:
    return M.upsert_entities(t.entity_batch)[1].select("claim_id", "entity_id")


BIND["runs"] = """SELECT event_id AS run_id, user_id AS project_id, event_type AS goal, ts AS started_at, CASE WHEN event_id % 50 = 0 THEN 'running' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'done' END AS status,
 ts + CAST(event_id % 90 AS INT) * INTERVAL 1 MINUTE AS finished_at FROM {events}"""


REPEATS = "SELECT run_id, project_id, goal FROM {runs} r WHERE EXISTS (SELECT 1 FROM {runs} d WHERE d.project_id = r.project_id AND d.goal = r.goal AND d.status = 'done' AND d.finished_at BETWEEN r.started_at - INTERVAL 30 MINUTE AND r.started_at)"


@query(
    "repeat_runs",
    REPEATS,
)
def repeat_runs(t: Tables) -> DataFrame:
    return M.repeat_runs(t.runs).select("run_id", "project_id", "goal")


@query(
    "delete_runs",
    "SELECT 'run' AS kind, run_id FROM {runs} WHERE status = 'running' OR run_id NOT IN (SELECT conv_id FROM {conversations}) UNION ALL SELECT 'event', l_orderkey FROM {lineitem} WHERE l_orderkey NOT IN (SELECT run_id FROM {runs} WHERE status <> 'running' AND run_id IN (SELECT conv_id FROM {conversations}))",
)
def delete_runs(t: Tables) -> DataFrame:
    gone = t.conversations.select(F.col("conv_id").alias("run_id"))
    runs, events = M.delete_runs(t.runs, t.lineitem.select(F.col("l_orderkey").alias("run_id")), gone)
    return runs.select(F.lit("run").alias("kind"), "run_id").unionByName(events.select(F.lit("event").alias("kind"), "run_id"))


@query(
    "queue_add",
    "SELECT item_type, item_id, reason, CAST(min(priority) AS INT) AS priority FROM (SELECT 'claim' AS item_type, claim_id::VARCHAR AS item_id, reason, CASE reason WHEN 'conflict_open' THEN 1 ELSE 3 END AS priority FROM {x_routed} WHERE reason IS NOT NULL) n WHERE NOT EXISTS (SELECT 1 FROM {queue} q WHERE q.item_type = n.item_type AND q.item_id = n.item_id AND n.reason = 'low_confidence') GROUP BY ALL",
)
def queue_add(t: Tables) -> DataFrame:
    from claimweave.operators.scoring import queue_rows, route_claims
    from claimweave.plans.score_queries import scored

    rows = queue_rows(route_claims(scored(t))).withColumn("item_id", F.col("item_id").cast("string"))
    known = t.queue.withColumn("reason", F.lit("low_confidence"))
    return M.enqueue(rows, known).select("item_type", "item_id", "reason", "priority")


# ---- chains of merges

BIND["pointers"] = """
SELECT p_partkey AS claim_id, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey - 1 WHEN p_partkey % 200 = 0 AND p_partkey > 0 THEN p_partkey + 1 END AS merged_into FROM {part}
"""
ENDS = """WITH RECURSIVE walk(claim_id, stop, hops) AS (SELECT claim_id, merged_into, 1::BIGINT FROM {pointers} WHERE merged_into IS NOT NULL
   UNION ALL SELECT w.claim_id, p.merged_into, w.hops + 1 FROM walk w JOIN {pointers} p ON p.claim_id = w.stop WHERE p.merged_into IS NOT NULL AND w.hops < 60),
 ends AS (SELECT claim_id, CASE WHEN max(hops) < 60 THEN arg_max(stop, hops) END AS last, CASE WHEN max(hops) < 60 THEN max(hops) END AS hops, max(hops) >= 60 AS cycle FROM walk GROUP BY claim_id) """


@query("merge_chains", ENDS + "SELECT claim_id, last, hops, cycle FROM ends")
def merge_chains(t: Tables) -> DataFrame:
    return chain_ends(t.pointers)


@query(
    "merge_chain_edges",
    ENDS + "SELECT coalesce(e.last, l.l_partkey) AS claim_id, l.l_orderkey AS evidence_id FROM {lineitem} l LEFT JOIN ends e ON e.claim_id = l.l_partkey GROUP BY ALL",
)
def merge_chain_edges(t: Tables) -> DataFrame:
    """Evidence follows its claim through all merges."""
    edges = t.lineitem.select(F.col("l_partkey").alias("claim_id"), F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").alias("line"))
    stored = t.pointers.select("claim_id", "merged_into", F.lit("pending").alias("review_state"))
    _, moved, _, _ = merge_to_ends(stored, edges, t.pointers.filter("merged_into is not null").select("claim_id", F.col("merged_into").alias("canonical_id")), "merge")
    return moved.select("claim_id", "evidence_id").distinct()
