"""Search over documents as claims, with benchmark passages as queries; packs over stored claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.operators import pack as K, search as J
from claimweave.plans import sqltext as Q
from claimweave.plans.registry import BIND, Tables, query

NOW = "2024-02-15 00:00:00"
BIND["text_claims"] = """
SELECT d.doc_id AS claim_id, d.lang AS project_id, d.text, d.source AS topic,
  CASE d.doc_id % 3 WHEN 0 THEN 'official_fact' WHEN 1 THEN 'player_opinion' ELSE 'system_inference' END AS claim_type,
  CASE d.doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'uncertain' ELSE 'likely' END AS confidence_band,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST(d.doc_id % 100 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN d.doc_id % 9 = 0 THEN 'pending' WHEN d.doc_id % 2 = 0 THEN 'approved' ELSE 'auto_accepted' END AS review_state,
  CASE WHEN d.doc_id % 11 = 0 THEN 'preferred' WHEN d.doc_id % 13 = 0 THEN 'deprecated' ELSE 'normal' END AS rank,
  CASE WHEN d.doc_id % 37 = 5 THEN d.doc_id - 1 END AS merged_into, e.ts AS updated_at
FROM {documents} d JOIN {events} e ON e.event_id = d.doc_id
"""
BIND["text_evidence"] = "SELECT conv_id * 1000 + turn AS evidence_id, conv_id AS source_id, text AS quote FROM {conversations}"
BIND["text_links"] = "SELECT conv_id * 1000 + turn AS evidence_id, conv_id AS claim_id, CASE WHEN turn % 4 = 3 THEN 'mentions' ELSE 'supports' END AS stance FROM {conversations}"
BIND["text_sources"] = "SELECT DISTINCT conv_id AS source_id, 's' || CAST(conv_id AS STRING) AS name, CASE conv_id % 3 WHEN 0 THEN 'community' ELSE 'press' END AS source_type, CAST(conv_id % 10 AS DOUBLE) / 10 AS authority_prior FROM {conversations}"
BIND["searches"] = """
SELECT item_id AS query_id, text AS query, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS project_id FROM {benchmark}
UNION ALL SELECT 100000 + conv_id, substr(text, 2, 9), CASE WHEN conv_id % 2 = 0 THEN 'en' END FROM {conversations} WHERE turn = 0
"""
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
BIND["x_qterms"] = f"SELECT DISTINCT query_id, project_id, unnest({TERMS.format('query')}) AS term FROM {{searches}}"


def bm25_sql(source: str, item: str, text: str, project: str) -> str:
    lists = f"(SELECT {item}, {project} AS project_id, {TERMS.format(text)} AS ts FROM {{{source}}})"
    return f"""
SELECT query_id, {item}, floor(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) * 1e9 + 0.5) / 1e9 AS score
FROM (SELECT {item}, project_id, size, term, count(*) AS tf FROM (SELECT {item}, project_id, len(ts) AS size, unnest(ts) AS term FROM {lists} l) a GROUP BY ALL) p
JOIN (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM (SELECT {item}, unnest(list_distinct(ts)) AS term FROM {lists} l) b, (SELECT count(*) AS n FROM {{{source}}}) c GROUP BY term, n) i USING (term)
JOIN (SELECT query_id, project_id AS only_project, term FROM {{x_qterms}}) q USING (term), (SELECT avg(len(ts)) AS mean FROM {lists} l) m
WHERE only_project IS NULL OR only_project = project_id GROUP BY query_id, {item}"""


BIND["x_shown"] = "SELECT claim_id, project_id, text, updated_at FROM {text_claims} WHERE merged_into IS NULL AND review_state IN ('auto_accepted', 'approved') AND rank <> 'deprecated'"
BIND["x_kw"] = f"SELECT query_id, claim_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS pos FROM ({bm25_sql('text_claims', 'claim_id', 'text', 'project_id')}) s JOIN {{x_shown}} USING (claim_id)"
BIND["search_evidence"] = "SELECT e.evidence_id, e.source_id, e.quote, CAST(NULL AS STRING) AS project_id FROM {text_evidence} e"
BIND["open_searches"] = "SELECT query_id, query, CAST(NULL AS STRING) AS project_id FROM {searches}"
BIND["x_ev"] = f"""
SELECT query_id, claim_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, claim_id) AS pos
FROM ({bm25_sql('search_evidence', 'evidence_id', 'quote', 'NULL').replace("WHERE only_project IS NULL OR only_project = project_id", "")}) s
JOIN {{text_links}} l USING (evidence_id) JOIN {{x_shown}} c USING (claim_id) JOIN {{searches}} q USING (query_id)
WHERE q.project_id IS NULL OR q.project_id = c.project_id GROUP BY query_id, claim_id
"""
BIND["x_sub"] = """
SELECT query_id, claim_id, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, claim_id) AS pos FROM {searches} q JOIN {x_shown} c
 ON contains(lower(c.text), lower(trim(q.query))) AND (q.project_id IS NULL OR q.project_id = c.project_id)
WHERE length(trim(q.query)) >= 2
"""
BIND["x_fused"] = """
SELECT query_id, claim_id, sum(1.0::DOUBLE / (60 + pos)) AS base, string_agg(DISTINCT via, ',' ORDER BY via) AS via FROM (
  SELECT query_id, claim_id, pos, 'keyword' AS via FROM {x_kw} UNION ALL SELECT query_id, claim_id, pos, 'evidence' FROM {x_ev} UNION ALL SELECT query_id, claim_id, pos, 'substring' FROM {x_sub}) u GROUP BY query_id, claim_id
"""
BIND["x_hits"] = f"""
SELECT query_id, claim_id, via, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS pos FROM (
 SELECT f.*, floor(base * (0.6::DOUBLE + 0.4::DOUBLE * coalesce(confidence, 0.3::DOUBLE)) * (0.8::DOUBLE + 0.2::DOUBLE * exp(-(date_diff('microsecond', updated_at, TIMESTAMP '{NOW}') / 86400000000.0::DOUBLE) / 90)) * CASE rank WHEN 'preferred' THEN 1.05::DOUBLE ELSE 1 END * 1e9 + 0.5) / 1e9 AS score
 FROM {{x_fused}} f JOIN {{text_claims}} c USING (claim_id) JOIN {{searches}} q USING (query_id) WHERE (q.project_id IS NULL OR q.project_id = c.project_id) AND merged_into IS NULL AND review_state IN ('auto_accepted', 'approved') AND rank <> 'deprecated') s QUALIFY pos <= 20
"""


@query("keyword_rank", "SELECT query_id, claim_id, score, pos FROM {x_kw}")
def keyword_rank(t: Tables) -> DataFrame:
    return J.text_rank(J.claim_index(t.text_claims, with_grams=False), t.searches, J.eligible(t.text_claims)).select("query_id", "claim_id", "score", "pos")


@query("evidence_rank", "SELECT query_id, claim_id, score, pos FROM {x_ev}")
def evidence_rank(t: Tables) -> DataFrame:
    index = J.evidence_index(t.text_evidence, t.text_links)
    return J.text_rank(index, t.searches, J.eligible(t.text_claims)).select("query_id", "claim_id", "score", "pos")


@query("substring_rank", "SELECT query_id, claim_id, pos FROM {x_sub}")
def substring_rank(t: Tables) -> DataFrame:
    return J.substring_rank(J.claim_index(t.text_claims, with_terms=False), t.searches, J.eligible(t.text_claims)).select("query_id", "claim_id", "pos")


def hits(t: Tables) -> DataFrame:
    quotes = J.evidence_index(t.text_evidence, t.text_links)
    return J.search(t.text_claims, J.claim_index(t.text_claims), quotes, t.searches, NOW)


@query("fused_search", "SELECT query_id, claim_id, via AS matched_via, score, pos FROM {x_hits}")
def fused_search(t: Tables) -> DataFrame:
    return hits(t).select("query_id", "claim_id", F.array_join("matched_via", ",").alias("matched_via"), "score", "pos")


@query(
    "search_isolation",
    "SELECT q.query_id, count(*) AS n_hits, count(*) FILTER (WHERE c.project_id <> q.project_id) AS n_foreign FROM {searches} q JOIN {x_hits} h USING (query_id) JOIN {text_claims} c USING (claim_id) WHERE q.project_id IS NOT NULL GROUP BY q.query_id",
)
def search_isolation(t: Tables) -> DataFrame:
    """Hits of queries that name a project, and how many of them belong to another one."""
    bound = t.searches.filter("project_id is not null").select("query_id", F.col("project_id").alias("only"))
    found = hits(t).join(bound, "query_id").join(t.text_claims.select("claim_id", "project_id"), "claim_id")
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("only") != F.col("project_id")).alias("n_foreign"))


# the same search by keys: a key that sees one project is as good as naming it
BIND["scoped_searches"] = "SELECT query_id, query, coalesce(project_id, CASE WHEN query_id % 2 = 0 THEN 'de' END) AS project_id FROM {searches}"
for _name in ("x_qterms", "x_kw", "x_ev", "x_sub", "x_fused", "x_hits"):
    BIND["y" + _name[1:]] = BIND[_name].replace("{x_", "{y_").replace("{y_shown}", "{x_shown}").replace("{searches}", "{scoped_searches}")


@query("search_by_key", "SELECT query_id, claim_id, score, pos FROM {y_hits}")
def search_by_key(t: Tables) -> DataFrame:
    """Many callers at once, each seeing the projects of its key only."""
    keys = t.spark.createDataFrame([(0, ["de"]), (1, ["*"])], "key_id long, project_ids array<string>")
    asked = t.searches.withColumn("key_id", F.when(F.col("project_id").isNull() & (F.col("query_id") % 2 == 0), 0).otherwise(1).cast("long"))
    quotes = J.evidence_index(t.text_evidence, t.text_links)
    found = J.search(t.text_claims, J.claim_index(t.text_claims), quotes, J.keyed_queries(asked, keys), NOW)
    return found.select("query_id", "claim_id", "score", "pos")


CITED = """SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY authority_prior DESC, evidence_id) AS cite_pos, evidence_id, name AS source_name, substr(quote, 1, {n}) AS quote, source_type NOT IN ('store_review', 'community') AS quotable
FROM {{text_links}} l JOIN {{text_evidence}} USING (evidence_id) JOIN {{text_sources}} USING (source_id) WHERE stance = 'supports' QUALIFY cite_pos <= {k}"""
BIND["x_cited"] = CITED.format(n=160, k=2)


@query("search_citations", "SELECT query_id, h.claim_id, pos, floor(score * 10000 + 0.5) / 10000 AS score, cite_pos, evidence_id, source_name, quote, quotable FROM {x_hits} h LEFT JOIN {x_cited} c ON c.claim_id = h.claim_id")
def search_citations(t: Tables) -> DataFrame:
    return J.search_citations(hits(t), J.citations(t.text_links, t.text_evidence, t.text_sources, 2, 160))


@query("pack_citations", CITED.format(n=200, k=3))
def pack_citations(t: Tables) -> DataFrame:
    return J.citations(t.text_links, t.text_evidence, t.text_sources, 3, 200)


@query("chat_retrieve", "SELECT query_id, claim_id, pos AS cite_no, c.project_id, '[C' || pos || '] (' || claim_type || '/' || confidence_band || '/' || c.project_id || ') ' || text AS line FROM {x_hits} JOIN {text_claims} c USING (claim_id) WHERE pos <= 12")
def chat_retrieve(t: Tables) -> DataFrame:
    return J.chat_context(hits(t), t.text_claims)


BIND["answers"] = """
SELECT event_id, 'a [C' || CAST(user_id % 9 AS STRING) || '] b [C3] c [C' || CAST(user_id % 4 AS STRING) || '] [C3].' AS answer, user_id % 7 AS n_offered,
       user_id % 9 AS a, user_id % 4 AS b FROM {events}
"""
MARK = "CASE WHEN list_position(ok, {0}) > 0 THEN '[C' || list_position(ok, {0}) || ']' ELSE '[C' || {0} || ']' END"


@query(
    "answer_citations",
    "SELECT event_id, 'a ' || " + MARK.format("a") + " || ' b ' || " + MARK.format("3") + " || ' c ' || " + MARK.format("b") + " || ' ' || " + MARK.format("3") + """ || '.' AS answer,
 array_to_string(ok, ',') AS cited, len(ok) = 0 AS insufficient
 FROM (SELECT *, list_filter([a, CASE WHEN a <> 3 THEN 3 END, CASE WHEN b NOT IN (a, 3) THEN b END], lambda n: n BETWEEN 1 AND n_offered) AS ok FROM {answers}) v""",
)
def answer_citations(t: Tables) -> DataFrame:
    out = J.answer_citations(t.answers)
    return out.select("event_id", "answer", F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("cited"), "insufficient")


# ---- packs

BIND["pack_asks"] = """
SELECT CAST(row_number() OVER (ORDER BY p_brand) AS BIGINT) AS request_id, p_brand AS project_id, 800 AS budget, CASE WHEN substr(p_brand, 8) = '1' THEN 'verified' ELSE 'likely' END AS min_band,
       'economy' AS focus_topic, substr(p_brand, 7, 1) = '2' AS has_task FROM (SELECT DISTINCT p_brand FROM {part}) b
"""
BIND["x_relevance"] = """
SELECT request_id, claim_id, row_number() OVER (PARTITION BY request_id ORDER BY claim_id DESC) AS pos, 100 AS n_hits FROM {pack_asks} a JOIN {stored_claims} c ON c.project_id = a.project_id WHERE c.claim_id % 2 = 0
"""
BIND["x_ranked"] = """
SELECT a.request_id, a.budget, c.claim_id, c.claim_type, c.claim_id % 90 + 10 AS cost,
  CASE c.claim_type WHEN 'official_fact' THEN 'facts' WHEN 'player_opinion' THEN 'opinions' ELSE 'insights' END AS section,
  floor(CASE confidence_band WHEN 'verified' THEN 1 ELSE 0.7::DOUBLE END * CASE WHEN has_task THEN 0.3::DOUBLE + 0.7::DOUBLE * coalesce(1 - (r.pos - 1)::DOUBLE / r.n_hits, 0) ELSE 1 END
    * (0.7::DOUBLE + 0.3::DOUBLE * exp(-(date_diff('microsecond', updated_at, TIMESTAMP '2001-12-31 00:00:00') / 86400000000.0::DOUBLE) / 180))
    * CASE WHEN topic = 'economy' THEN 1.3::DOUBLE ELSE 0.8::DOUBLE END * 1e9 + 0.5) / 1e9 AS rank_score
FROM {pack_asks} a JOIN {stored_claims} c ON c.project_id = a.project_id LEFT JOIN {x_relevance} r ON r.request_id = a.request_id AND r.claim_id = c.claim_id
WHERE merged_into IS NULL AND rank <> 'deprecated' AND review_state IN ('auto_accepted', 'approved') AND confidence_band IN ('verified', 'likely') AND (min_band <> 'verified' OR confidence_band = 'verified')
"""


def ranked(t: Tables) -> DataFrame:
    asks = t.pack_asks.withColumn("focus", F.array("focus_topic"))
    out = K.pack_rank(asks, t.stored_claims, "2001-12-31 00:00:00", t.x_relevance)
    # the price of an item is an argument; here it spreads widely so that skipping matters
    return out.withColumn("cost", F.col("claim_id") % 90 + 10).withColumn("ad_role", F.when(F.col("claim_id") % 4 == 0, "landmine"))


@query("pack_rank", "SELECT request_id, claim_id, section, rank_score FROM {x_ranked}")
def pack_rank(t: Tables) -> DataFrame:
    return ranked(t).select("request_id", "claim_id", "section", "rank_score")


@query(
    "pack_costs",
    f"SELECT claim_id, {Q.estimate('text')} + coalesce(q, 0) AS cost FROM {{text_claims}} LEFT JOIN (SELECT claim_id, CAST(sum({Q.estimate('quote')}) AS BIGINT) AS q FROM {{x_cited}} GROUP BY 1) c USING (claim_id)",
)
def pack_costs(t: Tables) -> DataFrame:
    cited = J.citations(t.text_links, t.text_evidence, t.text_sources, 2, 160)
    return K.item_cost(t.text_claims.select("claim_id", "text"), cited).select("claim_id", "cost")


FILL = """WITH RECURSIVE one AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank_score DESC, claim_id) AS rn FROM {x_ranked}),
 p1(request_id, rn, claim_id, used, f, o, i, took) AS (SELECT DISTINCT request_id, 0::BIGINT, NULL::BIGINT, 4::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM one
  UNION ALL SELECT request_id, rn, claim_id, used + CASE WHEN t THEN cost ELSE 0 END, f + CASE WHEN t AND section = 'facts' THEN cost ELSE 0 END, o + CASE WHEN t AND section = 'opinions' THEN cost ELSE 0 END, i + CASE WHEN t AND section = 'insights' THEN cost ELSE 0 END, t
  FROM (SELECT p1.request_id, one.rn, one.claim_id, one.cost, one.section, used, f, o, i, used + cost <= budget AND CASE section WHEN 'facts' THEN f + cost <= budget * 0.5 WHEN 'opinions' THEN o + cost <= budget * 0.35 ELSE i + cost <= budget * 0.15 END AS t FROM p1 JOIN one ON one.request_id = p1.request_id AND one.rn = p1.rn + 1) s),
 mid AS MATERIALIZED (SELECT request_id, max(used) AS used, count(*) FILTER (WHERE took) AS n FROM p1 GROUP BY request_id),
 two AS MATERIALIZED (SELECT one.*, row_number() OVER (PARTITION BY one.request_id ORDER BY one.rn) AS sn FROM one JOIN p1 ON p1.request_id = one.request_id AND p1.rn = one.rn WHERE NOT took),
 p2(request_id, sn, claim_id, used, took) AS (SELECT request_id, 0::BIGINT, NULL::BIGINT, used, false FROM mid
  UNION ALL SELECT p2.request_id, two.sn, two.claim_id, used + CASE WHEN used + cost <= budget THEN cost ELSE 0 END, used + cost <= budget FROM p2 JOIN two ON two.request_id = p2.request_id AND two.sn = p2.sn + 1),
 filled AS (SELECT request_id, claim_id, row_number() OVER (PARTITION BY request_id ORDER BY rn) AS pack_pos FROM p1 WHERE took
  UNION ALL SELECT p2.request_id, claim_id, n + row_number() OVER (PARTITION BY p2.request_id ORDER BY sn) FROM p2 JOIN mid ON mid.request_id = p2.request_id WHERE took) """


@query("pack_fill", FILL + "SELECT request_id, claim_id, pack_pos, (SELECT max(used) FROM p2 WHERE p2.request_id = filled.request_id) AS tokens_used FROM filled")
def pack_fill(t: Tables) -> DataFrame:
    return K.pack_fill(ranked(t))


@query("pack_sections", FILL + "SELECT request_id, claim_id, pack_pos, section FROM filled JOIN {x_ranked} x USING (request_id, claim_id) WHERE section <> 'opinions' OR claim_id % 4 <> 0")
def pack_sections(t: Tables) -> DataFrame:
    r = ranked(t)
    return K.pack_sections(K.pack_fill(r), r).select("request_id", "claim_id", "pack_pos", "section")


@query("pack_trimmed", FILL + "SELECT request_id, count(*) - (SELECT count(*) FROM filled f WHERE f.request_id = x.request_id) AS trimmed FROM {x_ranked} x GROUP BY request_id")
def pack_trimmed(t: Tables) -> DataFrame:
    r = ranked(t)
    return K.pack_trimmed(r, K.pack_fill(r))


@query("pack_excluded", "SELECT project_id, confidence_band, count(*) AS n FROM {stored_claims} WHERE merged_into IS NULL AND (confidence_band IN ('uncertain', 'disputed', 'insufficient') OR review_state NOT IN ('auto_accepted', 'approved')) GROUP BY ALL")
def pack_excluded(t: Tables) -> DataFrame:
    return K.pack_excluded(t.stored_claims)
