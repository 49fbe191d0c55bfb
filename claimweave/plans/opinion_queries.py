"""Facts, opinions, roles, angles and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.operators import conflicts as C, extract as E, grounding as G, merge as M, roles as R, scoring as S
from claimweave.plans import sqltext as Q
from claimweave.plans.registry import BIND, Tables, query
from claimweave.plans.score_queries import R3, WILSON
from claimweave.plans.source_queries import app_documents, creatives


def store_facts(t: Tables, predicates: list[str] | None = None) -> DataFrame:
    docs = app_documents(t).join(t.part.select("p_partkey", F.col("p_name").alias("name")), "p_partkey")
    return E.qualify_store(E.metadata_facts(docs, ["p_partkey", "country"], predicates=predicates))


BIND["x_facts"] = """
SELECT p_partkey, unnest(['developer', 'genre', 'current_version', 'price', 'appstore_rating', 'release_date']) AS predicate,
 unnest(['《' || p_name || '》的开发商/发行商是 ' || p_brand, '《' || p_name || '》的品类为 ' || p_type, '《' || p_name || '》当前版本为 1.' || p_size || '（CN 区）',
   '《' || p_name || '》的价格为 ' || p_size || ' USD（CN 区）', '《' || p_name || '》App Store(CN) 平均评分为 ' || printf('%.2f', p_size / 10.0) || ' (' || p_partkey || ' 个评分)',
   CASE WHEN p_size % 2 = 0 THEN '《' || p_name || '》的发行/上架日期为 2020-01-01' END]) AS claim_text,
 unnest([p_brand, p_type, '1.' || p_size, p_size::VARCHAR, printf('%.2f', p_size / 10.0), '2020-01-01']) AS value,
 unnest([NULL, NULL, NULL, p_size::DOUBLE, printf('%.2f', p_size / 10.0)::DOUBLE, NULL]) AS number
FROM {part}
"""


@query("metadata_facts", "SELECT p_partkey, predicate, claim_text, value, number FROM {x_facts} WHERE claim_text IS NOT NULL")
def metadata_facts(t: Tables) -> DataFrame:
    return store_facts(t).select("p_partkey", "predicate", "claim_text", "value", "number")


@query("fact_entities", "SELECT p_partkey, 'company' AS entity_type, p_brand AS canonical_name FROM {part} UNION ALL SELECT p_partkey, 'term', p_type FROM {part}")
def fact_entities(t: Tables) -> DataFrame:
    return E.fact_entities(store_facts(t, [*E.COMPANY_PREDICATES, E.TERM_PREDICATE]), ["p_partkey"])


@query("hub_entities", "SELECT doc_id, 'term' AS entity_type, CASE source WHEN 'src1' THEN '付费口碑' WHEN 'src2' THEN '内容表现口碑' ELSE '玩法口碑' END AS canonical_name FROM {documents} WHERE source IN ('src1', 'src2', 'src3')")
def hub_entities(t: Tables) -> DataFrame:
    topic = F.when(F.col("source") == "src1", "monetization").when(F.col("source") == "src2", "creative").when(F.col("source") == "src3", "gameplay")
    return E.hub_entities(t.documents.select("doc_id", topic.alias("topic")), ["doc_id"])


# a lexicon in the languages of the driver's texts; the operator is the same
LEXICON = [
    ("value", "monetization", r"tion[ .]", r" (th|der|le) [a-z]{2,3} ", "liked for value", "disliked for value"),
    ("pace", "gameplay", None, r"(?i) ing| und | est ", "", "too slow"),
    ("look", "creative", r"(ment|eau|schön)", None, "looks fine", ""),
]
MENTION = {("value", "positive"): LEXICON[0][2], ("value", "negative"): LEXICON[0][3], ("pace", "negative"): LEXICON[1][3], ("look", "positive"): LEXICON[2][2]}
HITS = " UNION ALL ".join(
    f"SELECT lang, source, doc_id, '{a}' AS aspect, '{s}' AS sentiment FROM {{documents}} WHERE regexp_matches(text, {Q.lit(p)})" for (a, s), p in MENTION.items()
)


SAID = "CASE aspect || '/' || sentiment " + " ".join(f"WHEN '{a}/{s}' THEN '{w}'" for a, _, _, _, p, c in LEXICON for s, w in (("positive", p), ("negative", c))) + " END"


@query("aspect_mentions", f"SELECT doc_id, aspect, sentiment FROM ({HITS}) h")
def aspect_mentions(t: Tables) -> DataFrame:
    return E.aspect_mentions(t.documents, ["doc_id"], LEXICON).select("doc_id", "aspect", "sentiment")


@query(
    "aspect_opinions",
    f"SELECT lang, aspect, sentiment, {SAID} || '（《' || lang || '》）' AS claim_text, h AS n_holding, n AS n_discussing, {R3.format('CAST(h AS DOUBLE) / n')} AS prevalence, {R3.format(WILSON.format(h='CAST(h AS DOUBLE)', n='CAST(n AS DOUBLE)'))} AS ci_low FROM (SELECT lang, aspect, sentiment, count(*) AS h FROM ({HITS}) x GROUP BY ALL HAVING count(*) >= 3) m JOIN (SELECT lang, count(*) AS n FROM {{documents}} GROUP BY lang) t USING (lang)",
)
def aspect_opinions(t: Tables) -> DataFrame:
    out = E.aspect_opinions(t.documents, ["lang"], LEXICON, project="lang")
    return out.select("lang", "aspect", "sentiment", "claim_text", "n_holding", "n_discussing", "prevalence", "ci_low")


@query(
    "opinion_evidence",
    f"SELECT lang, aspect, sentiment, doc_id FROM ({HITS}) x",
)
def opinion_evidence(t: Tables) -> DataFrame:
    m = E.aspect_mentions(t.documents, ["lang", "doc_id"], LEXICON)
    return E.opinion_evidence(m, ["lang", "aspect", "sentiment"], ["doc_id"]).select("lang", "aspect", "sentiment", "doc_id")


@query(
    "quoted_opinions",
    f"SELECT lang, aspect, sentiment FROM (SELECT lang, aspect, sentiment, count(*) AS n, count(*) AS q FROM ({HITS}) x GROUP BY ALL) y WHERE n >= 3 AND q >= 2",
)
def quoted_opinions(t: Tables) -> DataFrame:
    """Opinions of which at least two quotes are found again in their reviews."""
    keys = ["lang", "aspect", "sentiment"]
    reviews = t.documents.withColumnRenamed("doc_id", "snapshot_id")
    quotes = E.aspect_mentions(reviews, ["lang", "snapshot_id"], LEXICON)
    grounded = G.ground_links(quotes, reviews).filter("ok")
    return E.quoted_opinions(E.aspect_opinions(t.documents, ["lang"], LEXICON), grounded, keys).select(*keys)


PAIN = [("monetization", LEXICON[0][3], "expensive"), ("grind", LEXICON[1][3], "slow")]


PAIN_SQL = (" UNION ALL ".join(
        f"SELECT lang, source, '{topic}' AS topic, '竞品《' || source || '》玩家反馈该竞品{words}' AS claim_text, count(*) FILTER (WHERE regexp_matches(text, {Q.lit(p)})) AS n_holding, count(*) AS n_discussing FROM {{documents}} GROUP BY lang, source HAVING count(*) FILTER (WHERE regexp_matches(text, {Q.lit(p)})) >= 2"
        for (_, p, words), topic in zip(PAIN, ["monetization", "gameplay"])
    )
)


@query("competitor_pain", PAIN_SQL)
def competitor_pain(t: Tables) -> DataFrame:
    out = E.competitor_pain(t.documents, ["lang"], "source", PAIN)
    return out.select("lang", "source", "topic", "claim_text", "n_holding", "n_discussing")


@query(
    "competitor_refresh",
    "SELECT lang, source, claim_text, n_holding, n_discussing, CAST(updated AS BIGINT) AS updated FROM (SELECT *, 1 AS updated FROM (" + PAIN_SQL + ") a UNION ALL SELECT lang, source, 'topic', '竞品《' || source || '》旧结论', 1, 2, 0 FROM (SELECT DISTINCT lang, source FROM {documents}) d) x",
)
def competitor_refresh(t: Tables) -> DataFrame:
    """Claims of an earlier look at half of the reviews get the statistics of all; claims not found again stay as they were."""
    half = E.competitor_pain(t.documents.filter("n_chars % 2 = 0"), ["lang"], "source", PAIN)
    long_ago = F.lit("2020-01-01").cast("timestamp")
    columns = ["lang", "source", "claim_text", "n_holding", "n_discussing", "updated_at"]
    stale = t.documents.select("lang", "source").distinct().withColumns({"claim_text": F.concat(F.lit("竞品《"), F.col("source"), F.lit("》旧结论")), "n_holding": F.lit(1).cast("long"), "n_discussing": F.lit(2).cast("long")})
    existing = half.withColumn("updated_at", long_ago).select(columns).unionByName(stale.withColumn("updated_at", long_ago).select(columns))
    found = E.competitor_pain(t.documents, ["lang"], "source", PAIN)
    now, _ = E.refresh_opinions(existing, found, ["lang", "source"], ["n_holding", "n_discussing"], "2024-01-01")
    return now.withColumn("updated", (F.col("updated_at") > long_ago).cast("long")).drop("updated_at")


@query(
    "creative_insight",
    "SELECT lang AS project_id, doc_id::VARCHAR AS creative_key, '《' || lang || '》可复用的买量创意角度：「' || source || '」钩子' || CASE WHEN doc_id % 2 = 0 THEN ' + 「' || lang || '」情绪曲线' ELSE '' END || '（源自高表现抖音素材，供创意 Agent 参考）' AS claim_text FROM {documents} WHERE doc_id % 10 <> 0 AND contains(lower('钩子类型：' || source || text), 'src1') AND len(list_filter(regexp_split_to_array(text, '[。！？!?\\n]'), lambda x: length(trim(regexp_replace(x, '[#>*`]', '', 'g'))) BETWEEN 12 AND 140 AND NOT contains(x, '==='))) > 0",
)
def creative_insight(t: Tables) -> DataFrame:
    made = creatives(t).withColumn("name", F.col("project_id"))
    return E.creative_insight(made, ["project_id", "creative_key"]).select("project_id", "creative_key", "claim_text")


BIND["dated_reviews"] = "SELECT d.lang, d.source, d.doc_id, d.text, e.ts FROM {documents} d JOIN {events} e ON e.event_id = d.doc_id"


@query(
    "review_sample",
    """SELECT lang, source, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY part, p, doc_id) AS pos, least(20, count(*) OVER (PARTITION BY lang, source)) AS n FROM (
 SELECT lang, source, doc_id, arg_min(part, part) AS part, arg_min(p, part) AS p FROM (
 SELECT lang, source, doc_id, 0 AS part, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS p FROM {dated_reviews} QUALIFY p <= 10
 UNION ALL SELECT lang, source, doc_id, 1, row_number() OVER (PARTITION BY lang, source ORDER BY ts DESC, doc_id) AS p FROM {dated_reviews} QUALIFY p <= 20) a GROUP BY lang, source, doc_id) b) c WHERE pos <= 20 AND n >= 8""",
)
def review_sample(t: Tables) -> DataFrame:
    return E.review_sample(t.dated_reviews, ["lang", "source"], "doc_id", "ts", size=20)


# ---- roles and angles: phrases chosen per document stand in front of the document's own text

PHRASES = [
    "竞品《甲》太肝", "竞品《甲》还行", "玩家反馈优化差，卡顿", "其他游戏太贵", "src1 不如隔壁", "玩家认为氪金压力大", "剧情拖沓 画面糊",
    "玩家称赞美术", "《甲》的品类为 角色扮演、动作", "《甲》的开发商/发行商是 乙", "发行/上架日期为 2020", "免费游玩", "音乐好听", "内容太少 玩法单一",
]
PICK = "CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"
BIND["role_claims"] = f"""
SELECT doc_id AS claim_id, lang || source AS project_id, source AS project_name,
  CASE WHEN doc_id % 14 IN (8, 9, 10, 11) THEN 'official_fact' ELSE 'player_opinion' END AS claim_type,
  CASE WHEN doc_id % 5 = 0 THEN 'monetization' WHEN doc_id % 5 = 1 THEN 'creative' ELSE 'other' END AS topic,
  {PICK} || ' ' || text AS text, CASE WHEN doc_id % 14 IN (7, 12) THEN 'positive' ELSE 'negative' END AS sentiment,
  CASE doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'likely' ELSE 'uncertain' END AS confidence_band,
  CASE WHEN doc_id % 4 = 3 THEN 'pending' ELSE 'auto_accepted' END AS review_state, CAST(NULL AS BIGINT) AS merged_into, doc_id % 14 = 10 AS has_value,
  CAST(doc_id % 97 AS DOUBLE) / 100 AS confidence
FROM {{documents}}
"""
RIVAL = f"regexp_matches(text, {Q.lit(R.RIVAL_DEFECT)})"
BIND["x_roles"] = f"""
SELECT *, CASE WHEN sentiment = 'negative' THEN CASE WHEN regexp_matches(text, '^竞品《.+》') THEN CASE WHEN {RIVAL} THEN 'ammo' END
   WHEN regexp_matches(text, '《?' || project_name || '》?\\s*{R.SELF_DEFECT}') THEN 'landmine' WHEN {RIVAL} THEN 'ammo' ELSE 'landmine' END END AS ad_role FROM {{role_claims}}
"""


def role_claims(t: Tables) -> DataFrame:
    c = t.role_claims
    return c.withColumn("ad_role", R.ad_role(F.col("text"), F.col("project_name"), F.col("sentiment")))


@query("ad_role", "SELECT claim_id, ad_role FROM {x_roles}")
def ad_role(t: Tables) -> DataFrame:
    return role_claims(t).select("claim_id", "ad_role")


AVOIDS = " || ".join(f"CASE WHEN regexp_matches(text, {Q.lit(p)}) THEN '|{w}' ELSE '' END" for p, w in R.AVOID)


@query("avoid_list", f"SELECT claim_id, {AVOIDS} AS avoid FROM {{role_claims}}")
def avoid_list(t: Tables) -> DataFrame:
    words = F.array_join(F.transform(R.avoid_list(F.col("text")), lambda w: F.concat(F.lit("|"), w)), "")
    return t.role_claims.select("claim_id", words.alias("avoid"))


DIM = (
    "CASE " + " ".join(f"WHEN topic = '{k}' THEN '{v}'" for k, v in R.TOPIC_DIMENSION.items()) + " "
    + " ".join(f"WHEN regexp_matches(text, {Q.lit(p)}) THEN '{d}'" for d, p in R.TEXT_DIMENSION) + " ELSE 'brand' END"
)
BLOCK = " UNION ".join(f"SELECT project_id, '{d}' AS dimension FROM {{x_roles}} WHERE ad_role = 'landmine' AND regexp_matches(text, {Q.lit(p)})" for d, p in R.BLOCKED_BY)


@query("dimension", f"SELECT claim_id, {DIM} AS dimension FROM {{role_claims}}")
def dimension(t: Tables) -> DataFrame:
    return t.role_claims.select("claim_id", R.dimension_of(F.col("topic"), F.col("text")).alias("dimension"))


@query("blocked", BLOCK)
def blocked(t: Tables) -> DataFrame:
    return R.blocked_dimensions(role_claims(t))


BIND["x_cand"] = f"""
WITH d AS (SELECT *, {DIM} AS dim, confidence_band IN ('verified', 'likely') AS strong FROM {{x_roles}}), s AS (SELECT *, strong AND review_state = 'auto_accepted' AS trusted FROM d)
SELECT project_id, claim_id, text, dim AS dimension, CASE WHEN regexp_matches(text, '竞品|其他游戏|隔壁|友商') THEN 'competitor_position' ELSE 'pain_reverse' END AS tactic, CASE WHEN strong THEN 'high' ELSE 'medium' END AS strength FROM s WHERE ad_role = 'ammo'
UNION ALL SELECT project_id, claim_id, text, CASE k WHEN 1 THEN 'timeliness' WHEN 3 THEN 'brand' WHEN 4 THEN 'monetization' ELSE dim END, CASE k WHEN 1 THEN 'timely_hook' ELSE 'fact_amplify' END, CASE k WHEN 1 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END
FROM (SELECT *, CASE WHEN regexp_matches(text, '发行|上架日期|上线') AND has_value THEN 1 WHEN regexp_matches(text, '品类|类型') THEN 2 WHEN regexp_matches(text, '开发商|发行商') THEN 3 WHEN regexp_matches(text, '免费') THEN 4 END AS k FROM s WHERE trusted AND claim_type = 'official_fact') f WHERE k IS NOT NULL
UNION ALL SELECT project_id, claim_id, text, dim, 'opinion_endorse', CASE WHEN confidence_band = 'verified' THEN 'high' ELSE 'medium' END FROM s WHERE trusted AND claim_type = 'player_opinion' AND sentiment = 'positive'
"""
BIND["x_angles"] = f"""
SELECT project_id, dimension, tactic, claim_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dimension, tactic ORDER BY CASE strength WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, claim_id) AS rn
FROM {{x_cand}} c WHERE NOT EXISTS (SELECT 1 FROM ({BLOCK}) b WHERE b.project_id = c.project_id AND b.dimension = c.dimension)) r WHERE rn = 1
"""


@query("angles", "SELECT * FROM {x_angles}")
def angles(t: Tables) -> DataFrame:
    return R.selling_angles(role_claims(t)).select("project_id", "dimension", "tactic", "claim_id", "strength")


HOOK = "CASE dimension " + " ".join(f"WHEN '{d}' THEN '{'|'.join(w)}'" for d, w in R.HOOKS.items()) + " END"


@query("angle_hooks", f"SELECT project_id, dimension, tactic, {HOOK} AS hooks FROM {{x_angles}} WHERE tactic IN ('competitor_position', 'pain_reverse')")
def angle_hooks(t: Tables) -> DataFrame:
    out = R.selling_angles(role_claims(t)).filter(F.col("tactic").isin("competitor_position", "pain_reverse"))
    return out.select("project_id", "dimension", "tactic", F.array_join("hooks", "|").alias("hooks"))


@query("rebuild_angles", "SELECT project_id, count(*) AS n FROM {x_angles} GROUP BY project_id")
def rebuild_angles(t: Tables) -> DataFrame:
    from claimweave.checkpoints import new_folder

    path = new_folder(t.spark, "angles")
    made = R.selling_angles(role_claims(t))
    R.rebuild_angles(made, path)
    # a second run replaces the same projects instead of adding rows
    R.rebuild_angles(made, path)
    return t.spark.read.parquet(path).groupBy(F.col("project_id").cast("string").alias("project_id")).agg(F.count(F.lit(1)).alias("n"))


@query("pack_landmines", f"SELECT project_id, claim_id, pos, confidence, {AVOIDS} AS avoid FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, claim_id) AS pos FROM {{x_roles}} WHERE ad_role = 'landmine' AND claim_type = 'player_opinion') x WHERE pos <= 10")
def pack_landmines(t: Tables) -> DataFrame:
    from claimweave.operators.pack import pack_landmines as mines

    words = F.array_join(F.transform("avoid_promising", lambda w: F.concat(F.lit("|"), w)), "")
    return mines(role_claims(t)).select("project_id", "claim_id", "pos", "confidence", words.alias("avoid"))


@query("pack_angles", "SELECT project_id, dimension, tactic, strength FROM {x_angles}")
def pack_angles(t: Tables) -> DataFrame:
    from claimweave.operators.pack import angles_by_strength

    return angles_by_strength(R.selling_angles(role_claims(t))).select("project_id", "dimension", "tactic", "strength")


# ---- conflicts

BIND["price_facts"] = """
SELECT evidence_id AS claim_id, 'p' AS project_id, l_partkey AS predicate, CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS STRING) AS value,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS STRING) END AS version_min,
  'official_fact' AS claim_type, CAST(NULL AS BIGINT) AS merged_into, CASE WHEN l_linenumber = 7 THEN 'deprecated' ELSE 'normal' END AS rank,
  CASE WHEN l_linenumber = 6 THEN 'price 9（CN 区）' ELSE 'price' END AS text
FROM {stances}
"""
BIND["x_price"] = "SELECT * FROM {price_facts} WHERE rank <> 'deprecated' AND text = 'price'"
BIND["x_pairs"] = """
SELECT a.claim_id AS x, b.claim_id AS y FROM {x_price} a JOIN {x_price} b ON a.predicate = b.predicate AND a.value <> b.value
WHERE a.version_min IS NULL OR b.version_min IS NULL OR a.version_min = b.version_min
"""


@query("value_conflicts", "SELECT x AS claim_id, count(*) AS n_opponents, min(y) AS opponent FROM {x_pairs} GROUP BY x")
def value_conflicts(t: Tables) -> DataFrame:
    out = C.value_conflicts(C.comparable_facts(t.price_facts))
    return out.select("claim_id", "n_opponents", "opponent")


@query(
    "conflict_open",
    "SELECT DISTINCT least(x, y) AS claim_a, greatest(x, y) AS claim_b, 'open' AS status FROM (SELECT x, min(y) AS y FROM {x_pairs} GROUP BY x) z WHERE NOT EXISTS (SELECT 1 FROM {conflicts} k WHERE k.claim_a = least(x, y) AND k.claim_b = greatest(x, y))",
)
def conflict_open(t: Tables) -> DataFrame:
    found = C.value_conflicts(C.comparable_facts(t.price_facts))
    return C.conflict_rows(found, t.conflicts).select("claim_a", "claim_b", "status")


@query("open_conflict_claims", "SELECT DISTINCT claim_id FROM (SELECT claim_a AS claim_id FROM {conflicts} WHERE status = 'open' UNION ALL SELECT claim_b FROM {conflicts} WHERE status = 'open') x")
def open_conflict_claims(t: Tables) -> DataFrame:
    return S.open_conflict_claims(t.conflicts)


BIND["x_chain_up"] = """
SELECT f.claim_id, n.first AS superseded_by FROM {x_price} f JOIN (
  SELECT predicate, version_min, lo, hi, lead(first) OVER w AS first, lead(lo) OVER w AS nlo, lead(hi) OVER w AS nhi FROM (
    SELECT predicate, version_min, min(claim_id) AS first, min(value) AS lo, max(value) AS hi FROM {x_price} WHERE version_min IS NOT NULL GROUP BY ALL) v
  WINDOW w AS (PARTITION BY predicate ORDER BY version_min)) n ON n.predicate = f.predicate AND n.version_min = f.version_min
WHERE n.first IS NOT NULL AND NOT (lo = hi AND nlo = nhi AND lo = nlo)
"""


@query("version_chain", "SELECT * FROM {x_chain_up}")
def version_chain(t: Tables) -> DataFrame:
    return C.version_chain(C.comparable_facts(t.price_facts))


@query(
    "supersede_chain",
    "SELECT f.claim_id, u.superseded_by, CASE WHEN u.claim_id IS NOT NULL THEN 'deprecated' WHEN f.claim_id IN (SELECT superseded_by FROM {x_chain_up}) THEN 'preferred' ELSE f.rank END AS rank FROM {price_facts} f LEFT JOIN {x_chain_up} u ON u.claim_id = f.claim_id",
)
def supersede_chain(t: Tables) -> DataFrame:
    chain = C.version_chain(C.comparable_facts(t.price_facts))
    return M.supersede(t.price_facts, chain, "2002-01-01").select("claim_id", "superseded_by", "rank")
