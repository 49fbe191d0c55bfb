"""Registered queries of the operators, each over its whole table, with SQL checks where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.checkpoints import new_folder
from claimweave.llm import chosen_path, conversations, exact_search, fill_middle, jaccard_join, languages, mixing, packing, permutation_index, secrets, token_store, toxicity, url_filters

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _secret_spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the parts between matches and the matches before give each start."""
    p = "'" + pattern.replace("'", "''") + "'"
    measured = f"regexp_extract_all(t, {p}, {group})"
    begin = "list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    spans = f"list_transform(range(1, len(hits) + 1), lambda i: {{'s': ({begin})::bigint, 'n': length(hits[i])::bigint, 'm': length(sized[i])}})"
    return f"""select doc_id, '{kind}' as kind, {place} as place, s.s as s, s.s + s.n as e from (
        select doc_id, unnest({spans}) as s from (select doc_id, string_split_regex(t, {p}) as parts, regexp_extract_all(t, {p}, 0) as hits, {measured} as sized from texts) where len(hits) > 0) where s.m >= {least}"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: (kind, whole pattern, group that is measured, its least length), as the rules have them.
_SECRET_SQL = [
    ("assign", f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("github", "gh[opsru]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abeprs]-[A-Za-z0-9-]+", 0, 15),
    ("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", 0, 24),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 33),
    ("key_block", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 0),
]
CHECKS["op3_secrets"] = f"""
with texts as (select row_number() over () as doc_row, doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(_secret_spans(k, i, p, g, n) for i, (k, p, g, n) in enumerate(_SECRET_SQL))}),
told as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, place) as spans,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, place) filter (where place < 3), '') as base,
    count(*) filter (where place = 0) as n_assign, count(*) filter (where place = 1) as n_access, count(*) filter (where place = 2) as n_hex
    from spans group by doc_id)
select texts.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join told using (doc_id)"""


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, byte_bpe())
    return token_store.read_documents(spark, path)


@query
def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("bound")


CHECKS["op9_url_filters"] = url_filters.sql()


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


CHECKS["op5_mixing"] = mixing.sql()


@query
def op6_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_search.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


CHECKS["op6_exact_search"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
    from v as q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5"""


@query
def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, path = table(spark, sf_dir, "embeddings"), new_folder(spark, "permutation-index")
    permutation_index.build(vectors, path)
    return permutation_index.search(spark, path, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


CHECKS["op11_fill_in_middle"] = """
with drawn as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
numbers as (select doc_id, t, length(t)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from drawn),
cuts as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form from numbers),
parts as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from cuts)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'plain' then t when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from parts"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(table(spark, sf_dir, "conversations"))


@query
def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.dedup(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it uses this module

    return corpus_pipeline.run(spark, sf_dir)
