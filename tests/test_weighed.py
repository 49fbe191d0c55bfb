"""Which links are grouped for a score."""

from claimweave.operators import scoring as S


def test_mentions_are_not_grouped(spark, monkeypatch):
    asked, grouped = [], S.independent_groups
    monkeypatch.setattr(S, "independent_groups", lambda links: (asked.append(links), grouped(links))[1])
    claims = spark.sql("SELECT 1L AS claim_id, 'official_fact' AS claim_type, 'pending' AS review_state, NULL::bigint AS merged_into, named_struct('value', 'x') AS value, NULL::array<bigint> AS derived_from, 0.5D AS confidence, named_struct('n_holding', 0L, 'n_discussing', 0L) AS opinion")
    links = spark.sql("""SELECT 1L AS claim_id, stance, 'direct' AS directness, 0.9D AS extractor_confidence, 'x' AS quote, timestamp'2001-01-01' AS published_at, false AS suspected_promo,
        'press' AS source_type, 'p:o' AS owner_key, 3L AS source_id, 0.7D AS authority_prior, NULL::string AS dup_cluster, true AS has_value, 'official_fact' AS claim_type FROM VALUES ('supports'), ('mentions'), ('mentions') AS v(stance)""")
    got = S.score_claims(claims, links, "2001-12-31 00:00:00").first()
    assert (got["n_support"], got["n_refute"], got["n_platforms"]) == (1, 0, 0)
    assert asked[0].count() == 1
