"""Whole-store honesty checks; each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.operators.scoring import TRUSTED_STATES, independent_groups

# The vocabularies the store admits.
VOCABULARY = {
    "claim_type": ["official_fact", "player_opinion", "system_inference", "creative_insight"],
    "review_state": ["pending", "auto_accepted", "approved", "rejected", "quarantined", "merged", "expired"],
    "confidence_band": ["verified", "likely", "uncertain", "disputed", "insufficient"],
    "stance": ["supports", "refutes", "mentions"],
    "directness": ["direct", "indirect", "interpretive"],
    "source_type": [
        "official", "store_metadata", "store_review", "wiki", "press", "community", "video", "internal_doc", "user_note", "other",
    ],
    "rank": ["preferred", "normal", "deprecated"],
    "conflict_type": ["numeric", "version_temporal", "semantic", "opinion_split"],
    "status": ["open", "resolved_a", "resolved_b", "both_valid_scoped", "dismissed"],
    "item_type": ["claim", "conflict", "source"],
    "state": ["todo", "in_review", "done", "skipped"],
}


def broken_quotes(grounded_links: DataFrame) -> DataFrame:
    return grounded_links.filter(~F.col("ok"))


def trusted_without_support(claims: DataFrame, claim_evidence: DataFrame) -> DataFrame:
    trusted = claims.filter(F.col("review_state").isin(TRUSTED_STATES) & F.col("merged_into").isNull())
    supported = claim_evidence.filter(F.col("stance") == "supports").select("claim_id").distinct()
    return trusted.join(supported, "claim_id", "left_anti")


def insufficient_with_score(claims: DataFrame) -> DataFrame:
    return claims.filter((F.col("confidence_band") == "insufficient") & F.col("confidence").isNotNull())


def verified_single_source(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Verified facts that rest on fewer than two independent supporting groups."""
    facts = claims.filter(
        (F.col("confidence_band") == "verified") & F.col("merged_into").isNull() & (F.col("claim_type") != "player_opinion")
    )
    support = independent_groups(links.filter(F.col("stance") == "supports")).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("groups")
    )
    return facts.join(support, "claim_id", "left").filter(F.coalesce("groups", F.lit(0)) < 2)


def untrusted_accepted(claims: DataFrame) -> DataFrame:
    return claims.filter(
        (F.col("review_state") == "auto_accepted") & F.col("confidence_band").isin("uncertain", "disputed", "insufficient")
    )


def loose_conflicts(conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """Open conflicts with a side that is still presented as trustworthy."""
    safe = (
        (F.col("confidence_band") == "disputed")
        | F.col("review_state").isin("quarantined", "rejected")
        | (F.col("rank") == "deprecated")
    )
    state = claims.select("claim_id", safe.alias("safe"))
    out = conflicts.filter(F.col("status") == "open")
    for side in ("a", "b"):
        out = out.join(state.select(F.col("claim_id").alias(f"claim_{side}"), F.col("safe").alias(f"safe_{side}")), f"claim_{side}")
    return out.filter(~(F.col("safe_a") & F.col("safe_b")))


def vocabulary_violations(df: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """(column, value, id) for every value outside its vocabulary."""
    checks = [
        F.when(
            ~F.col(c).isin(VOCABULARY[c]),
            F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("bad_value"), F.col(id_column).cast("string").alias("row_id")),
        )
        for c in columns
    ]
    return df.select(F.explode(F.array_compact(F.array(*checks))).alias("v")).select("v.*")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference points nowhere."""
    have = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(have, key, "left_anti")


def band_distribution(claims: DataFrame) -> DataFrame:
    live = claims.filter(F.col("merged_into").isNull())
    return live.groupBy("confidence_band").agg(F.count(F.lit(1)).alias("n"))
