"""Explainable confidence: independent sources, signed factors, caps, bands and routing.

Evidence is collapsed by (claim, stance, publisher or copy cluster) first, so a claim with very many
links is reduced map-side before anything meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.scores import age_days, clamp, log2, logit, round_half_up, sigmoid, wilson_lower

SCORER_VERSION = "conf-v1"
BANDS = ["verified", "likely", "uncertain", "disputed", "insufficient"]
TRUSTED_STATES = ["auto_accepted", "approved"]
UNSCORED_STATES = ["rejected", "expired", "merged"]
OFFICIAL_TYPES = ["official", "store_metadata"]


def scoring_links(
    claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame, sources: DataFrame, snapshots: DataFrame | None = None
) -> DataFrame:
    """One row per (claim, evidence) with all that scoring needs; merged and closed claims are left out.

    The claim join comes first and the aggregation key differs from the key of the last join, so a
    hot claim can be split by the adaptive skew join and still be pre-aggregated.
    """
    open_claims = active_claims(claims).select("claim_id", "claim_type", F.col("value.value").alias("claim_value"))
    links = claim_evidence.select("claim_id", "evidence_id", "stance", "directness", "extractor_confidence").join(
        open_claims, "claim_id"
    )
    ev = evidence.select("evidence_id", "snapshot_id", "source_id", "quote", "published_at", "suspected_promo")
    # told before the texts go through further joins
    out = links.join(ev, "evidence_id").withColumn("has_value", F.contains(F.col("quote"), F.col("claim_value"))).join(
        sources.select("source_id", "source_type", "owner_key", "authority_prior"), "source_id"
    )
    if snapshots is None:
        out = out.withColumn("dup_cluster", F.lit(None).cast("string"))
    else:
        out = out.join(snapshots.select("snapshot_id", "dup_cluster"), "snapshot_id", "left")
    return out


def active_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("merged_into").isNull() & ~F.col("review_state").isin(UNSCORED_STATES))


def group_key() -> Column:
    owner = F.when(F.coalesce(F.col("owner_key"), F.lit("")) != "", F.col("owner_key")).otherwise(
        F.col("source_id").cast("string")
    )
    return F.when(F.col("dup_cluster").isNotNull(), F.concat(F.lit("cluster:"), F.col("dup_cluster"))).otherwise(
        F.concat(F.lit("owner:"), owner)
    )


def directness_rank() -> Column:
    return F.when(F.col("directness") == "direct", 2).when(F.col("directness") == "indirect", 1).otherwise(0)


def independent_groups(links: DataFrame) -> DataFrame:
    """Evidence of one owner or one copy cluster counts once per claim and stance."""
    return (
        links.withColumn("group_key", group_key())
        .groupBy("claim_id", "stance", "group_key")
        .agg(
            F.max("authority_prior").alias("authority"),
            F.max(directness_rank()).alias("directness_rank"),
            F.bool_or("suspected_promo").alias("any_promo"),
            F.max("published_at").alias("newest"),
            F.bool_or(F.coalesce(F.col("has_value"), F.lit(False))).alias("agrees"),
            F.bool_or(F.col("source_type").isin(OFFICIAL_TYPES)).alias("official"),
            F.count(F.lit(1)).alias("n_evidence"),
            F.sum(F.col("suspected_promo").cast("int")).alias("n_promo"),
            F.sum("extractor_confidence").alias("self_conf_sum"),
            F.count("extractor_confidence").alias("self_conf_n"),
        )
    )


#: How two partial states of a group (columns of independent_groups) become one.
GROUP_MERGE = {
    "authority": F.max, "directness_rank": F.max, "any_promo": F.bool_or, "newest": F.max, "agrees": F.bool_or, "official": F.bool_or,
    "n_evidence": F.sum, "n_promo": F.sum, "self_conf_sum": F.sum, "self_conf_n": F.sum,
}


def opinion_platforms(links: DataFrame) -> DataFrame:
    """(claim_id, platform): platforms (owner prefix before the colon) of each opinion's evidence, each once."""
    platform = F.split_part(F.col("owner_key"), F.lit(":"), F.lit(1))
    return links.filter(F.col("claim_type") == "player_opinion").select("claim_id", platform.alias("platform")).distinct()


def platform_spread(links: DataFrame) -> DataFrame:
    """Distinct platforms over all linked evidence of each opinion."""
    return opinion_platforms(links).groupBy("claim_id").agg(F.count("platform").alias("n_platforms"))


def premise_floor(claims: DataFrame, premises: DataFrame | None = None) -> DataFrame:
    """Lowest known confidence among the claims a claim is derived from (looked up in ``premises``, else in the claims)."""
    asked = claims.select("claim_id", F.explode("derived_from").alias("premise_id"))
    known = (claims if premises is None else premises).select(F.col("claim_id").alias("premise_id"), "confidence")
    return asked.join(known, "premise_id").groupBy("claim_id").agg(F.min("confidence").alias("min_premise"))


def claim_features(groups: DataFrame) -> DataFrame:
    """Per-claim totals over the independent groups."""
    sup, ref = F.col("stance") == "supports", F.col("stance") == "refutes"
    admissible = sup | ref

    def over(cond, col):
        return F.when(cond, F.col(col))

    return groups.groupBy("claim_id").agg(
        F.count_if(sup).alias("n_support"),
        F.count_if(ref).alias("n_refute"),
        F.max(over(sup, "authority")).alias("support_authority"),
        F.max(over(ref, "authority")).alias("refute_authority"),
        F.max(over(sup, "directness_rank")).alias("best_directness"),
        F.count_if(sup & F.col("agrees")).alias("n_agree"),
        F.count_if(sup & F.col("any_promo")).alias("n_promo_groups"),
        F.max(over(sup, "newest")).alias("newest_support"),
        F.bool_or(sup & F.col("official")).alias("has_official"),
        F.sum(over(admissible, "self_conf_sum")).alias("self_conf_sum"),
        F.sum(over(admissible, "self_conf_n")).alias("self_conf_n"),
        F.sum(over(sup, "n_evidence")).alias("n_support_evidence"),
        F.sum(over(sup, "n_promo")).alias("n_support_promo"),
    )


def factor_columns(as_of: Column) -> dict[str, Column]:
    """Log-odds of every factor; NULL where the factor does not apply."""
    n = F.col("n_support")
    any_support = n > 0
    authority = F.coalesce(F.col("support_authority"), F.lit(0.2))
    age = age_days(F.col("newest_support"), as_of)
    promo_share = F.col("n_promo_groups") / F.greatest(n, F.lit(1))
    agree_share = F.col("n_agree") / F.greatest(n, F.lit(1))
    self_conf = F.col("self_conf_sum") / F.when(F.col("self_conf_n") > 0, F.col("self_conf_n"))
    return {
        "authority_prior": round_half_up(logit(authority) * 0.9),
        "directness": F.when(F.col("best_directness") == 2, 0.8).when(F.col("best_directness") == 1, 0.3).otherwise(0.0),
        "independent_sources": round_half_up(F.least(F.lit(1.5), 0.7 * log2(1 + n))),
        "consistency": F.when(F.col("has_claim_value") & (n >= 2), round_half_up(-0.8 + 1.4 * agree_share)),
        "freshness": F.when(F.col("newest_support").isNull(), -0.2).when(age > 365, -0.6).when(age > 180, -0.3).otherwise(0.0),
        "originality": F.when(any_support, round_half_up(-1.2 * promo_share)),
        "refutation": F.when(
            F.col("n_refute") > 0, round_half_up(-1.0 * F.col("n_refute") - 0.5 * F.col("refute_authority"))
        ),
        # nine digits are kept so that a mean at the limit does not depend on the order of summation
        "extraction_quality": F.when(round_half_up(self_conf, 9) < 0.6, F.lit(-0.4)),
    }


def factor_inputs(as_of: Column) -> dict[str, Column]:
    """What each factor looked at, for the breakdown."""
    s = lambda c: c.cast("string")
    return {
        "authority_prior": F.concat(F.lit("best authority "), s(F.coalesce("support_authority", F.lit(0.2)))),
        "directness": F.element_at(
            F.array(F.lit("interpretive"), F.lit("indirect"), F.lit("direct")),
            F.coalesce(F.col("best_directness"), F.lit(0)) + 1,
        ),
        "independent_sources": F.concat(s(F.col("n_support")), F.lit(" groups, "), s(F.coalesce("n_support_evidence", F.lit(0))), F.lit(" rows")),
        "consistency": F.concat(s(F.col("n_agree")), F.lit("/"), s(F.col("n_support")), F.lit(" groups hold the value")),
        "freshness": F.coalesce(
            F.concat(F.lit("newest support "), s(F.round(age_days(F.col("newest_support"), as_of)).cast("long")), F.lit(" days old")),
            F.lit("no date"),
        ),
        "originality": F.concat(s(F.col("n_promo_groups")), F.lit("/"), s(F.col("n_support")), F.lit(" groups suspected promotion")),
        "refutation": F.concat(s(F.col("n_refute")), F.lit(" refuting groups, authority "), s(F.col("refute_authority"))),
        "extraction_quality": F.concat(F.lit("mean self-confidence "), s(round_half_up(F.col("self_conf_sum") / F.col("self_conf_n"), 2))),
    }


def cap_columns() -> dict[str, Column]:
    kind = F.col("claim_type")
    premise = F.coalesce(F.col("min_premise"), F.lit(0.5))
    return {
        "single_source_cap": F.when(F.col("n_support") == 1, 0.7),
        "no_official_source_cap": F.when((kind == "official_fact") & ~F.coalesce("has_official", F.lit(False)), 0.75),
        "inference_cap": F.when(kind == "system_inference", round_half_up(F.least(F.lit(0.85), 0.85 * premise))),
        "insight_cap": F.when(kind == "creative_insight", 0.75),
    }


def open_conflict_claims(conflicts: DataFrame) -> DataFrame:
    """Claims on either side of an open conflict."""
    is_open = conflicts.filter(F.col("status") == "open")
    return is_open.select(F.explode(F.array("claim_a", "claim_b")).alias("claim_id")).distinct()


def score_claims(
    claims: DataFrame, links: DataFrame, as_of: str, conflicts: DataFrame | None = None
) -> DataFrame:
    """Score every open claim; adds confidence, confidence_band, raw and the explainable breakdown.

    Facts, inferences and insights are scored for truth, opinions for representativeness. A claim
    without admissible evidence gets band ``insufficient`` and a NULL score, never 0.5.
    """
    # mentions count for the spread of platforms alone
    weighed = links.filter(F.col("stance").isin("supports", "refutes"))
    return score_groups(claims, independent_groups(weighed), platform_spread(links), as_of, conflicts)


def score_groups(
    claims: DataFrame, groups: DataFrame, platforms: DataFrame, as_of: str, conflicts: DataFrame | None = None, premises: DataFrame | None = None
) -> DataFrame:
    """As score_claims, from independent groups and counted platforms (claim_id, n_platforms).

    ``premises``: where the claims are part of a table, the whole of it, for what they are derived from.
    """
    at = F.lit(as_of).cast("timestamp")
    base = active_claims(claims).drop("confidence", "confidence_band", "breakdown")
    wide = base.join(claim_features(groups), "claim_id", "left")
    wide = wide.join(platforms, "claim_id", "left").join(premise_floor(claims, premises), "claim_id", "left")
    if conflicts is None:
        wide = wide.withColumn("disputed", F.lit(False))
    else:
        flagged = open_conflict_claims(conflicts).withColumn("disputed", F.lit(True))
        wide = wide.join(flagged, "claim_id", "left").withColumn("disputed", F.coalesce("disputed", F.lit(False)))
    wide = wide.withColumns(
        {
            "n_support": F.coalesce("n_support", F.lit(0)),
            "n_refute": F.coalesce("n_refute", F.lit(0)),
            "n_platforms": F.coalesce("n_platforms", F.lit(0)),
            "has_claim_value": F.col("value").isNotNull(),
        }
    )
    is_opinion = F.col("claim_type") == "player_opinion"
    factors, caps, inputs = factor_columns(at), cap_columns(), factor_inputs(at)
    wide = wide.withColumns({f"f_{k}": c.cast("double") for k, c in factors.items()})
    wide = wide.withColumns({f"c_{k}": c.cast("double") for k, c in caps.items()})
    total = sum((F.coalesce(F.col(f"f_{k}"), F.lit(0.0)) for k in factors), F.lit(0.0))

    holding, discussing = F.col("opinion.n_holding"), F.col("opinion.n_discussing")
    promo_share = F.col("n_support_promo") / F.greatest(F.col("n_support_evidence"), F.lit(1))
    wide = wide.withColumns(
        {
            "fact_raw": sigmoid(total),
            "ci_low": wilson_lower(holding, discussing),
            "admissible": F.when(is_opinion, (F.coalesce(discussing, F.lit(0)) != 0) & (F.col("n_support") > 0)).otherwise(
                (F.col("n_support") > 0) | (F.col("n_refute") > 0)
            ),
        }
    )
    adjusted = clamp(F.col("ci_low") * (1 - 0.5 * promo_share), 0.0, 1.0)
    wide = wide.withColumn("adjusted", adjusted)
    fact_score = round_half_up(F.least(F.col("fact_raw"), *[F.col(f"c_{k}") for k in caps]))
    score = F.when(F.col("admissible"), F.when(is_opinion, round_half_up(F.col("adjusted"))).otherwise(fact_score))
    wide = wide.withColumn("confidence", score)

    fact_band = (
        F.when((F.col("confidence") >= 0.85) & (F.col("n_support") >= 2), "verified")
        .when(F.col("confidence") >= 0.65, "likely")
        .otherwise("uncertain")
    )
    a = F.col("adjusted")
    opinion_band = (
        F.when(discussing < 8, "uncertain")
        .when((a >= 0.2) & (discussing >= 80) & (F.col("n_platforms") >= 2), "verified")
        .when(((a >= 0.2) & (discussing >= 20)) | ((holding >= 6) & (a >= 0.06) & (discussing >= 40)), "likely")
        .otherwise("uncertain")
    )
    band = (
        F.when(~F.col("admissible"), "insufficient")
        .when(F.col("disputed"), "disputed")
        .when(is_opinion, opinion_band)
        .otherwise(fact_band)
    )

    def entry(name: str, given: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("factor"), given.alias("input"), value.cast("double").alias("logodds"))

    fact_factors = F.array(*[F.when(F.col(f"f_{k}").isNotNull(), entry(k, inputs[k], F.col(f"f_{k}"))) for k in factors])
    text = lambda c: c.cast("string")
    opinion_factors = F.array(
        entry("prevalence", F.concat(text(holding), F.lit("/"), text(discussing)), F.lit(0.0)),
        entry("wilson_ci_low", text(round_half_up(F.col("ci_low"), 2)), F.lit(0.0)),
        entry("platform_spread", text(F.col("n_platforms")), F.lit(0.0)),
        F.when(promo_share > 0, entry("promo_discount", text(round_half_up(promo_share, 2)), F.lit(0.0))),
    )
    nothing = F.array(entry("no_admissible_evidence", F.lit("no supporting or refuting evidence"), F.lit(0.0)))
    cap_list = F.array(
        *[F.when(F.col(f"c_{k}").isNotNull(), F.struct(F.lit(k).alias("rule"), F.col(f"c_{k}").alias("cap"))) for k in caps]
    )
    breakdown = F.struct(
        F.array_compact(
            F.when(~F.col("admissible"), nothing).when(is_opinion, opinion_factors).otherwise(fact_factors)
        ).alias("factors"),
        F.when(is_opinion | ~F.col("admissible"), F.array_compact(F.slice(cap_list, 1, 0)))
        .otherwise(F.array_compact(cap_list))
        .alias("caps"),
        F.when(F.col("admissible"), round_half_up(F.when(is_opinion, F.col("ci_low")).otherwise(F.col("fact_raw")))).alias("raw"),
        F.lit(SCORER_VERSION).alias("version"),
    )
    return wide.withColumns({"confidence_band": band, "breakdown": breakdown}).select(
        *base.columns, "confidence", "confidence_band", "breakdown", "n_support", "n_refute", "n_platforms"
    )


def explode_breakdown(scored: DataFrame) -> DataFrame:
    return scored.select("claim_id", F.explode("breakdown.factors").alias("f")).select("claim_id", "f.*")


def route_claims(scored: DataFrame) -> DataFrame:
    """Next review state plus the queue reason and priority (NULL when nothing has to be queued).

    Human approval and human quarantine both outlive rescoring.
    """
    band = F.col("confidence_band")
    state = (
        F.when(F.col("review_state") == "approved", "approved")
        .when(F.col("review_state") == "quarantined", "quarantined")
        .when(band.isin("verified", "likely"), "auto_accepted")
        .when(band == "disputed", "quarantined")
        .otherwise("pending")
    )
    out = scored.withColumn("next_state", state)
    reason = F.when(
        F.col("next_state") == "pending",
        F.when(band == "insufficient", "insufficient_evidence").otherwise("low_confidence"),
    ).when(F.col("next_state") == "quarantined", "conflict_open")
    out = out.withColumn("queue_reason", reason)
    priority = F.when(F.col("queue_reason") == "conflict_open", 1).when(F.col("queue_reason").isNotNull(), 3)
    return out.withColumn("queue_priority", priority)


def queue_rows(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("queue_reason").isNotNull()).select(
        "project_id",
        F.lit("claim").alias("item_type"),
        F.col("claim_id").alias("item_id"),
        F.col("queue_reason").alias("reason"),
        F.col("queue_priority").alias("priority"),
    )


def band_tally(scored: DataFrame) -> DataFrame:
    """Per project: total and one count per band."""
    counts = [F.count_if(F.col("confidence_band") == b).alias(b) for b in BANDS]
    return scored.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), *counts)


def opinion_stats(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Prevalence, Wilson bound and counts from rows (keys, holding, discussing, sample_size)."""
    shown = F.greatest(F.col("discussing"), F.col("holding"))
    prevalence = F.when(F.col("discussing") > 0, round_half_up(F.col("holding") / F.greatest(F.col("discussing"), F.lit(1)))).otherwise(0.0)
    return mentions.select(
        *keys,
        prevalence.alias("prevalence"),
        round_half_up(wilson_lower(F.col("holding"), shown)).alias("ci_low"),
        F.col("holding").alias("n_holding"),
        F.col("discussing").alias("n_discussing"),
        F.col("sample_size"),
        F.col("sentiment"),
    )
