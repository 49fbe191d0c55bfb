"""Context packs: the best trusted claims that fit a token budget, with their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.functions.scores import age_days, round_half_up
from claimweave.functions.text import estimate_tokens
from claimweave.operators.ranking import top_per_key
from claimweave.operators.roles import avoid_list, strength_rank
from claimweave.operators.scoring import TRUSTED_STATES

BUDGET_DEFAULT = 6000
QUOTA = {"facts": 0.5, "opinions": 0.35, "insights": 0.15}
META_TOKENS = 4


def section_of(claim_type: Column) -> Column:
    return F.when(claim_type == "official_fact", "facts").when(claim_type == "player_opinion", "opinions").otherwise("insights")


def pack_requests(requests: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Requests (request_id, project_id, budget, min_band, focus, has_task); the budget is as asked, within bounds only if given."""
    budget = F.coalesce("budget", F.lit(BUDGET_DEFAULT))
    budget = budget if least is None else F.greatest(budget, F.lit(least))
    budget = budget if most is None else F.least(budget, F.lit(most))
    return requests.withColumn("budget", budget.cast("long"))


def pack_rank(requests: DataFrame, claims: DataFrame, as_of: str, relevance: DataFrame | None = None) -> DataFrame:
    """Candidates of every request with their rank score.

    ``relevance``: (request_id, claim_id, pos, n_hits) of a search for the request's task.
    """
    ok = claims.filter(
        F.col("merged_into").isNull() & (F.col("rank") != "deprecated") & F.col("review_state").isin(TRUSTED_STATES)
        & F.col("confidence_band").isin("verified", "likely")
    )
    j = pack_requests(requests).join(ok.drop("rank"), "project_id").filter(
        (F.col("min_band") != "verified") | (F.col("confidence_band") == "verified")
    )
    if relevance is None:
        rel = F.when(F.col("has_task"), F.lit(0.3)).otherwise(1.0)
    else:
        j = j.join(relevance.select("request_id", "claim_id", F.col("pos").alias("_pos"), "n_hits"), ["request_id", "claim_id"], "left")
        near = F.coalesce(1 - (F.col("_pos") - 1) / F.greatest("n_hits", F.lit(1)), F.lit(0.0))
        rel = F.when(F.col("has_task"), 0.3 + 0.7 * near).otherwise(1.0)
    band = F.when(F.col("confidence_band") == "verified", 1.0).otherwise(0.7)
    fresh = 0.7 + 0.3 * F.exp(-age_days(F.col("updated_at"), F.lit(as_of).cast("timestamp")) / 180)
    wanted = F.coalesce(F.size("focus"), F.lit(0)) > 0
    focus = F.when(~wanted, 1.0).when(F.array_contains(F.col("focus"), F.col("topic")), 1.3).otherwise(0.8)
    return j.withColumns({"rank_score": round_half_up(band * rel * fresh * focus, 9), "section": section_of(F.col("claim_type"))})


def item_cost(ranked: DataFrame, cited: DataFrame) -> DataFrame:
    """Default price of a pack item: tokens of its text and of the (few) quotes it shows."""
    quotes = cited.groupBy("claim_id").agg(F.sum(estimate_tokens(F.col("quote"))).alias("quote_tokens"))
    priced = ranked.join(quotes, "claim_id", "left")
    return priced.withColumn("cost", estimate_tokens(F.col("text")) + F.coalesce("quote_tokens", F.lit(0))).drop("quote_tokens")


def _affordable(ranked: DataFrame, salts: int = 16) -> DataFrame:
    """Rows that the budget could ever reach, without changing the outcome.

    Among items of one section and one cost both passes take the best ranked first, and together they
    pay for at most budget / cost of them; anything ranked lower can be left out. That bounds what a
    request gathers by its budget, whatever the size of the project. Salting first splits a hot group.
    """
    order = [F.col("rank_score").desc(), F.col("claim_id")]
    most = F.floor(F.col("budget") / F.col("cost"))
    out = ranked.withColumn("cost", F.greatest("cost", F.lit(1)).cast("long")).withColumn("_salt", F.pmod(F.xxhash64("claim_id"), F.lit(salts)))
    keys = ["request_id", "section", "cost"]
    for cols in ([*keys, "_salt"], keys):
        out = out.withColumn("_pos", F.row_number().over(W.partitionBy(*cols).orderBy(*order))).filter(F.col("_pos") <= most)
    return out.drop("_pos", "_salt")


def pack_fill(ranked: DataFrame) -> DataFrame:
    """Greedy fill by rank with a share per section, then leftovers whatever their section.

    An item that does not fit is skipped and the next one tried. Returns (request_id, claim_id,
    pack_pos, tokens_used) of what was taken.
    """
    item = F.struct((-F.col("rank_score")).alias("by"), F.col("claim_id").alias("id"), "section", "cost")
    bags = _affordable(ranked).groupBy("request_id", "budget").agg(F.array_sort(F.collect_list(item)).alias("items"))
    ids = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")
    budget = F.col("budget")
    start = F.struct(F.lit(META_TOKENS).cast("long").alias("used"), *[zero.alias(s) for s in QUOTA], ids.alias("taken"))

    def first_pass(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        share = F.lit(False)
        for s, q in QUOTA.items():
            share = F.when(x["section"] == s, acc[s] + x["cost"] <= budget * q).otherwise(share)
        take = fits & share
        spent = [(acc[s] + F.when(take & (x["section"] == s), x["cost"]).otherwise(0)).alias(s) for s in QUOTA]
        return F.struct(
            (acc["used"] + F.when(take, x["cost"]).otherwise(0)).alias("used"), *spent,
            F.when(take, F.array_append(acc["taken"], x["id"])).otherwise(acc["taken"]).alias("taken"),
        )

    def second_pass(acc: Column, x: Column) -> Column:
        take = acc["used"] + x["cost"] <= budget
        return F.struct(
            (acc["used"] + F.when(take, x["cost"]).otherwise(0)).alias("used"),
            F.when(take, F.array_append(acc["taken"], x["id"])).otherwise(acc["taken"]).alias("taken"),
        )

    one = bags.withColumn("one", F.aggregate("items", start, first_pass))
    one = one.withColumn("rest", F.filter("items", lambda x: ~F.array_contains(F.col("one.taken"), x["id"])))
    begin = F.struct(F.col("one.used").alias("used"), F.col("one.taken").alias("taken"))
    done = one.withColumn("done", F.aggregate("rest", begin, second_pass))
    out = done.select("request_id", F.col("done.used").alias("tokens_used"), F.posexplode("done.taken").alias("pack_pos", "claim_id"))
    return out.withColumn("pack_pos", (F.col("pack_pos") + 1).cast("long"))


def pack_sections(filled: DataFrame, ranked: DataFrame) -> DataFrame:
    """Taken items with the section they are shown in; own weaknesses leave the opinion section."""
    info = ranked.select("request_id", "claim_id", "section", "ad_role", "text")
    shown = filled.join(info, ["request_id", "claim_id"])
    return shown.filter((F.col("section") != "opinions") | ~F.coalesce(F.col("ad_role") == "landmine", F.lit(False)))


def pack_landmines(claims: DataFrame, top: int = 10) -> DataFrame:
    """Each project's best documented weaknesses in any band, with promises to avoid."""
    mines = claims.filter(F.col("merged_into").isNull() & (F.col("claim_type") == "player_opinion") & (F.col("ad_role") == "landmine"))
    best = top_per_key(mines, ["project_id"], [F.col("confidence").desc_nulls_last(), F.col("claim_id")], top)
    return best.select("project_id", "claim_id", "pos", "text", "confidence_band", "confidence", avoid_list(F.col("text")).alias("avoid_promising"))


def pack_excluded(claims: DataFrame) -> DataFrame:
    """Per project and band: claims left out for weak evidence, open conflict or pending review."""
    weak = F.col("confidence_band").isin("uncertain", "disputed", "insufficient") | ~F.col("review_state").isin(TRUSTED_STATES)
    out = claims.filter(F.col("merged_into").isNull() & weak)
    return out.groupBy("project_id", "confidence_band").agg(F.count(F.lit(1)).alias("n"))


def pack_trimmed(ranked: DataFrame, filled: DataFrame) -> DataFrame:
    """Per request: candidates the budget left out."""
    left = ranked.join(filled.select("request_id", "claim_id"), ["request_id", "claim_id"], "left_anti")
    counts = left.groupBy("request_id").agg(F.count(F.lit(1)).alias("trimmed"))
    return ranked.select("request_id").distinct().join(counts, "request_id", "left").fillna(0, subset=["trimmed"])


def angles_by_strength(angles: DataFrame) -> DataFrame:
    return angles.orderBy("project_id", strength_rank(F.col("strength")).desc(), "dimension", "tactic")
