"""Quotes must be found again inside the snapshot they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.text import (
    QUOTE_MARKS, SPACE, context_after, context_before, fold_topic, match_normalize, trim_edges, trim_space,
)

MIN_NORMALIZED = 4
# Stops whose narrow and wide forms count as the same character.
WIDE_STOPS = {",": "，", ".": "。", "!": "！", "?": "？", ":": "：", ";": "；"}


def is_grounded(text: Column, quote: Column) -> Column:
    """Does the text hold the quote, exactly or up to blanks, quote marks, stop width and case?"""
    q = trim_space(quote)
    nq = match_normalize(q)
    loose = (F.length(nq) >= MIN_NORMALIZED) & F.contains(match_normalize(text), nq)
    return F.coalesce((q != "") & (F.contains(text, q) | loose), F.lit(False))


def _loose_pattern(nq: Column) -> Column:
    """Regex for a normalised quote that lets dropped characters stand between its characters."""

    def one(ch: Column) -> Column:
        out = F.concat(F.lit(r"\Q"), ch, F.lit(r"\E"))
        for narrow, wide in WIDE_STOPS.items():
            out = F.when(ch == narrow, F.lit(f"[{narrow}{wide}]")).otherwise(out)
        return F.when(ch == "\\", F.lit(r"\\")).otherwise(out)

    chars = F.filter(F.split(nq, ""), lambda ch: ch != "")
    return F.concat(F.lit("(?iu)"), F.array_join(F.transform(chars, one), f"[{SPACE}{QUOTE_MARKS}]*"))


def locate(df: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Adds ok, method (exact, normalized, none), char_start and char_end (end exclusive).

    Offsets of a loose match are worked out only for rows whose exact search failed.
    """
    t, q = F.col(text), trim_space(F.col(quote))
    out = df.withColumn("_at", F.when(q != "", F.instr(t, q)).otherwise(0))
    nq = match_normalize(q)
    loose = (F.col("_at") == 0) & (F.length(nq) >= MIN_NORMALIZED) & F.contains(match_normalize(t), nq)
    out = out.withColumn("method", F.when(F.col("_at") > 0, "exact").when(loose, "normalized").otherwise("none"))
    pattern = F.when(F.col("method") == "normalized", _loose_pattern(nq))
    out = out.withColumn("_hit", F.when(F.col("method") == "normalized", F.regexp_substr(t, pattern)))
    start = F.when(F.col("method") == "exact", F.col("_at") - 1).when(F.col("method") == "normalized", F.instr(t, F.col("_hit")) - 1)
    length = F.when(F.col("method") == "exact", F.length(q)).otherwise(F.length("_hit"))
    return out.withColumns(
        {"ok": F.col("method") != "none", "char_start": start, "char_end": start + length}
    ).drop("_at", "_hit")


def ground_links(links: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Locate every (snapshot_id, quote) row in the text of its snapshot; the text itself is not returned."""
    return locate(links.join(snapshots.select("snapshot_id", "text"), "snapshot_id")).drop("text")


def insert_evidence(proposed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Quotes to store: edges trimmed, grounded, one per snapshot and normalised quote, with context.

    ``proposed``: evidence_id, snapshot_id, quote and any further columns.
    """
    trimmed = proposed.withColumn("quote", trim_edges(F.col("quote")))
    found = locate(trimmed.join(snapshots.select("snapshot_id", "text"), "snapshot_id")).filter("ok")
    start, end, text = F.col("char_start"), F.col("char_end"), F.col("text")
    found = found.withColumns(
        {
            "quote_hash": F.sha2(match_normalize(F.col("quote")), 256),
            "context_before": context_before(text, start),
            "context_after": context_after(text, end),
        }
    ).drop("text", "ok")
    rest = [c for c in found.columns if c not in ("snapshot_id", "quote_hash")]
    best = found.groupBy("snapshot_id", "quote_hash").agg(F.min_by(F.struct(*rest), "evidence_id").alias("b"))
    return best.select("snapshot_id", "quote_hash", "b.*")


def validate_claims(proposals: DataFrame, snapshots: DataFrame, max_quotes: int | None = None, max_entities: int | None = None) -> DataFrame:
    """Check model-proposed claims; ``kept`` is false where no quote is grounded.

    ``proposals``: proposal_id, snapshot_id, text, claim_type, topic, quotes, entities, confidence_self.
    """
    j = proposals.join(snapshots.select("snapshot_id", F.col("text").alias("_source")), "snapshot_id")
    # the source is normalised once per row, not once per quote
    j = j.withColumn("_loose", match_normalize(F.col("_source")))

    def held(q: Column) -> Column:
        t = trim_space(q)
        nq = match_normalize(t)
        return (F.length(q) >= 4) & (t != "") & (
            F.contains(F.col("_source"), t) | ((F.length(nq) >= MIN_NORMALIZED) & F.contains(F.col("_loose"), nq))
        )

    def first(items, most: int | None) -> Column:
        return F.col(items) if most is None and isinstance(items, str) else items if most is None else F.slice(items, 1, most)

    known = ["official_fact", "system_inference"]
    usable = F.length("text") >= 6
    j = j.withColumn("quotes", F.filter("quotes", held))
    return j.select(
        "proposal_id", "snapshot_id",
        trim_space(F.col("text")).alias("text"),
        F.when(F.col("claim_type").isin(known), F.col("claim_type")).otherwise("official_fact").alias("claim_type"),
        fold_topic(F.coalesce("topic", F.lit("other"))).alias("topic"),
        first("quotes", max_quotes).alias("quotes"),
        first(F.coalesce("entities", F.array().cast("array<string>")), max_entities).alias("entities"),
        F.coalesce("confidence_self", F.lit(0.7)).alias("confidence_self"),
        (usable & (F.size("quotes") > 0)).alias("kept"),
    )


def theme_mentions(themes: DataFrame) -> DataFrame:
    """(theme_id, review_id, quote, named) of themes with arrays: review_ids and examples (review_id, quote)."""
    ex = themes.select("theme_id", F.explode("examples").alias("e")).select("theme_id", "e.review_id", "e.quote", F.lit(0).alias("named"))
    ids = themes.select("theme_id", F.explode("review_ids").alias("review_id")).select(
        "theme_id", "review_id", F.lit(None).cast("string").alias("quote"), F.lit(1).alias("named")
    )
    return ex.unionByName(ids)


def theme_matches(mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews that carry each proposed theme: grounded example quotes, else a named review's text.

    ``mentions`` as from theme_mentions; a theme may have any number of them. One row per theme and
    review; ``ok`` marks matches, ungrounded examples stay with ``ok`` false so they can be counted.
    """
    j = mentions.join(reviews.select("review_id", "text"), "review_id")
    j = j.withColumn("quote", F.when(F.col("named") == 1, F.col("text")).otherwise(F.col("quote")))
    j = j.withColumn("ok", (F.col("named") == 1) | is_grounded(F.col("text"), F.col("quote"))).drop("text")
    # an example quote outranks the bare mention of the same review
    return j.groupBy("theme_id", "review_id").agg(
        F.min_by("quote", F.when(F.col("ok"), F.struct("named", "quote"))).alias("quote"),
        F.bool_or("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("n_dropped"),
    )


def validate_themes(themes: DataFrame, reviews: DataFrame, min_matches: int = 2, mentions: DataFrame | None = None) -> DataFrame:
    """Themes with enough matches and a clear sentiment, with match and drop counts.

    What the themes mention stands in their arrays, or in ``mentions`` where it is too much for a row.
    """
    counts = theme_matches(theme_mentions(themes) if mentions is None else mentions, reviews).groupBy("theme_id").agg(
        F.count_if("ok").alias("n_matches"), F.sum("n_dropped").alias("n_dropped")
    )
    clear = F.when(F.col("sentiment").isin("positive", "negative"), F.col("sentiment")).otherwise("mixed")
    out = themes.drop("examples", "review_ids").withColumn("sentiment", clear).join(counts, "theme_id")
    return out.filter((F.col("n_matches") >= min_matches) & (F.col("sentiment") != "mixed"))


def validate_verdicts(rows: DataFrame) -> DataFrame:
    """Model verdict, coverage and plan fields with defaults for whatever is missing or unknown."""
    verdict, status = F.col("verdict"), F.col("status")
    return rows.withColumns(
        {
            "verdict": F.when(verdict.isin("conflict", "scoped", "compatible"), verdict).otherwise("compatible"),
            "status": F.when(status.isin("covered", "partial", "missing"), status).otherwise("partial"),
            "sufficient": F.coalesce("sufficient", F.lit(True)),
            "reason": F.coalesce("reason", F.lit("")),
        }
    )
