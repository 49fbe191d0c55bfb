"""Contradicting facts and version successions.

Two claims of one slot conflict when their values differ and their versions do not set them apart. The
number of such pairs grows with the square of a slot, so pairs are not listed: each claim gets the
exact number of its opponents and one named opponent, from counts per slot, version and value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.operators.ranking import top_per_key

STORE_SCOPED = r"（\w+ 区）|\((CN|US)\)"


def comparable_facts(claims: DataFrame) -> DataFrame:
    """Live facts with a predicate and value whose text is not limited to one store front."""
    return claims.filter(
        (F.col("claim_type") == "official_fact") & F.col("merged_into").isNull() & (F.col("rank") != "deprecated")
        & F.col("predicate").isNotNull() & F.col("value").isNotNull() & ~F.col("text").rlike(f"(?U){STORE_SCOPED}")
    )


#: Facts of a slot that one task compares; a slot with more is compared by its cells.
SLOT_ROWS = 100_000


def value_conflicts(facts: DataFrame, slot: Sequence[str] = ("project_id", "predicate"), slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Claims in conflict: opponents counted exactly, the smallest opposing claim id named.

    ``facts``: claim_id, slot columns, value, version_min. Claims with different set versions never
    oppose each other; a claim without a version opposes every other value.

    Facts move once, to their slot. Slots of more than ``slot_rows`` facts don't: they are reduced where
    they lie, and what is known of them is joined back.
    """
    keys = list(slot)
    told = facts.select("claim_id", *keys, "value", F.coalesce("version_min", F.lit("")).alias("ver")).dropna(subset=[*keys, "value"])
    # at most one large slot for so many facts
    large = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slot_rows)
    marked = told.join(F.broadcast(large), keys, "left")
    small, rest = (marked.filter(c).drop("_n") for c in (F.col("_n").isNull(), F.col("_n").isNotNull()))
    return _slot_conflicts(small, keys).unionByName(_cell_conflicts(rest, keys))


def _slot_conflicts(told: DataFrame, keys: list[str]) -> DataFrame:
    """Slots whose facts one task holds; each window below lies within a slot."""
    plain, row = F.col("ver") == "", F.struct("claim_id", "value")
    slot, own, same = W.partitionBy(*keys), W.partitionBy(*keys, "ver"), W.partitionBy(*keys, "value")
    one = F.lit(1)
    # the window over whole slots comes first: the rows it deals suit all that follow
    bare = F.when(plain, row)
    wide = told.withColumns({"all_n": F.count(one).over(slot), "all_1": F.min(row).over(slot), "bare_n": F.count_if(plain).over(slot), "bare_1": F.min(bare).over(slot)})
    # the smallest claim of another value than the smallest claim's
    wide = wide.withColumns(
        {
            "all_2": F.min(F.when(F.col("value") != F.col("all_1.value"), F.col("claim_id"))).over(slot),
            "bare_2": F.min(F.when(plain & (F.col("value") != F.col("bare_1.value")), F.col("claim_id"))).over(slot),
        }
    )
    wide = wide.withColumns({"own_n": F.count(one).over(own), "own_1": F.min(row).over(own)})
    wide = wide.withColumn("own_2", F.min(F.when(F.col("value") != F.col("own_1.value"), F.col("claim_id"))).over(own))
    wide = wide.withColumn("n", F.count(one).over(W.partitionBy(*keys, "ver", "value")))
    wide = wide.withColumns({"same_all": F.count(one).over(same), "same_bare": F.count_if(plain).over(same)})

    def other(name: str) -> Column:
        return F.when(F.col(f"{name}_1.value") != F.col("value"), F.col(f"{name}_1.claim_id")).otherwise(F.col(f"{name}_2"))

    n = F.when(plain, F.col("all_n") - F.col("same_all")).otherwise(F.col("own_n") - F.col("n") + F.col("bare_n") - F.col("same_bare"))
    opponent = F.when(plain, other("all")).otherwise(F.least(other("own"), other("bare")))
    judged = wide.withColumns({"n_opponents": n, "opponent": opponent}).filter(F.col("n_opponents") > 0)
    return judged.select("claim_id", *keys, "value", "n_opponents", "opponent")


def _cell_conflicts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Slots of any size: equal facts fold into a cell, and cells are joined with the smallest of their group."""
    cells = facts.groupBy(*keys, "ver", "value").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first"))

    def two_smallest(by: list[str], name: str) -> DataFrame:
        """Total rows and the two smallest (first claim, value) cells of different values per group."""
        per_value = cells.groupBy(*by, "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        # a value has one row in a group; a constant top-n is cut before anything moves
        first_two = top_per_key(per_value.select(*by, "first", "value"), by, [F.col("first"), F.col("value")], 2)
        cell = lambda pos: F.max(F.when(F.col("pos") == pos, F.struct("first", "value")))
        two = first_two.groupBy(*by).agg(cell(1).alias(f"{name}_1"), cell(2).alias(f"{name}_2"))
        return cells.groupBy(*by).agg(F.sum("n").alias(f"{name}_n")).join(two, by)

    everyone = two_smallest(keys, "all")
    versioned = two_smallest([*keys, "ver"], "own")
    bare = versioned.filter(F.col("ver") == "").drop("ver").select(
        *keys, F.col("own_n").alias("bare_n"), F.col("own_1").alias("bare_1"), F.col("own_2").alias("bare_2")
    )
    same_all = cells.groupBy(*keys, "value").agg(F.sum("n").alias("same_all"), F.sum(F.when(F.col("ver") == "", F.col("n"))).alias("same_bare"))
    wide = (
        cells.join(everyone, keys).join(versioned, [*keys, "ver"]).join(bare, keys, "left").join(same_all, [*keys, "value"])
    )
    mine = F.col("value")

    def other(name: str) -> Column:
        return F.when(F.col(f"{name}_1.value") != mine, F.col(f"{name}_1.first")).otherwise(F.col(f"{name}_2.first"))

    plain = F.col("ver") == ""
    n = F.when(plain, F.col("all_n") - F.col("same_all")).otherwise(
        F.col("own_n") - F.col("n") + F.coalesce("bare_n", F.lit(0)) - F.coalesce("same_bare", F.lit(0))
    )
    opponent = F.when(plain, other("all")).otherwise(F.least(other("own"), other("bare")))
    judged = wide.withColumns({"n_opponents": n, "opponent": opponent}).filter(F.col("n_opponents") > 0)
    judged = judged.select(*keys, "ver", "value", "n_opponents", "opponent")
    return facts.join(judged, [*keys, "ver", "value"]).select("claim_id", *keys, "value", "n_opponents", "opponent")


def conflict_rows(conflicting: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Conflicts to open, once per unordered pair of a claim and its named opponent."""
    pair = conflicting.select(
        "project_id", F.least("claim_id", "opponent").alias("claim_a"), F.greatest("claim_id", "opponent").alias("claim_b")
    ).distinct()
    if existing is not None:
        pair = pair.join(existing.filter(F.col("status") == "open").select("claim_a", "claim_b"), ["claim_a", "claim_b"], "left_anti")
    return pair.withColumns(
        {"conflict_type": F.lit("numeric"), "detected_by": F.lit("rule:numeric_mismatch"), "status": F.lit("open")}
    )


def version_key(version: Column, numeric: bool = True) -> Column:
    """Sortable form of a version: its numbers, then its text (``numeric`` False: text alone)."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("decimal(38,0)"))
    return F.struct(numbers.alias("numbers"), version.alias("text")) if numeric else F.struct(version.alias("text"))


def version_chain(facts: DataFrame, slot: Sequence[str] = ("project_id", "predicate"), numeric: bool = True) -> DataFrame:
    """(claim_id, superseded_by): claims give way to the next version of their slot.

    Succession is worked out between versions, one row each, and then joined back to their claims. A
    value that reappears in the next version is superseded too, unless every value stays the same.
    """
    keys = list(slot)
    have = facts.filter(F.col("version_min").isNotNull())
    versions = have.groupBy(*keys, "version_min").agg(
        F.min("claim_id").alias("first"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    order = W.partitionBy(*keys).orderBy(version_key(F.col("version_min"), numeric))
    nxt = versions.withColumn("next", F.lead(F.struct("first", "lo", "hi")).over(order)).filter(F.col("next").isNotNull())
    changed = ~((F.col("lo") == F.col("hi")) & (F.col("next.lo") == F.col("next.hi")) & (F.col("lo") == F.col("next.lo")))
    nxt = nxt.filter(changed).select(*keys, "version_min", F.col("next.first").alias("superseded_by"))
    return have.join(nxt, [*keys, "version_min"]).select("claim_id", "superseded_by")
