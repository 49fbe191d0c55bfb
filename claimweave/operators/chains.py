"""Pointers followed to their end: merged claims, superseded versions.

Each round replaces a pointer by the pointer of what it points to, so a chain of n links takes about
log2(n) rounds, all chains side by side. Items on or before a cycle have no end and are reported; the
rounds end with the longest chain, whatever the number of items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.checkpoints import cut
from claimweave.operators.merge import merge_claims, repoint_edges, revision_log


def chain_ends(pointers: DataFrame, item: str = "claim_id", into: str = "merged_into") -> DataFrame:
    """(item, last, hops, cycle) of every item with a pointer; ``last`` is NULL where the way never ends.

    Null pointers are none; an item that points to itself is a cycle; of several pointers of an item the
    least counts.
    """
    links = pointers.select(F.col(item).alias("item"), F.col(into).alias("at")).filter("item is not null and at is not null")
    moving = cut(links.groupBy("item").agg(F.min("at").alias("at")).withColumn("hops", F.lit(1).cast("long")))
    # (item, end, rest): an item whose pointer leads to no item has its end one hop ahead
    last = moving.join(moving.select(F.col("item").alias("at")), "at", "left_anti")
    ended, done = cut(last.select("item", F.col("at").alias("end"), F.col("hops").alias("rest"))), None
    moving = cut(moving.join(ended.select("item"), "item", "left_anti"))
    while True:
        done = ended if done is None else done.unionByName(ended)
        # what has come to its end is looked up among the finished, what moves among the moving
        ways = done.select(F.col("item").alias("at"), F.col("end").alias("then"), F.col("rest").alias("more"), F.lit(True).alias("over")).unionByName(
            moving.select(F.col("item").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"), F.lit(False).alias("over"))
        )
        stepped = cut(moving.join(ways, "at").select("item", F.col("then").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), "over"))
        ended = stepped.filter("over").select("item", F.col("at").alias("end"), F.col("hops").alias("rest"))
        # round k ends the items from 2^(k-1) + 1 to 2^k hops before their end, and every longer way passes such
        # items: when a round ends none, what still moves is on a cycle or leads into one
        if ended.isEmpty():
            break
        moving = stepped.filter("not over").drop("over")
    ends = done.select("item", F.col("end").alias("last"), F.col("rest").alias("hops"), F.lit(False).alias("cycle"))
    lost = moving.select("item", F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("cycle"))
    return ends.unionByName(lost).withColumnRenamed("item", item)


def merge_to_ends(claims: DataFrame, edges: DataFrame, merged: DataFrame, actor: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merge claims (claim_id, canonical_id) into the claims that stay in the end: (claims, edges, log, gone).

    Earlier merges count: what was merged into a claim that is merged now moves on with it. Links go to
    the last claim, the log has a row for each claim that changed, and ``gone`` names the claims that
    leave search indexes (TextIndex.remove). Claims in a cycle stay as they are.
    """
    before = claims.filter("merged_into is not null").select("claim_id", F.col("merged_into").alias("into"))
    pointers = merged.select("claim_id", F.col("canonical_id").alias("into")).unionByName(before.join(merged, "claim_id", "left_anti"))
    ends = cut(chain_ends(pointers, "claim_id", "into").filter("not cycle").select("claim_id", F.col("last").alias("canonical_id")))
    after = merge_claims(claims, ends)
    log = revision_log(claims, after, ["merged_into", "review_state"], actor, "merge")
    return after, repoint_edges(edges, ends), log, ends.select("claim_id")
