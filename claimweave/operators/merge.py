"""Keyed merges, version history and review decisions.

Batches are first reduced to one row per key by an aggregate (which combines map-side), then compared
with the stored table by an anti join, so a key repeated in a large share of a batch costs no more
than one row after the first stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.text import match_normalize, normalize_text
from claimweave.operators.ranking import previous_row, sequence_numbers


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*").select(*df.columns)


def upsert_new(batch: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a batch to add: the first per key, unless the key is already stored."""
    fresh = first_per_key(batch, keys, order)
    return fresh if existing is None else fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert_sources(batch: DataFrame, existing: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """Key (project, connector, url), with a missing URL equal to an empty one; first row wins."""
    fill = lambda df: df.withColumn("url", F.coalesce("url", F.lit("")))
    return upsert_new(fill(batch), None if existing is None else fill(existing), ["project_id", "connector", "url"], order)


def upsert_documents(batch: DataFrame, existing: DataFrame | None, order: Sequence[str]) -> DataFrame:
    return upsert_new(batch, existing, ["project_id", "canonical_url"], order)


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def snapshot_changes(fetched: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Fetches whose content differs from the document's previous one; A, B, A gives three.

    ``fetched``: document_id, fetched_at, fetch_id, text. ``existing``: the stored snapshots with
    document_id, fetched_at, snapshot_id and content_hash.
    """
    new = fetched.withColumn("content_hash", content_hash(F.col("text")))
    slim = new.select("document_id", "fetched_at", F.col("fetch_id").cast("string").alias("fetch_id"), "content_hash", F.lit(True).alias("_new"))
    if existing is not None:
        newest = existing.groupBy("document_id").agg(F.max(F.struct("fetched_at", "snapshot_id", "content_hash")).alias("s"))
        known = newest.select("document_id", "s.fetched_at", F.lit("").alias("fetch_id"), "s.content_hash", F.lit(False).alias("_new"))
        slim = slim.unionByName(known)
    stepped = previous_row(slim, ["document_id"], "fetched_at", "fetch_id", "content_hash", "previous_hash")
    return stepped.filter(F.col("_new") & ~F.col("content_hash").eqNullSafe(F.col("previous_hash"))).drop("_new")


def claim_sequence(claims: DataFrame, existing: DataFrame | None = None, ts: str = "created_at") -> DataFrame:
    """Per-project display number, continuing after the highest one already given."""
    out = sequence_numbers(claims, ["project_id"], ts, "claim_id", "seq")
    if existing is None:
        return out
    top = existing.groupBy("project_id").agg(F.max("seq").alias("_top"))
    return out.join(top, "project_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_top", F.lit(0))).drop("_top")


def text_hash(text: Column) -> Column:
    return F.sha2(match_normalize(text), 256)


def exact_duplicates(claims: DataFrame) -> DataFrame:
    """(claim_id, canonical_id) for claims that repeat an earlier text of the same project."""
    hashed = claims.select("project_id", "claim_id", text_hash(F.col("text")).alias("text_hash"))
    first = hashed.groupBy("project_id", "text_hash").agg(F.min("claim_id").alias("canonical_id"))
    return hashed.join(first, ["project_id", "text_hash"]).filter(F.col("claim_id") != F.col("canonical_id")).select(
        "claim_id", "canonical_id"
    )


def repoint_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Move evidence links of merged claims to the canonical claim; its own links win over moved ones."""
    j = edges.join(merged, "claim_id", "left").withColumns(
        {"_moved": F.col("canonical_id").isNotNull(), "_from": F.col("claim_id"), "claim_id": F.coalesce("canonical_id", "claim_id")}
    )
    rest = [c for c in edges.columns if c not in ("claim_id", "evidence_id")]
    best = j.groupBy("claim_id", "evidence_id").agg(
        F.min_by(F.struct(*rest), F.struct("_moved", "_from")).alias("_b")
    )
    return best.select("claim_id", "evidence_id", "_b.*").select(*edges.columns)


def merge_claims(claims: DataFrame, merged: DataFrame) -> DataFrame:
    """Mark merged claims with their canonical claim."""
    j = claims.join(merged, "claim_id", "left")
    hit = F.col("canonical_id").isNotNull()
    return j.withColumns(
        {
            "merged_into": F.when(hit, F.col("canonical_id")).otherwise(F.col("merged_into")),
            "review_state": F.when(hit, "merged").otherwise(F.col("review_state")),
        }
    ).drop("canonical_id")


def supersede(claims: DataFrame, succession: DataFrame, as_of: str) -> DataFrame:
    """Close superseded claims and prefer the winners; what earlier successions closed stays closed.

    ``succession``: (claim_id, superseded_by). Columns superseded_by and valid_until are added if missing.
    """
    for name, kind in (("superseded_by", "long"), ("valid_until", "timestamp")):
        if name not in claims.columns:
            claims = claims.withColumn(name, F.lit(None).cast(kind))
    lost = succession.groupBy("claim_id").agg(F.max("superseded_by").alias("_winner"))
    won = succession.select(F.col("superseded_by").alias("claim_id")).distinct().withColumn("_won", F.lit(True))
    j = claims.join(lost, "claim_id", "left").join(won, "claim_id", "left")
    gone = F.col("_winner").isNotNull()
    return j.withColumns(
        {
            "rank": F.when(gone, "deprecated").when(F.col("_won"), "preferred").otherwise(F.col("rank")),
            "superseded_by": F.coalesce("_winner", "superseded_by"),
            "valid_until": F.when(gone, F.lit(as_of).cast("timestamp")).otherwise(F.col("valid_until")),
        }
    ).drop("_winner", "_won")


def revision_log(old: DataFrame, new: DataFrame, columns: Sequence[str], actor: str, action: str) -> DataFrame:
    """One row per claim whose tracked columns changed, with both states as JSON."""
    state = F.struct(*columns)
    a = old.select("claim_id", state.alias("_before"))
    b = new.select("claim_id", state.alias("_after"))
    j = a.join(b, "claim_id", "full_outer").filter(~F.col("_before").eqNullSafe(F.col("_after")))
    return j.select(
        "claim_id", F.lit(actor).alias("actor"), F.lit(action).alias("action"),
        F.to_json("_before").alias("before_json"), F.to_json("_after").alias("after_json"),
    )


def enqueue(items: DataFrame, queue: DataFrame | None) -> DataFrame:
    """Queue rows to add, unique on (item_type, item_id, reason)."""
    return upsert_new(items, queue, ["item_type", "item_id", "reason"], ["priority"])


def apply_decisions(claims: DataFrame, queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest human decision per claim: new review state, and its open queue items closed.

    ``decisions``: claim_id, action (approve, reject, quarantine), decided_at.
    """
    last = decisions.groupBy("claim_id").agg(F.max_by("action", F.struct("decided_at", "action")).alias("action"))
    state = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").when(
        F.col("action") == "quarantine", "quarantined"
    )
    out = claims.join(last, "claim_id", "left").withColumn("review_state", F.coalesce(state, F.col("review_state"))).drop("action")
    keyed = last.select(F.lit("claim").alias("item_type"), F.col("claim_id").cast("string").alias("item_id"), "action")
    if "decision" not in queue.columns:
        queue = queue.withColumn("decision", F.lit(None).cast("string"))
    q = queue.join(keyed, ["item_type", "item_id"], "left")
    closed = (F.col("state") == "todo") & F.col("action").isNotNull()
    q = q.withColumns(
        {"decision": F.when(closed, F.col("action")).otherwise(F.col("decision")), "state": F.when(closed, "done").otherwise(F.col("state"))}
    ).drop("action")
    return out, q


def verdict_succession(conflicts: DataFrame) -> DataFrame:
    """Loser and winner of every conflict resolved for one side."""
    a_wins = F.col("status") == "resolved_a"
    settled = conflicts.filter(F.col("status").isin("resolved_a", "resolved_b"))
    return settled.select(
        F.when(a_wins, F.col("claim_b")).otherwise(F.col("claim_a")).alias("claim_id"),
        F.when(a_wins, F.col("claim_a")).otherwise(F.col("claim_b")).alias("superseded_by"),
    )


def upsert_entities(batch: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New entities and their claim links from rows (project_id, claim_id, entity_type, canonical_name)."""
    names = ["project_id", "entity_type", "canonical_name"]
    ident = F.sha2(F.concat_ws("\u0001", *[F.col(n).cast("string") for n in names]), 256)
    new = batch.select(*names).distinct()
    if existing is not None:
        new = new.join(existing.select(*names), names, "left_anti")
    links = batch.select("claim_id", ident.alias("entity_id")).distinct().withColumn("role", F.lit("mentions"))
    return new.withColumn("entity_id", ident), links


def repeat_runs(runs: DataFrame, minutes: int = 30, finished: DataFrame | None = None) -> DataFrame:
    """Runs started within some minutes after a run of the same project and goal was done.

    Finishing times are reduced to the first and last of each slot as wide as the guard: a run is a repeat
    if its own slot has an earlier one, or the slot before has one that is young enough. ``finished``:
    further runs that count as done (project_id, goal, finished_at).
    """
    width = minutes * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    done = runs.filter((F.col("status") == "done") & F.col("finished_at").isNotNull()).select("project_id", "goal", micros("finished_at").alias("at"))
    if finished is not None:
        done = done.unionByName(finished.select("project_id", "goal", micros("finished_at").alias("at")))
    slots = done.groupBy("project_id", "goal", F.floor(F.col("at") / width).alias("slot")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    asked = runs.withColumn("_at", micros("started_at"))
    here = slots.select("project_id", "goal", F.col("slot").alias("_slot"), F.col("first").alias("_first"))
    before = slots.select("project_id", "goal", (F.col("slot") + 1).alias("_slot"), F.col("last").alias("_last"))
    j = asked.withColumn("_slot", F.floor(F.col("_at") / width))
    for side in (here, before):
        j = j.join(side, ["project_id", "goal", "_slot"], "left")
    hit = (F.col("_first") <= F.col("_at")) | (F.col("_last") >= F.col("_at") - width)
    return j.filter(hit).select(*runs.columns)


def delete_runs(runs: DataFrame, events: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop finished runs and their events; what they found stays."""
    finished = runs.join(gone.select("run_id").distinct(), "run_id", "left_semi").filter(F.col("status") != "running").select("run_id")
    return runs.join(finished, "run_id", "left_anti"), events.join(finished, "run_id", "left_anti")
