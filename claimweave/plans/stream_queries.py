"""The streaming jobs run to the end over files of the driver's events and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.checkpoints import new_folder
from claimweave.operators.bucketed import BucketedLog
from claimweave.operators.search_index import TextIndex
from claimweave.plans.registry import Tables, query
from claimweave.plans.merge_queries import REPEATS
from claimweave.plans.search_queries import TERMS
from claimweave.streaming import jobs as ST


DAYS = ["2024-01-11", "2024-01-21"]


def arrive(t: Tables, df: DataFrame, by: str, cuts: list, start: Callable[[DataFrame], StreamingQuery], out: str | None) -> DataFrame | None:
    """Let a table arrive in parts: write one, run the job over what is new, write the next.

    Every run resumes from the same offsets, so each part is one micro-batch of one continuing query.
    """
    folder = new_folder(t.spark, "arriving")
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(by) >= F.lit(lo))
        if hi is not None:
            part = part.filter(F.col(by) < F.lit(hi))
        part.write.mode("append").parquet(folder)
        start(ST.file_stream(t.spark, folder, df)).awaitTermination()
    return None if out is None else t.spark.read.parquet(out)


def folders(t: Tables, label: str) -> tuple[str, str, str]:
    return tuple(new_folder(t.spark, f"{label}-{part}") for part in ("out", "state", "offsets"))


@query(
    "rate_limit_minutes",
    "SELECT user_id AS key_id, epoch_us(date_trunc('minute', ts)) AS minute, count(*) AS n FROM {events} GROUP BY ALL HAVING count(*) > 1",
)
def rate_limit_minutes(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("user_id").alias("key_id"), F.col("ts").cast("timestamp").alias("called_at"))
    limits = t.events.select(F.col("user_id").alias("key_id"), F.lit(1).alias("rate_limit_rpm")).distinct()
    out, _, offsets = folders(t, "rate")
    start = lambda s: ST.write_batches(ST.calls_per_minute(s, limits), out, offsets, "update")
    rows = arrive(t, calls, "called_at", DAYS, start, out)
    return rows.groupBy("key_id", F.unix_micros("minute").alias("minute")).agg(F.max("n").alias("n"))


@query(
    "burst_stream",
    "SELECT user_id, max(w) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOUR FOLLOWING) AS w FROM {events}) x GROUP BY user_id",
)
def burst_stream(t: Tables) -> DataFrame:
    """Exact to the instant, as the batch form."""
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    state = ST.BurstState(t.spark, "user_id", "ts")
    _, _, offsets = folders(t, "burst")
    arrive(t, rows, "ts", DAYS, lambda s: ST.bursts_exact(s, state, offsets), None)
    return state.most()


@query(
    "burst_stream_hours",
    "SELECT user_id, max(n) AS most FROM (SELECT user_id, w, count(*) AS n FROM (SELECT user_id, date_trunc('hour', ts) - to_hours(i) AS w FROM {events}, range(24) r(i)) a GROUP BY ALL) b GROUP BY user_id",
)
def burst_stream_hours(t: Tables) -> DataFrame:
    """Windows that start on the hour, from hours counted in Spark's own windowed state."""
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out, _, offsets = folders(t, "burst")
    start = lambda s: ST.write_batches(ST.hourly_counts(s, "user_id", "ts"), out, offsets, "update")
    found = arrive(t, rows, "ts", DAYS, start, out)
    return ST.burst_windows(found, "user_id").groupBy("user_id").agg(F.max("n").alias("most"))


@query(
    "repeat_stream",
    REPEATS,
)
def repeat_stream(t: Tables) -> DataFrame:
    runs = t.runs.select("run_id", "project_id", "goal", "status", F.col("started_at").cast("timestamp").alias("started_at"), F.col("finished_at").cast("timestamp").alias("finished_at"))
    out, state, offsets = folders(t, "repeat")
    rows = arrive(t, runs, "started_at", DAYS, lambda s: ST.run_with_state(s, ST.repeat_step(), out, state, offsets), out)
    return rows.select("run_id", "project_id", "goal")


@query("snapshot_stream", "SELECT document_id, fetch_id::VARCHAR AS snapshot_id, h AS content_hash FROM {x_changes}")
def snapshot_stream(t: Tables) -> DataFrame:
    fetched = t.fetches.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    out, _, offsets = folders(t, "changes")
    log = BucketedLog(t.spark, "latest_content", "document_id")
    rows = arrive(t, fetched, "fetched_at", DAYS, lambda s: ST.run_with_log(s, ST.change_step(), out, log, ["document_id"], offsets), out)
    return rows.select("document_id", "snapshot_id", "content_hash")


@query("event_cursor", "SELECT event_id, event_type FROM {events}")
def event_cursor(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out, _, offsets = folders(t, "events")
    return arrive(t, rows, "ts", DAYS, lambda s: ST.write_batches(s, out, offsets), out).select("event_id", "event_type")


@query("event_page", "SELECT event_id, event_type FROM {events} WHERE event_id > 150 ORDER BY event_id LIMIT 200")
def event_page(t: Tables) -> DataFrame:
    return ST.events_after(t.events, 150).select("event_id", "event_type")


@query(
    "incremental_refresh",
    f"SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_uses FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM (SELECT doc_id, {TERMS.format('text')} AS ts FROM {{documents}}) l) a GROUP BY ALL) b GROUP BY term",
)
def incremental_refresh(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("lang").alias("project_id"), "text", "n_chars")
    out, _, offsets = folders(t, "index")
    index = TextIndex(t.spark)
    arrive(t, docs, "n_chars", [800, 2000], lambda s: ST.index_refresh(s, index, "doc_id", offsets, with_grams=False), None)
    return index.uses().groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_uses"))
