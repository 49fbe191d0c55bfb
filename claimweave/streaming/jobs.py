"""Streaming forms of the incremental operators.

Windowed counts use watermarks and Spark's own state. Jobs that compare a row with the previous one of
its key run the batch operator on every micro-batch: a hot key is then split like in batch, instead of
being walked row by row in one stateful task. The change feed and the exact bursts append what a batch
changed to a bucketed log and read only the keys it touches; the repeat guard's state expires and is
rewritten. Outputs and state carry the batch number, so a replayed batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.checkpoints import cut
from claimweave.operators.bucketed import BucketedLog
from claimweave.operators.merge import repeat_runs, snapshot_changes
from claimweave.operators.search_index import TextIndex
from claimweave.operators.similarity import micros, most_from_each_hour, whole

DEFAULT_RPM, UNKNOWN_RPM = 120, 20
Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that arrive in a folder, oldest first; without a number, all that are new at once."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def calls_per_minute(calls: DataFrame, limits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Minutes in which a key went over its limit; rows later than the watermark are dropped.

    ``limits``: key_id, rate_limit_rpm (NULL means the default); keys not listed get the low limit.
    """
    counted = calls.withWatermark("called_at", late).groupBy(F.window("called_at", "1 minute"), "key_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    known = limits.select("key_id", F.coalesce("rate_limit_rpm", F.lit(DEFAULT_RPM)).alias("rpm"))
    j = counted.join(known, "key_id", "left").withColumn("rpm", F.coalesce("rpm", F.lit(UNKNOWN_RPM)))
    return j.filter(F.col("n") > F.col("rpm")).select("key_id", F.col("window.start").alias("minute"), "n", "rpm")


def hourly_counts(reviews: DataFrame, key: str, ts: str, late: str = "24 hours") -> DataFrame:
    """Rows per key and hour, kept in Spark's windowed state; ``burst_windows`` makes longer windows of them.

    One state row an hour serves all windows that hold it, where sliding windows keep one each. A row
    counts as long as any 24-hour window that holds it is not older than ``late``.
    """
    kept = f"{late} 24 hours"
    return reviews.withWatermark(ts, kept).groupBy(F.window(ts, "1 hour"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("window.start").alias("hour"), "n"
    )


def burst_windows(counts: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Rows per key in the window that starts on each hour in which it has rows, from the updates of ``hourly_counts``.

    A window that starts on another hour holds no more than the one that starts on its first row's hour.
    """
    newest = counts.groupBy(key, "hour").agg(F.max("n").alias("n"))
    ahead = W.partitionBy(key).orderBy(F.unix_seconds("hour")).rangeBetween(W.currentRow, (hours - 1) * 3600)
    return newest.select(key, F.col("hour").alias("starts"), F.sum("n").over(ahead).alias("n"))


class BurstState:
    """Most rows of a key inside any window of some hours, exact to the instant, kept up to date batch by batch.

    New rows can only change windows that start in their own hour or the hours a window reaches back. Those
    hours' days are counted anew from the stored instants of the key; everything else stays as it is.
    """

    def __init__(self, spark: SparkSession, key: str, ts: str, hours: int = 24, buckets: int | None = None):
        self.key, self.ts, self.hours = key, ts, hours
        self.points, self.days = (BucketedLog(spark, name, key, buckets) for name in ("burst_points", "burst_days"))

    def add(self, rows: DataFrame, batch: str | None = None) -> None:
        rows = cut(rows.select(self.key, self.ts).filter(F.col(self.ts).isNotNull()))
        self.points.append(rows, batch)
        reach, day = -(-self.hours // 24), whole(micros(rows, self.ts), 24 * 3_600_000_000)
        on = lambda df, back, sign: df.select(self.key, F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_back"), "_day").select(self.key, (F.col("_day") + sign * F.col("_back")).alias("_day")).distinct()
        touched = cut(on(rows.select(self.key, day.alias("_day")).distinct(), reach, -1))
        known = self.points.rows().withColumn("_day", day).join(on(touched, reach, 1), [self.key, "_day"], "left_semi")
        hourly = most_from_each_hour(known, [self.key], self.ts, self.hours)
        daily = hourly.groupBy(self.key, whole(F.col("hour"), 24).alias("_day")).agg(F.max("most").alias("max_in_window"))
        self.days.append(daily.join(touched, [self.key, "_day"], "left_semi"), batch)

    def most(self) -> DataFrame:
        """(key, most)."""
        return self.days.newest([self.key, "_day"]).groupBy(self.key).agg(F.max("max_in_window").alias("most"))


def bursts_exact(stream: DataFrame, state: BurstState, checkpoint: str) -> StreamingQuery:
    """Keep a burst state up to date; late rows count whenever they come."""
    save = lambda batch, number: state.add(batch, str(number))
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write every micro-batch to its own folder and stop when the input is used up."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_with_state(stream: DataFrame, step: Step, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator per micro-batch against the state table the previous batch left."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{state}/after={number - 1}") if number > 0 else None
        result, after = step(batch, before)
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")
        after.write.mode("overwrite").parquet(f"{state}/after={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_with_log(stream: DataFrame, step: Step, out: str, log: BucketedLog, keys: list[str], checkpoint: str) -> StreamingQuery:
    """As run_with_state, the state being the newest row of each key in a log: a batch reads and writes only its own keys."""

    def save(batch: DataFrame, number: int) -> None:
        result, after = step(batch, log.newest(keys, batch.select(*keys).distinct(), without=str(number)))
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")
        log.append(after, str(number))

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repeat_step(minutes: int = 30) -> Step:
    """Runs repeated within some minutes after one was done; the state is what was done shortly before the newest start.

    Batches follow each other by starting time; a finishing time that no later start can reach has expired.
    """

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        found = repeat_runs(batch, minutes, before)
        done = batch.filter((F.col("status") == "done") & F.col("finished_at").isNotNull()).select("project_id", "goal", "finished_at", "started_at")
        if before is not None:
            done = done.unionByName(before)
        newest = batch.agg(F.max("started_at").alias("newest"))
        kept = done.crossJoin(newest).filter(F.col("newest").isNull() | (F.col("finished_at") >= F.col("newest") - F.make_dt_interval(mins=F.lit(minutes))))
        return found.select("run_id", "project_id", "goal"), kept.drop("newest").distinct()

    return step


def change_step() -> Step:
    """Fetches that changed a document; the state is the latest content of every document."""

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        changed = snapshot_changes(batch, before).select(
            "document_id", "fetched_at", F.col("fetch_id").alias("snapshot_id"), "content_hash"
        )
        rows = changed if before is None else changed.unionByName(before)
        newest = rows.groupBy("document_id").agg(F.max(F.struct("fetched_at", "snapshot_id", "content_hash")).alias("s"))
        return changed, newest.select("document_id", "s.fetched_at", "s.snapshot_id", "s.content_hash")

    return step


def index_refresh(stream: DataFrame, index: TextIndex, item: str, checkpoint: str, text: str = "text", with_grams: bool = True) -> StreamingQuery:
    """Append new texts to the index that searches read; a replayed batch counts once. Without grams it answers by terms only."""

    def save(batch: DataFrame, number: int) -> None:
        index.append(batch.withColumn("claim_id", F.col(item)), item, text, with_grams, batch=str(number))

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_after(events: DataFrame, cursor: int, n: int = 200, order: str = "event_id") -> DataFrame:
    """Next page of an append-only log after a cursor."""
    return events.filter(F.col(order) > cursor).orderBy(order).limit(n)
