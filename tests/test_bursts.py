"""Bursts: most rows of a key in any 24 hours, by batch and by stream, against counting each window."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimweave.operators.similarity import burst_share
from claimweave.streaming import jobs as ST

DAY = timedelta(hours=24)


def instants():
    rnd, start = random.Random(5), datetime(2024, 1, 10)
    rows = [(k % 3, start + timedelta(minutes=rnd.randrange(0, 5 * 1440, 30), microseconds=rnd.choice([0, 0, 1, 999_999]))) for k in range(240)]
    return rows + [(7, start), (7, start + DAY), (7, start + DAY + timedelta(microseconds=1)), (8, None)]


def brute(rows, width=DAY):
    keys = {k for k, t in rows if t}
    return {k: max(sum(1 for j, t in rows if j == k and t and s <= t <= s + width) for i, s in rows if i == k and s) for k in keys}


def test_burst_share_equals_counting(spark):
    rows = instants()
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "k int, ts timestamp").withColumn("ts", F.col("ts").cast(kind))
        assert {r.k: r.max_in_window for r in burst_share(df, ["k"], "ts").collect()} == brute(rows)
        assert {r.k: r.max_in_window for r in burst_share(df, ["k"], "ts", 1).collect()} == brute(rows, timedelta(hours=1))


def test_burst_state_equals_counting(spark):
    """Late rows too; an instant is sorted twice (in its own hour and as a window's end), not four times."""
    rows = instants()
    state = ST.BurstState(spark, "k", "ts")
    for part in (rows[60:], rows[:60]):
        state.add(spark.createDataFrame(part, "k int, ts timestamp"))
    assert {r.k: r.most for r in state.most().collect()} == brute(rows)
    plan = burst_share(spark.createDataFrame(rows, "k int, ts timestamp"), ["k"], "ts")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_windows_of_hours_from_hourly_counts(spark):
    """The stream's state has one row an hour, not one for each of the 24 windows that hold it."""
    rows = instants()
    counts = ST.hourly_counts(spark.createDataFrame(rows, "k int, ts timestamp"), "k", "ts")
    assert counts.count() == len({(k, t.replace(minute=0, microsecond=0)) for k, t in rows if t})
    got = {r.k: r.n for r in ST.burst_windows(counts, "k").groupBy("k").agg(F.max("n").alias("n")).collect()}
    hour = lambda t: t.replace(minute=0, second=0, microsecond=0)
    want = {k: max(sum(1 for j, t in rows if j == k and t and hour(s) <= t < hour(s) + DAY) for i, s in rows if i == k and s) for k in {k for k, t in rows if t}}
    assert got == want
