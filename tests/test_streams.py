"""Streams over several batches and restarts, against their batch forms."""

import datetime
import glob
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirelight.operators import sequences as Q
from quirelight.plans import timelines
from quirelight.sources.folders import shared_folder, stream_of
from quirelight.streaming import jobs, state, views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, tmp_path):
    """Puts a part of the events, in order of time, into the folder that a stream reads."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = events.orderBy("ts", "event_id").select("user_id", "event_id", "event_type", "micros").collect()
    os.makedirs(f"{tmp_path}/in")

    def put(k, of=4):
        own = rows[len(rows) * k // of : len(rows) * (k + 1) // of]
        spark.createDataFrame(own, "user_id long, event_id long, event_type string, micros long").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (made,) = glob.glob(f"{tmp_path}/part{k}/*.parquet")
        os.rename(made, f"{tmp_path}/in/{k}.parquet")

    return put, f"{tmp_path}/in"


def test_limiter_goes_on_after_a_restart(spark, parts):
    put, folder = parts
    name = f"limiter-{random.random()}"
    job = lambda: state.limited(stream_of(spark, folder, per_batch=1), "user_id", "micros", "event_id", 6 * 3600, 3, "1 hour")
    put(0)
    put(1)
    jobs.written(job(), name=name)
    put(2)
    put(3)
    found = {r.event_id: r.accepted for r in jobs.written(job(), name=name).collect()}
    batch = Q.limited(timelines.events(spark, SF).withColumnRenamed("at", "micros"), "user_id", "micros", "event_id", 6 * 3600, 3)
    assert found == {r.event_id: r.accepted for r in batch.collect()}
    assert len(glob.glob(f"{shared_folder(spark, name).removeprefix('file:')}/out/batch=*")) >= 4


def leases(rows, seconds, most, end):
    out, held = [], defaultdict(lambda: [None, None, 0, False])
    for job, event, what, at in rows:
        s, who = held[job], event % 3
        if s[1] is not None and s[1] < at:
            out.append((job, None, s[1], "expired"))
            s[0], s[1], s[3] = None, None, s[3] or s[2] >= most
        if what == "claim":
            told = "failed" if s[3] else "taken" if s[1] is not None else "claimed"
            if told == "claimed":
                s[0], s[1], s[2] = who, at + seconds * 1_000_000, s[2] + 1
        elif what == "heartbeat":
            told = "unknown" if s[1] is None else "ok" if s[0] == who else "lost"
            s[1] = at + seconds * 1_000_000 if told == "ok" else s[1]
        else:
            told = "done" if s[1] is not None and s[0] == who else "lost"
            if told == "done":
                s[:3] = None, None, 0
        out.append((job, event, at, told))
    return out + [(job, None, s[1], "expired") for job, s in held.items() if s[1] is not None and s[1] < end]


def test_leases_end_by_timers_and_after_a_restart(spark, parts):
    put, folder = parts
    name = f"leases-{random.random()}"
    what = F.when(F.col("event_type").isin("signup", "purchase"), "claim").when(F.col("event_type") == "error", "finish").otherwise("heartbeat")

    def job():
        rows = stream_of(spark, folder, per_batch=1).select(F.col("user_id").alias("job"), "event_id", "micros", (F.col("event_id") % 3).alias("who"), what.alias("what"))
        return state.leased(rows, "job", "who", "what", "micros", "event_id", 36 * 3600, 2, "0 seconds")

    for k in (0, 1, 2):
        put(k)
    jobs.written(job(), name=name)
    put(3)
    found = jobs.written(job(), name=name).collect()
    kinds = {"signup": "claim", "purchase": "claim", "error": "finish", "view": "heartbeat", "click": "heartbeat"}
    rows = [(r.user_id, r.event_id, kinds[r.event_type], r.at) for r in timelines.events(spark, SF).withColumn("at", F.col("at")).orderBy("at", "event_id").join(spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("event_type").alias("kind")), "event_id").withColumn("event_type", F.col("kind")).orderBy("at", "event_id").collect()]
    expected = leases(rows, 36 * 3600, 2, max(r[3] for r in rows))
    told = lambda rows: sorted((r[0], r[1] if r[1] is not None else -1, r[2] // 1000, r[3]) for r in rows)
    assert told([tuple(r) for r in found]) == told(expected)
    assert {"claimed", "taken", "failed", "ok", "lost", "unknown", "done", "expired"} == {r[3] for r in expected}


def test_views_renew_only_what_changes_touch(spark, tmp_path):
    source, feed, name = f"{tmp_path}/articles", f"{tmp_path}/feed", f"view-{random.random()}"
    save = lambda rows: spark.createDataFrame(rows, "article long, issue int, text string").write.mode("overwrite").parquet(source)

    def change(k, *articles):
        spark.createDataFrame([(a, i) for a, i in articles], "article long, issue int").coalesce(1).write.mode("append").parquet(feed)

    def run():
        rebuild = lambda keys: spark.read.parquet(source).join(keys, "issue", "left_semi").groupBy("issue", "article").agg(F.max("text").alias("text"))
        return {tuple(r) for r in views.maintained(stream_of(spark, feed), "issue", rebuild, name).select("issue", "article", "text").collect()}

    files = lambda issue: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{shared_folder(spark, name).removeprefix('file:')}/view/issue={issue}/*.parquet")}
    save([(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d")])
    change(0, (1, 1), (3, 2), (4, 3))
    assert run() == {(1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d")}
    before = {i: files(i) for i in (1, 2, 3)}
    save([(1, 1, "a2"), (2, 1, "b"), (3, 2, "c"), (5, 4, "e")])
    change(1, (1, 1), (4, 3), (5, 4), (1, 1))
    assert run() == {(1, 1, "a2"), (1, 2, "b"), (2, 3, "c"), (4, 5, "e")}
    assert files(2) == before[2] and files(1) != before[1]
    change(2, (1, 1))  # delivered again
    assert run() == {(1, 1, "a2"), (1, 2, "b"), (2, 3, "c"), (4, 5, "e")}


def test_sums_do_not_depend_on_how_rows_come_in(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(0, at, 1, 0.1), (1, at, 1, 0.2), (2, at, 1, 0.3), (3, at, 1, 1e16), (4, at, 1, -1e16), (5, at, 1, 0.5), (6, at, 2, None)]
    expected = {1: 0.0, 2: None}
    for *_, value in rows[:-1]:
        expected[1] += value
    os.makedirs(f"{tmp_path}/in")
    for k in (3, 1, 0, 5, 4, 2, 6):
        spark.createDataFrame([rows[k]], "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (made,) = glob.glob(f"{tmp_path}/part{k}/*.parquet")
        os.rename(made, f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 - k, 1_700_000_000 - k))  # streams take the oldest file first
    for per_batch in (1, 1000):
        found = jobs.usage(stream_of(spark, f"{tmp_path}/in", per_batch), "ts", ["user_id"], "value", "1 day", "40 days", ["event_id"])
        assert {r.user_id: (r.n, r.total) for r in found.collect()} == {1: (6, expected[1]), 2: (1, None)}
