"""Structured Streaming forms, run over what is there and compared with their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.plans.registry import query, read
from quirelight.sources.folders import stream_of
from quirelight.streaming import jobs, state, views


@query("SELECT user_id, make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS day, count(*) AS n, CAST(round(sum(value)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of a user by day, kept up to date as a stream comes in."""
    found = jobs.usage(stream_of(spark, f"{sf_dir}/events.parquet"), "ts", ["user_id"], "value", "1 day", "40 days", ["event_id"])
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("total").cast("long").alias("total"))


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def stream_first_of_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user, type and properties once, whatever is delivered again within the watermark."""
    return jobs.once(stream_of(spark, f"{sf_dir}/events.parquet"), "ts", ["user_id", "event_type", "props"], "40 days").select("user_id", "event_type", "props")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, upserted batch by batch."""
    return jobs.latest(stream_of(spark, f"{sf_dir}/events.parquet"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("SELECT event_id, c_custkey, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a stream, joined with the table of customers."""
    bought = stream_of(spark, f"{sf_dir}/events.parquet").filter("event_type = 'purchase'")
    joined = bought.join(read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return jobs.written(joined.select("event_id", "c_custkey", "c_mktsegment"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds, as one batch, so that each user's come in order."""
    events = stream_of(spark, f"{sf_dir}/events.parquet")
    return events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    walk AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS times, false AS accepted FROM e
      UNION ALL SELECT user_id, k, event_id, CASE WHEN len(kept) < 3 THEN list_append(kept, moment) ELSE kept END, len(kept) < 3 FROM
      (SELECT e.*, list_filter(w.times, lambda t: e.moment - t <= 21600000000) AS kept FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
    SELECT event_id, user_id, accepted FROM walk WHERE k > 0"""
)
def stream_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a stream that a limiter of three accepted ones in six hours lets through. STR-09, WIN-19"""
    found = state.limited(_numbered(spark, sf_dir), "user_id", "micros", "event_id", 6 * 3600, 3, "1 hour")
    return jobs.written(found).select("event_id", "user_id", "accepted")


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS job, event_id, epoch_us(ts) AS moment, event_id % 3 AS who, CASE WHEN event_type IN ('signup', 'purchase') THEN 'claim' WHEN event_type = 'error' THEN 'finish' ELSE 'heartbeat' END AS what, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    walk AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS moment, '' AS outcome, CAST(NULL AS BIGINT) AS ran_out, CAST(NULL AS BIGINT) AS holder, CAST(NULL AS BIGINT) AS until, 0 AS tries, false AS failed FROM e
      UNION ALL SELECT job, k, event_id, moment, outcome, ran_out, CASE outcome WHEN 'claimed' THEN who WHEN 'done' THEN NULL ELSE holder END, CASE WHEN outcome IN ('claimed', 'ok') THEN moment + 172800000000 WHEN outcome = 'done' THEN NULL ELSE until END,
        CASE outcome WHEN 'claimed' THEN tries + 1 WHEN 'done' THEN 0 ELSE tries END, failed FROM
      (SELECT *, CASE what WHEN 'claim' THEN CASE WHEN failed THEN 'failed' WHEN until IS NOT NULL THEN 'taken' ELSE 'claimed' END WHEN 'heartbeat' THEN CASE WHEN until IS NULL THEN 'unknown' WHEN holder = who THEN 'ok' ELSE 'lost' END ELSE CASE WHEN holder = who THEN 'done' ELSE 'lost' END END AS outcome FROM
      (SELECT e.*, CASE WHEN w.until < e.moment THEN w.until END AS ran_out, CASE WHEN w.until >= e.moment THEN w.holder END AS holder, CASE WHEN w.until >= e.moment THEN w.until END AS until, w.tries, w.failed OR coalesce(w.until < e.moment, false) AND w.tries >= 3 AS failed FROM walk w JOIN e ON e.job = w.job AND e.k = w.k + 1)))
    SELECT job, event_id, moment, outcome FROM walk WHERE k > 0 UNION ALL SELECT job, NULL, ran_out, 'expired' FROM walk WHERE ran_out IS NOT NULL
    UNION ALL SELECT job, NULL, until, 'expired' FROM (SELECT * FROM walk QUALIFY k = max(k) OVER (PARTITION BY job)) WHERE until < (SELECT max(epoch_us(ts)) - 3600000000 FROM events)"""
)
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of claims, heartbeats and results of a stream of jobs, with leases of two days that timers end. STR-06, STR-07, STR-08"""
    what = F.when(F.col("event_type").isin("signup", "purchase"), "claim").when(F.col("event_type") == "error", "finish").otherwise("heartbeat")
    rows = _numbered(spark, sf_dir).select(F.col("user_id").alias("job"), "event_id", "micros", (F.col("event_id") % 3).alias("who"), what.alias("what"))
    return jobs.written(state.leased(rows, "job", "who", "what", "micros", "event_id", 2 * 86400, 3, "1 hour"))


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type = 'purchase' AS ok, event_type != 'signup' AS again, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    walk AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 0 AS attempts, 'open' AS status, CAST(NULL AS BIGINT) AS wait FROM e
      UNION ALL SELECT e.user_id, e.k, e.event_id, attempts + 1, CASE WHEN ok THEN 'ordered' WHEN again AND attempts < 3 THEN 'open' ELSE 'failed' END, CASE WHEN NOT ok AND again THEN [60000, 300000, 3600000][attempts + 1] END FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1 WHERE w.status = 'open')
    SELECT user_id, event_id, attempts, status, wait FROM walk WHERE k > 0"""
)
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a stream that are tried again after growing waits, until one succeeds or the waits are used up. STR-05, DAT-06"""
    rows = _numbered(spark, sf_dir).select("user_id", "event_id", "micros", (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") != "signup").alias("again"))
    return jobs.written(state.retried(rows, "user_id", "ok", "again", "micros", "event_id", [60_000, 300_000, 3_600_000], "1 hour"))


@query(
    """WITH t AS (SELECT event_id // 2 AS ticket, event_id, ts, min(ts) OVER (PARTITION BY event_id // 2) - to_seconds(300 + event_id // 2 % 400) AS issued FROM events)
    SELECT ticket, arg_min(event_id, (ts, event_id)) AS event_id FROM t WHERE epoch_us(ts) - epoch_us(issued) <= 600000000 GROUP BY ticket"""
)
def stream_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of a stream at their first use, if they are not over ten minutes old by then; later uses are refused. STR-18"""
    events = read(spark, sf_dir, "events")
    first = events.groupBy(F.floor(F.col("event_id") / 2).alias("ticket")).agg((F.min("ts") - F.make_dt_interval(secs=(F.lit(300) + F.floor(F.min("event_id") / 2) % 400).cast("decimal(18,6)"))).alias("issued"))
    uses = stream_of(spark, f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 2).alias("ticket"), "event_id", "ts").join(first, "ticket")
    return jobs.written(state.first_uses(uses, ["ticket"], "issued", "ts", 600)).select("ticket", "event_id")


@query(
    """SELECT c_nationkey AS issue, c_custkey AS article, count(*) AS n_views, max(ts) AS last_view FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' AND c_nationkey % 4 != 0 GROUP BY ALL"""
)
def stream_search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers find of each issue, kept up to date from a stream of changes: an article's change renews its issue's part of the view, and changes of unpublished issues none. STR-15, STR-16, STR-17, SNK-06"""
    articles = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article"), F.col("c_nationkey").alias("issue"))
    seen = read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("article"), "ts")

    def rebuild(issues: DataFrame) -> DataFrame:
        own = articles.join(F.broadcast(issues), "issue", "left_semi")  # as many rows as there are issues in a batch
        return seen.join(own, "article").groupBy("issue", "article").agg(F.count("*").alias("n_views"), F.max("ts").alias("last_view"))

    changes = stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("article")).join(articles, "article").filter("issue % 4 != 0")
    return views.maintained(changes, "issue", rebuild).select("issue", "article", "n_views", "last_view")
