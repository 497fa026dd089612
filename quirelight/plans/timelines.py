"""Sessions, runs, shares, limits and ledgers on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.operators import sequences as S
from quirelight.plans.registry import query, read


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as a number of microseconds too."""
    return read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    """WITH e AS (SELECT *, epoch_us(ts) AS us FROM events),
    f AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 7200000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM f)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM g GROUP BY user_id, island"""
)
def reader_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: stretches of events without a gap of over two hours."""
    marked = S.gap_islands(events(spark, sf_dir), ["user_id"], "at", "event_id", 7_200_000_000)
    return marked.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(
    """WITH f AS (SELECT *, CASE WHEN value < lag(value) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
    SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(value) AS lowest, max(value) AS highest FROM g GROUP BY user_id, run HAVING count(*) >= 3"""
)
def rising_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of three events or more whose values do not fall."""
    marked = S.rising_runs(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    found = marked.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return found.filter("n >= 3")


@query(
    """SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders"""
)
def spent_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of all that a customer spends is spent after each order."""
    found = S.cumulative_share(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return found.select("o_orderkey", "o_custkey", F.round("share", 6).alias("share"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS attempts FROM events")
def attempts_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user did the same within the last six hours, this time included."""
    found = S.attempts_before(read(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("ts").cast("timestamp"), 6 * 3600)
    return found.select("event_id", "attempts")


@query()
def accepted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact limiter: at most three accepted events of a user in six hours; refused ones leave no trace."""
    rows = events(spark, sf_dir).select("user_id", "at", "event_id")
    return S.limited(rows, "user_id", "at", "event_id", 6 * 3600, 3).select("event_id", "user_id", "accepted")


@query("SELECT user_id, make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def usage_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of a user in tumbling windows of an hour."""
    hour = F.window("ts", "1 hour")["start"].alias("hour")
    return read(spark, sf_dir, "events").groupBy("user_id", hour).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 5 AS evicted FROM events")
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the newest five sessions of a user are evicted."""
    found = S.keep_newest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return found.select("event_id", "user_id", "evicted")


@query("SELECT event_id, user_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_of_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each user, type and properties: replays of an event change nothing."""
    found = S.first_per_ledger(read(spark, sf_dir, "events"), ["user_id", "event_type", "props"], [F.col("ts"), F.col("event_id")])
    return found.select("event_id", "user_id", "event_type", "props")


@query(
    """WITH n AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')
    SELECT event_id, attempt AS attempt, CASE WHEN attempt <= 4 THEN ts + to_seconds([60, 300, 3600, 86400][attempt]) END AS retry_at, least(60.0, 2.0 * pow(2, least(attempt, 30) - 1)) AS wait_s FROM n"""
)
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a failed event of a user is tried again: fixed steps, none after the last; and a doubling wait up to a minute."""
    from pyspark.sql.window import Window

    failed = read(spark, sf_dir, "events").filter("event_type = 'error'")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = F.array(*map(F.lit, (60, 300, 3600, 86400)))
    step = F.get(steps, F.col("attempt").cast("int") - 1)
    numbered = failed.withColumn("attempt", attempt.cast("long"))
    wait = F.least(F.lit(60.0), 2.0 * F.pow(F.lit(2.0), F.least(F.col("attempt"), F.lit(30)) - 1))
    return numbered.select("event_id", "attempt", (F.col("ts") + F.make_dt_interval(secs=step)).alias("retry_at"), wait.alias("wait_s"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS digit FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields out of JSON properties."""
    found = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return found.filter("k >= 50").withColumn("digit", F.col("k") % 10)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS digit FROM events")
def all_event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields out of the JSON properties of every event."""
    found = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return found.withColumn("digit", F.col("k") % 10)


@query(
    """SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) FILTER (role = 'user') AS n_user, CAST(max(length(text)) AS INTEGER) AS longest FROM conversations GROUP BY conv_id"""
)
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks in a conversation, in order of the turns."""
    turns = read(spark, sf_dir, "conversations")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), told.alias("roles"), F.count_if(F.col("role") == "user").alias("n_user"), F.max(F.length("text")).alias("longest"))
