"""Access, coverage, timelines and catalogue queries on orders as grants and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.operators import relational as R
from quirelight.plans.registry import query, read


def _day() -> Column:
    """The day on which access is asked for."""
    return F.lit("1998-06-01").cast("timestamp_ntz")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), n_name, c_name) AS label, (c_mktsegment = 'BUILDING') AS fell_back FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def display_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of a chain that is there."""
    nations = read(spark, sf_dir, "nation")
    joined = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    label = F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name", "c_name")
    return joined.select("c_custkey", label.alias("label"), (F.col("c_mktsegment") == "BUILDING").alias("fell_back"))


@query(
    """SELECT c_custkey, bool_or(o_orderkey IS NOT NULL AND o_orderdate <= TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-01' < o_orderdate + INTERVAL 90 DAY) AS has_access,
    count(*) FILTER (o_orderdate <= TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-01' < o_orderdate + INTERVAL 90 DAY AND o_orderstatus != 'F') AS n_strict
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def customer_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has a grant that is valid on a day, and how many that are not revoked."""
    end = F.col("o_orderdate") + F.make_dt_interval(F.lit(90))
    revoked = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    strict = R.strictly_valid_at(F.col("o_orderdate"), end, revoked, _day())
    valid = F.col("o_orderkey").isNotNull() & R.valid_at(F.col("o_orderdate"), end, _day())
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.bool_or(valid).alias("has_access"), F.count_if(strict).alias("n_strict"))


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')
    AND o_orderdate + INTERVAL 30 DAY + INTERVAL 3 DAY > TIMESTAMP '1998-06-01' AND o_orderdate <= TIMESTAMP '1998-06-01'"""
)
def active_with_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running subscriptions: a status that counts, and at most three days past the paid month."""
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") <= _day())
    paid_until = F.col("o_orderdate") + F.make_dt_interval(F.lit(30))
    never = F.lit(None).cast("timestamp_ntz")
    return orders.filter(R.active_with_grace(F.col("o_orderstatus"), never, paid_until, _day(), ("O", "P"))).select("o_orderkey", "o_custkey")


@query(
    """WITH s AS (SELECT o_orderkey AS sub, o_custkey AS key, o_orderdate AS started, o_orderdate + INTERVAL 200 DAY AS until FROM orders WHERE o_orderstatus = 'O'),
    i AS (SELECT o_orderkey AS item, o_custkey AS key, o_orderdate AS shown FROM orders WHERE o_orderstatus != 'O')
    SELECT sub, item FROM s JOIN i USING (key) WHERE shown BETWEEN started AND until
    UNION
    SELECT sub, arg_max(item, (shown, item)) FROM s JOIN i USING (key) WHERE shown < started GROUP BY sub"""
)
def covered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscription covers: what appears while it runs, and what was current when it began."""
    orders = read(spark, sf_dir, "orders")
    until = F.col("o_orderdate") + F.make_dt_interval(F.lit(200))
    subs = orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("sub"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("started"), until.alias("until"))
    date = F.col("o_orderdate")
    items = orders.filter("o_orderstatus != 'O'").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("key"), date.alias("at"), date.alias("shown"))
    return R.covered_items(subs, items, "key")


@query(
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value AS seen FROM events WHERE event_type = 'view')
    SELECT event_id, l.user_id, l.ts, seen FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def last_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the value of the newest view at or before each purchase of a user."""
    events = read(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return R.as_of(bought, seen, "user_id", "ts", "seen")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def customers_without_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join: customers without an order in process."""
    orders = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing_pairs(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def returned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join: parts that came back in large lots."""
    back = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_name").join(back, "p_partkey", "left_semi")


@query(
    """SELECT n_nationkey, segment FROM nation, (VALUES ('AUTOMOBILE'), ('BUILDING'), ('SPACE')) v(segment)
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = segment)"""
)
def missing_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of nation and a stated list of segments that no customer has."""
    stated = F.explode(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "SPACE"))))
    wanted = read(spark, sf_dir, "nation").select("n_nationkey", stated.alias("segment"))
    there = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).distinct()
    return R.missing_pairs(wanted, there, ["n_nationkey", "segment"])


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1"""
)
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer."""
    newest = R.latest_per(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query(
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_done,
    count(DISTINCT o_custkey) AS n_customers, round(avg(o_totalprice), 2) AS mean_price, min(o_orderdate) AS first_at FROM orders GROUP BY o_orderpriority"""
)
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts by status for each queue."""
    status = F.col("o_orderstatus")
    return (
        read(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(
            F.count("*").alias("n"),
            F.count_if(status == "O").alias("n_open"),
            F.count_if(status == "F").alias("n_done"),
            F.count_distinct("o_custkey").alias("n_customers"),
            F.round(F.avg("o_totalprice"), 2).alias("mean_price"),
            F.min("o_orderdate").alias("first_at"),
        )
    )


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p,
    CAST(round(sum(o_totalprice)) AS BIGINT) AS revenue FROM orders GROUP BY ALL"""
)
def series_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years by status as a matrix, with the revenue."""
    by = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"))
    counts = [F.count_if(F.col("o_orderstatus") == s.upper()).alias(s) for s in "fop"]
    return by.agg(*counts, F.round(F.sum("o_totalprice")).cast("long").alias("revenue"))


@query(
    """SELECT r_name, n_name, count(*) AS n_orders, CAST(round(sum(o_totalprice)) AS BIGINT) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through customer and nation up to the region; orders are summed by customer before they are joined."""
    spent = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price"))
    joined = spent.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("price")).cast("long").alias("revenue"))


@query(
    """SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 2"""
)
def first_two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most urgent orders of each customer, the dearer one first."""
    order = [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]
    found = R.first_n_per(read(spark, sf_dir, "orders"), ["o_custkey"], order, 2, with_more=False)
    return found.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query(
    """WITH RECURSIVE p AS (SELECT o_custkey AS k, o_orderkey AS t, CAST(o_orderdate AS DATE) AS created, CAST(1 + o_orderkey % 12 AS INTEGER) AS months,
      row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n FROM orders),
    m AS (SELECT k, t, n, created AS starts, CAST(CAST(date_trunc('month', created) AS DATE) + to_months(months) AS DATE) + CAST(day(created) - 1 AS INTEGER) AS ends FROM p WHERE n = 1
      UNION ALL
      SELECT k, t, n, starts, CAST(CAST(date_trunc('month', starts) AS DATE) + to_months(months) AS DATE) + CAST(day(starts) - 1 AS INTEGER) FROM (
        SELECT p.k, p.t, p.n, p.months, greatest(p.created, m.ends) AS starts FROM m JOIN p ON p.k = m.k AND p.n = m.n + 1))
    SELECT k AS o_custkey, t AS o_orderkey, starts, ends FROM m"""
)
def subscription_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a customer as one chain: each begins when the one before has ended, and runs for calendar months."""
    bought = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (1 + F.col("o_orderkey") % 12).alias("months"))
    return R.chained_periods(bought, ["o_custkey"], "o_orderdate", "months", "o_orderkey")
