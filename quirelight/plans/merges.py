"""Idempotent merges, replacements and renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.operators import relational as R
from quirelight.plans.registry import query, read


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as they stand, and a later delivery: every third one dearer, and new keys."""
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).alias("version"))
    third = old.filter("o_orderkey % 3 = 0")
    fresh = third.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 10_000_000).otherwise(0)).alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("version"))
    return old, fresh


_OLD = "SELECT o_orderkey, o_custkey, o_totalprice, 1 AS version FROM orders"
_NEW = "SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 2 AS version FROM orders WHERE o_orderkey % 3 = 0"


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each key."""
    old, fresh = _orders(spark, sf_dir)
    return R.upsert(old, fresh, ["o_orderkey"], "version")


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def merge_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of new keys only: a replay changes nothing."""
    old, fresh = _orders(spark, sf_dir)
    return R.insert_missing(old, fresh, ["o_orderkey"])


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.version = 2 THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def merge_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables by key; the delivery's price counts where it has one."""
    old, fresh = _orders(spark, sf_dir)
    return R.overlay(old.select("o_orderkey", "o_totalprice"), fresh.select("o_orderkey", "o_totalprice"), ["o_orderkey"], ["o_totalprice"])


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IS DISTINCT FROM 'src1' UNION ALL SELECT doc_id, 'src1', CAST(length(text) AS BIGINT) FROM documents WHERE source = 'src2'")
def replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source are replaced, all others stay."""
    docs = read(spark, sf_dir, "documents")
    fresh = docs.filter("source = 'src2'").select("doc_id", F.lit("src1").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return R.replace_by_provenance(docs.select("doc_id", "source", "n_chars"), fresh, "source", "src1")


@query("SELECT conv_id, turn + CASE WHEN turn >= 1 AND conv_id % 2 = 0 THEN 1 + conv_id % 3 ELSE 0 END AS turn, role FROM conversations")
def open_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from the second on move up in every other conversation, to make room."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    gaps = turns.select("conv_id").distinct().filter("conv_id % 2 = 0").select("conv_id", F.lit(1).alias("at"), (1 + F.col("conv_id") % 3).alias("n"))
    return R.open_gap(turns, "conv_id", "turn", gaps)


@query(
    """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (FROM gone)
    UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM gone)"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders go with all their lines; what is left is counted."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    left = R.cascade_delete(orders, {"lines": lines}, orders.filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")
    return left[""].agg(F.lit("orders").alias("name"), F.count("*").alias("n")).unionByName(left["lines"].agg(F.lit("lines").alias("name"), F.count("*").alias("n")))


@query(
    f"""WITH a AS ({_OLD}), b AS ({_NEW}), held AS (SELECT * FROM a WHERE o_totalprice > 250000), u AS (SELECT * FROM held UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM held))
    SELECT o_custkey, o_orderkey, version, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS "order" FROM u"""
)
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an editor holds stays, all else comes from the delivery; places are numbered anew."""
    old, fresh = _orders(spark, sf_dir)
    merged = R.three_way_merge(old, fresh, ["o_orderkey"], F.col("o_totalprice") > 250000)
    return R.renumber(merged, "o_custkey", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "version", "order")


@query("SELECT l_orderkey, l_partkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS place FROM lineitem")
def renumbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order numbered without gaps."""
    found = R.renumber(read(spark, sf_dir, "lineitem"), "l_orderkey", [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "place")
    return found.select("l_orderkey", "l_partkey", "l_linenumber", "place")
