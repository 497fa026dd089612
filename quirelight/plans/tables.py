"""Tables of cells, changes to ordered lists, and writes of whole parents: order lines as cells and articles, events as sessions.

Each query's docstring ends with the survey rows that it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.operators import relational as R
from quirelight.plans.registry import query, read

_LINE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their place in the order."""
    return R.renumber(_by_order(spark, sf_dir), "l_orderkey", _ORDER, "place")


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]
#: Order lines that a task sorts, on average.
LINES_A_TASK = 1_000_000


def _by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, an order's in one partition; there are more partitions where there are more lines, so what a task sorts does not grow.  The count is read from the files' footers."""
    lines = read(spark, sf_dir, "lineitem")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_A_TASK))
    return lines.repartition(n, "l_orderkey")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, rows): an order's lines as rows of three cells; a cell has a text, a span and whether it is a head."""
    first = F.col("place") == 1
    cell = lambda text, span: F.struct(text.alias("text"), span.cast("int").alias("span"), first.alias("head"))
    cells = F.array(cell(F.col("l_returnflag"), F.lit(1)), cell(F.when(first, F.lit("Zahl")).otherwise(F.col("l_quantity").cast("int").cast("string")), F.lit(1)), cell(F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.col("l_partkey").cast("string")), F.lit(1) + (F.col("l_orderkey") % 9 == 0).cast("int")))
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("table")).agg(F.array_sort(F.collect_list(F.struct("place", cells.alias("cells")))).alias("rows"))
    return rows.select("table", F.transform("rows", lambda r: r["cells"]).alias("rows"))


@query(
    f"""WITH l AS (SELECT *, {_LINE} AS place FROM lineitem), c AS (SELECT l_orderkey, place, l_returnflag AS a, CASE WHEN place = 1 THEN 'Zahl' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS b, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS c, CASE WHEN l_orderkey % 9 = 0 THEN 2 ELSE 1 END AS span FROM l)
    SELECT l_orderkey AS "table", string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY place) AS text, CAST(max(2 + span) AS INTEGER) AS width, 'Tabelle: ' || max(CASE WHEN place = 1 THEN a || ', ' || b || ', ' || c END) AS name,
      CASE WHEN max(span) > 1 OR count(*) = 1 THEN '' ELSE concat_ws(',', CASE WHEN bool_and(regexp_full_match(a, '[0-9\\s.,:%/–-]+')) FILTER (place > 1 AND a != '') THEN '0' END, CASE WHEN bool_and(regexp_full_match(b, '[0-9\\s.,:%/–-]+')) FILTER (place > 1 AND b != '') THEN '1' END, CASE WHEN bool_and(regexp_full_match(c, '[0-9\\s.,:%/–-]+')) FILTER (place > 1 AND c != '') THEN '2' END) END AS numbers
    FROM c GROUP BY l_orderkey"""
)
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as text, its width with spans, its name from the head, and the columns of numbers below the head (none where cells span). ARR-02, ARR-04, ARR-05, ARR-06"""
    text = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: c["text"]), " | ")), "\n")
    width = F.array_max(F.transform("rows", lambda r: F.aggregate(r, F.lit(0), lambda n, c: n + c["span"])))
    head = F.filter(F.element_at("rows", 1), lambda c: c["head"])
    name = F.when(F.size(head) > 0, F.concat(F.lit("Tabelle: "), F.array_join(F.transform(head, lambda c: F.trim(c["text"])), ", "))).otherwise("Tabelle")
    spanned = F.exists("rows", lambda r: F.exists(r, lambda c: c["span"] > 1))
    below = F.slice("rows", 2, F.greatest(F.lit(0), F.size("rows") - 1))

    def of_numbers(i: Column) -> Column:
        texts = F.filter(F.transform(below, lambda r: F.trim(F.coalesce(F.get(r, i)["text"], F.lit("")))), lambda t: t != "")
        return (F.size(texts) > 0) & F.forall(texts, lambda t: F.regexp_like(t, F.lit(r"^[\d\s.,:%/–-]+$")))

    numbers = F.when(spanned, "").otherwise(F.array_join(F.filter(F.sequence(F.lit(0), width - 1), of_numbers), ","))
    return tables(spark, sf_dir).select("table", text.alias("text"), width.alias("width"), name.alias("name"), numbers.alias("numbers"))


@query(
    f"""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, {_LINE} AS place FROM lineitem), n AS (SELECT l_orderkey, 0 AS l_partkey, 3 AS place FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3)
    SELECT l_orderkey, l_partkey, CAST(CASE WHEN place > 2 THEN place + 1 ELSE place END AS INTEGER) AS place FROM l WHERE l_orderkey IN (SELECT l_orderkey FROM n)
    UNION ALL SELECT l_orderkey, l_partkey, CAST(place AS INTEGER) FROM l WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT l_orderkey, l_partkey, CAST(place AS INTEGER) FROM n"""
)
def inserted_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new element behind the second of each list of three or more; those after it move up by one. ARR-07, WIN-03"""
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_partkey", "place")
    new = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n >= 3").select("l_orderkey")
    moved = R.open_gap(lines, "l_orderkey", "place", new.select("l_orderkey", F.lit(3).alias("at"), F.lit(1).alias("n")))
    return moved.select("l_orderkey", "l_partkey", "place").unionByName(new.select("l_orderkey", F.lit(0).cast("long").alias("l_partkey"), F.lit(3).alias("place")))


@query(
    f"""WITH l AS (SELECT *, {_LINE} AS place FROM lineitem), h AS (SELECT l_orderkey, CASE WHEN place >= 3 THEN 2 ELSE 1 END AS half, place, l_suppkey FROM l)
    SELECT l_orderkey, half, CAST(count(*) AS BIGINT) AS n, CAST(min(l_suppkey) AS BIGINT) AS first_page, CAST(max(l_suppkey) AS BIGINT) AS last_page, CAST(count(DISTINCT l_suppkey) FILTER (NOT EXISTS (SELECT 1 FROM h o WHERE o.l_orderkey = h.l_orderkey AND o.half != h.half AND o.l_suppkey = h.l_suppkey)) AS BIGINT) AS own_pages FROM h GROUP BY ALL"""
)
def split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles cut before their third part: the parts, the span of pages of each half, and the pages that it has alone. ARR-12"""
    halves = _lines(spark, sf_dir).select("l_orderkey", "l_suppkey", (F.col("place") < 3).cast("int").alias("first"))
    # in numbers a page, so that no list and no second sort is needed: how many parts it has of either half
    pages = halves.groupBy("l_orderkey", "l_suppkey").agg(F.sum("first").alias("n1"), F.sum(1 - F.col("first")).alias("n2"))

    def half(k: int) -> Column:
        own, other = F.col(f"n{k}"), F.col(f"n{3 - k}")
        page = F.when(own > 0, F.col("l_suppkey"))
        alone = F.count_if((own > 0) & (other == 0) & F.col("l_suppkey").isNotNull())
        return F.struct(F.lit(k).alias("half"), F.sum(own).alias("n"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), alone.alias("own_pages"))

    made = pages.groupBy("l_orderkey").agg(half(1).alias("h1"), half(2).alias("h2"))
    return made.select("l_orderkey", F.inline(F.array("h1", "h2"))).filter("n > 0")


@query(
    f"""WITH l AS (SELECT *, {_LINE} AS place FROM lineitem), m AS (SELECT l_orderkey - l_orderkey % 2 AS article, l_orderkey % 2 AS side, place, l_partkey, l_suppkey FROM l)
    SELECT article, l_partkey, CAST(row_number() OVER (PARTITION BY article ORDER BY side, place) AS INTEGER) AS place, CAST(min(l_suppkey) OVER (PARTITION BY article) AS BIGINT) AS first_page, CAST(max(l_suppkey) OVER (PARTITION BY article) AS BIGINT) AS last_page FROM m"""
)
def merged_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring articles as one: the parts of the second behind those of the first, and the span of all pages. ARR-13"""
    side = F.col("l_orderkey") % 2
    parts = _lines(spark, sf_dir).select((F.col("l_orderkey") - side).alias("article"), side.alias("side"), F.col("place").alias("old"), "l_partkey", "l_suppkey")
    spans = parts.groupBy("article").agg(F.min("l_suppkey").alias("first_page"), F.max("l_suppkey").alias("last_page"))
    placed = R.renumber(parts, "article", [F.col("side"), F.col("old")], "place")
    return placed.join(spans, "article").select("article", "l_partkey", "place", "first_page", "last_page")


@query(
    f"""WITH l AS (SELECT *, {_LINE} AS place FROM lineitem)
    SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS INTEGER) AS place, CAST(place - 1 - (SELECT count(*) FROM l o WHERE o.l_orderkey = l.l_orderkey AND o.place < l.place AND o.l_returnflag != 'R') AS BIGINT) AS gone_before,
      l_linenumber <= 2 AS anchored FROM l WHERE l_returnflag != 'R'"""
)
def lists_without_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists after some elements are gone: those that stay in new places, which are the counts of stayers before them. SNK-20, SNK-21, WIN-04"""
    # one order for both numbers, so lines are sorted once
    span = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    stays = F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).over(span.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    kept = _by_order(spark, sf_dir).withColumns({"place": F.row_number().over(span), "new": stays}).filter("l_returnflag != 'R'")
    return kept.select("l_orderkey", "l_partkey", F.col("new").alias("place"), (F.col("place") - F.col("new")).cast("long").alias("gone_before"), (F.col("l_linenumber") <= 2).alias("anchored"))


@query(
    """WITH old AS (SELECT l_orderkey AS block, l_partkey AS product, CASE WHEN l_returnflag = 'R' THEN 'editor' ELSE 'import' END AS source FROM lineitem WHERE l_linenumber <= 3), plan AS (SELECT l_orderkey AS block, l_partkey + 1 AS product FROM lineitem WHERE l_linenumber = 4),
    blocks AS (SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F')
    SELECT DISTINCT block, product, source FROM (SELECT block, product, 'import' AS source FROM plan WHERE block IN (SELECT o_orderkey FROM blocks) UNION ALL
      SELECT block, product, source FROM old WHERE source = 'editor' AND block IN (SELECT o_orderkey FROM blocks) AND (block, product) NOT IN (SELECT (block, product) FROM plan))"""
)
def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported links replaced by a new plan; those of editors stay unless the plan has them; links of blocks that are gone go. SNK-09, SNK-08"""
    lines = read(spark, sf_dir, "lineitem")
    link = [F.col("l_orderkey").alias("block"), F.col("l_partkey").alias("product")]
    old = lines.filter("l_linenumber <= 3").select(*link, F.when(F.col("l_returnflag") == "R", "editor").otherwise("import").alias("source"))
    plan = lines.filter("l_linenumber = 4").select(link[0], (F.col("l_partkey") + 1).alias("product"))
    blocks = read(spark, sf_dir, "orders").filter("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("block"))
    kept = old.filter("source = 'editor'").join(plan, ["block", "product"], "left_anti")
    return plan.withColumn("source", F.lit("import")).unionByName(kept).join(blocks, "block", "left_semi").distinct()


@query(
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS reader, CASE WHEN c_custkey IS NULL THEN CAST(o_custkey AS VARCHAR) ELSE 'deleted' END AS address, o_totalprice
    FROM orders LEFT JOIN gone ON o_custkey = c_custkey WHERE c_custkey IS NULL OR o_orderstatus = 'F'"""
)
def anonymised_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After readers are purged: their open rows are gone, and their paid ones stay without a name. SNK-11"""
    gone = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("gone"))
    rows = read(spark, sf_dir, "orders").join(gone, "o_custkey", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    stay = rows.filter(~F.col("gone") | (F.col("o_orderstatus") == "F"))
    return stay.select("o_orderkey", F.when(~F.col("gone"), F.col("o_custkey")).alias("reader"), F.when(F.col("gone"), "deleted").otherwise(F.col("o_custkey").cast("string")).alias("address"), "o_totalprice")


@query(
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'orders' AS kind, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM gone)) AS removed, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM gone)) AS kept FROM orders
    UNION ALL SELECT 'events', count(*) FILTER (user_id IN (SELECT c_custkey FROM gone)), count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM gone)) FROM events"""
)
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table go with some readers, and how many stay. SNK-18, SNK-10"""
    gone = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.lit(True).alias("gone"))

    def counts(name: str, key: str) -> DataFrame:
        joined = read(spark, sf_dir, name).select(F.col(key).alias("key")).join(gone, "key", "left")
        return joined.agg(F.lit(name).alias("kind"), F.count("gone").alias("removed"), F.count_if(F.col("gone").isNull()).alias("kept"))

    return counts("orders", "o_custkey").unionByName(counts("events", "user_id"))


@query(
    """WITH readers AS (SELECT c_custkey FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000011')), pub AS (SELECT p_partkey FROM part WHERE p_size % 3 != 0), held AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT c_custkey, p_partkey, held.l_partkey IS NULL AS is_new FROM readers CROSS JOIN pub LEFT JOIN held ON o_custkey = c_custkey AND l_partkey = p_partkey"""
)
def all_published_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every published issue for some readers named by address, and which of these grants are new. SNK-22"""
    names = ("Customer#000000007", "Customer#000000011")  # a list of two at most: each issue is taken once for each
    readers = read(spark, sf_dir, "customer").filter(F.col("c_name").isin(*names)).select("c_custkey", "c_name")
    wanted = read(spark, sf_dir, "part").filter("p_size % 3 != 0").select("p_partkey", F.explode(F.array(*map(F.lit, names))).alias("c_name")).join(readers, "c_name")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = lines.select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("held")).distinct()
    return wanted.join(held, ["c_custkey", "p_partkey"], "left").select("c_custkey", "p_partkey", F.col("held").isNull().alias("is_new"))


@query(
    """WITH tiers AS (SELECT p_type AS tier, max(CASE WHEN p_size % 2 = 0 THEN p_retailprice END) AS home, max(CASE WHEN p_size % 50 = 49 THEN p_retailprice END) AS abroad FROM part GROUP BY p_type)
    SELECT tier, 'home' AS region, home AS price FROM tiers WHERE home IS NOT NULL UNION ALL SELECT tier, 'abroad', abroad FROM tiers WHERE abroad IS NOT NULL"""
)
def catalogue_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tier with every region that it has a price for. ARR-08"""
    price = lambda test: F.max(F.when(test, F.col("p_retailprice")))
    tiers = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("tier")).agg(price(F.col("p_size") % 2 == 0).alias("home"), price(F.col("p_size") % 50 == 49).alias("abroad"))
    variants = tiers.select("tier", F.explode(F.create_map(F.lit("home"), "home", F.lit("abroad"), "abroad")).alias("region", "price"))
    return variants.filter(F.col("price").isNotNull())


@query("SELECT partner, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT p_brand, unnest([p_type, CASE WHEN p_size > 45 THEN 'LARGE' END]) AS partner FROM part) WHERE partner IS NOT NULL GROUP BY partner")
def combinations_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each member of the lists in a table, whose lists hold it. ARR-09"""
    member = F.explode(F.array_compact(F.array("p_type", F.when(F.col("p_size") > 45, "LARGE"))))
    return read(spark, sf_dir, "part").select("p_brand", member.alias("partner")).groupBy("partner").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'purchase' THEN 'active' ELSE event_type END AS status, array_to_string(list_sort(list_distinct(list_filter([CAST(json_extract(props, '$.k') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT) % 10], lambda x: x != 7))), ',') AS series,
      '{"k":' || json_extract(props, '$.k') || CASE WHEN event_type = 'purchase' THEN ',"kind":"purchase"' ELSE '' END || '}' AS payload FROM events"""
)
def flattened_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested properties as a flat row, a set from two sources without one member, and the row as JSON without what is missing. ARR-03, ARR-10, SRC-25"""
    k = F.from_json("props", "k long")["k"]
    series = F.array_sort(F.array_except(F.array_distinct(F.array(k, k % 10)), F.array(F.lit(7).cast("long"))))
    payload = F.to_json(F.struct(k.alias("k"), F.when(F.col("event_type") == "purchase", "purchase").alias("kind")))
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(F.col("event_type") == "purchase", "active").otherwise(F.col("event_type")).alias("status"), F.array_join(series, ",").alias("series"), payload.alias("payload"))


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, CASE WHEN event_type IN ('purchase', 'error') THEN 0 ELSE 1 END ORDER BY ts, event_id) AS k FROM events), s AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS paid FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN paid IS NOT NULL THEN 'paid' ELSE 'failed' END AS state, coalesce(paid, max(ts) FILTER (event_type = 'error')) AS since, count(*) FILTER (event_type = 'error' AND (paid IS NULL OR ts < paid)) AS failures, count(*) FILTER (event_type = 'purchase' AND ts > paid) AS replays
    FROM e JOIN s USING (user_id) WHERE event_type IN ('purchase', 'error') GROUP BY user_id, paid"""
)
def payment_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each reader's payment: the first success counts, after failures too; what comes later changes nothing. STR-04"""
    events = read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    paid = F.min(F.when(F.col("event_type") == "purchase", F.col("ts")))
    first = events.groupBy("user_id").agg(paid.alias("paid"))
    error = F.col("event_type") == "error"
    joined = events.join(first, "user_id").groupBy("user_id").agg(
        F.first("paid").alias("paid"), F.max(F.when(error, F.col("ts"))).alias("failed"), F.count_if(error & (F.col("paid").isNull() | (F.col("ts") < F.col("paid")))).alias("failures"), F.count_if(~error & (F.col("ts") > F.col("paid"))).alias("replays")
    )
    return joined.select("user_id", F.when(F.col("paid").isNotNull(), "paid").otherwise("failed").alias("state"), F.coalesce("paid", "failed").alias("since"), "failures", "replays")


@query(
    """WITH refunds AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R'), e AS (SELECT o_orderkey, o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT o_custkey, l_partkey, count(*) AS grants FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM refunds) GROUP BY ALL"""
)
def grants_after_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that are left when every refunded order takes its own back. STR-21"""
    lines = read(spark, sf_dir, "lineitem")
    refunds = lines.filter("l_returnflag = 'R'").select("l_orderkey")
    left = lines.join(refunds, "l_orderkey", "left_anti").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return left.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("grants"))


@query(
    """WITH s AS (SELECT event_id, user_id, event_type AS issue, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS again FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM s WHERE again = 1)
    SELECT event_id, user_id, issue, place <= 2 AND ts > TIMESTAMP '2024-01-20' AS live FROM l"""
)
def reader_sessions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest session of a reader and issue replaces older ones; the newest two of a reader live, while fresh. WIN-22, STR-12"""
    order = [F.desc("ts"), F.desc("event_id")]
    newest = R.latest_per(read(spark, sf_dir, "events"), ["user_id", "event_type"], order)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    live = (place <= 2) & (F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz"))
    return newest.select("event_id", "user_id", F.col("event_type").alias("issue"), live.alias("live"))


@query("SELECT event_id, user_id, ts, strftime(ts, '%Y-%m-%d') || ' ' || event_type || ' by ' || user_id AS entry FROM events WHERE event_type IN ('signup', 'error')")
def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put to the audit log, with its actor. SNK-12"""
    entry = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), "event_type", F.lit("by"), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error")).select("event_id", "user_id", "ts", entry.alias("entry"))
