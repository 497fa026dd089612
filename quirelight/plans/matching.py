"""Unique and best matches, weighted picks and equal sets on parts and order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.functions import linkage as L
from quirelight.functions import text as T
from quirelight.operators import hints as H
from quirelight.operators import relational as R
from quirelight.plans.registry import query, read


@query("SELECT p_name, p_brand, p_type, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM part GROUP BY ALL")
def unique_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that a name, brand and type mean, none where they mean several."""
    return R.unique_or_null(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "p_partkey")


@query(
    """WITH best AS (SELECT p_brand, max(p_size) AS points FROM part GROUP BY p_brand)
    SELECT p.p_brand, points, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM part p JOIN best b ON p.p_brand = b.p_brand AND p_size = points GROUP BY ALL"""
)
def largest_part_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest part of each brand, none where two are equal."""
    return R.best_or_null(read(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_size")


@query(
    """SELECT p_brand, p_type, weight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, p_type) AS k
    FROM (SELECT p_brand, p_type, CAST(sum(p_size) AS BIGINT) AS weight FROM part GROUP BY ALL)) WHERE k = 1"""
)
def main_type_of_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type with the largest summed size in each brand."""
    return R.weighted_mode(read(spark, sf_dir, "part"), ["p_brand"], "p_type", F.col("p_size")).select("p_brand", "p_type", "weight")


@query(
    """WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_partkey))) AS parts FROM lineitem GROUP BY l_orderkey)
    SELECT left_key, right_key FROM (SELECT min(k) OVER (PARTITION BY parts) AS left_key, k AS right_key FROM s) WHERE left_key != right_key"""
)
def equal_part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have the same set of parts as an earlier one, with the first such; a set of n orders gives n - 1 rows. JOIN-31"""
    classes = R.set_classes(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return classes.filter("class_key != l_orderkey").select(F.col("class_key").alias("left_key"), F.col("l_orderkey").alias("right_key"))


@query(
    """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS parts FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY parts) AS class_key, count(*) OVER (PARTITION BY parts) AS class_size FROM s"""
)
def part_set_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the smallest order of the same set of parts, and how many orders have it."""
    return R.set_classes(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query()
def title_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the titles of a brand's parts name each other: equal, beginning alike, or sharing all carrying words."""
    names = read(spark, sf_dir, "part").select("p_brand", "p_type", "p_name").distinct()
    shelf = names.select("p_brand", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).distinct().withColumn("n", T.name_forms(F.col("name")))
    titles = names.select("p_brand", F.col("p_name").alias("title")).distinct().withColumn("t", T.title_forms(F.col("title")))
    # every rank above 0 needs the title's first word or its first carrying word in the name, so pairs meet on these
    keys = F.array_distinct(F.array_compact(F.array(F.get(F.split("t.full", " "), 0), F.get("t.words", 0))))
    asked = titles.select("*", F.explode(keys).alias("word"))
    offered = shelf.select("*", F.explode(F.array_distinct(F.split("n.plain", " "))).alias("word"))
    ranked = asked.join(offered, ["p_brand", "word"]).withColumn("rank", T.rank_of_forms(F.col("n"), F.col("t"))).filter("rank > 0")
    ranked = ranked.groupBy("p_brand", "title", "name").agg(F.max("rank").alias("rank"))  # a pair may meet on two words
    return ranked.groupBy("p_brand", "title", "rank").agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n, round(avg(l_discount), 4) AS mean_discount, approx FROM (SELECT *, 0 AS approx FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02') GROUP BY ALL")
def ext_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by flag and status of the lines shipped up to a day."""
    shipped = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean_discount"), F.lit(0).alias("approx"))


_HINTED = """products AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_type) || ', Band ' || (p_size % 12 + 1) AS name, CAST(round(p_retailprice * 100) AS BIGINT) AS price, CASE p_partkey % 3 WHEN 0 THEN 'Anna Schulz' WHEN 1 THEN 'Anna Weber/Bert Vogel' ELSE '(Hrsg.) Cora Kurz' END AS makers FROM part),
    hints AS (SELECT p_partkey AS hint, CASE p_partkey % 2 WHEN 0 THEN 'Anna Schulz ' ELSE 'Bert Vogel und Anna Weber ' END || p_name || ' ' || p_type || '. Untertitel. Bd. ' || ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'][p_size % 12 + 1] || ': Schluss' AS zone,
      ['Anna Schulz', p_name, p_type] AS lines, CASE WHEN p_partkey % 3 > 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS asked FROM part WHERE p_partkey % 7 = 0)"""


def _hints_and_products(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    cents, volume = F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_size") % 12 + 1
    makers = F.when(key % 3 == 0, "Anna Schulz").when(key % 3 == 1, "Anna Weber/Bert Vogel").otherwise("(Hrsg.) Cora Kurz")
    products = part.select(key.alias("id"), F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(", Band "), volume.cast("string")).alias("name"), cents.alias("price"), makers.alias("makers"))
    roman = F.get(F.array(*[F.lit(r.upper()) for r in L.ROMAN]), volume - 1)
    who = F.when(key % 2 == 0, "Anna Schulz ").otherwise("Bert Vogel und Anna Weber ")
    zone = F.concat(who, "p_name", F.lit(" "), "p_type", F.lit(". Untertitel. Bd. "), roman, F.lit(": Schluss"))
    hints = part.filter(key % 7 == 0).select(key.alias("hint"), zone.alias("zone"), F.array(F.lit("Anna Schulz"), "p_name", "p_type").alias("lines"), F.when(key % 3 > 0, cents).alias("asked"))
    return hints, products


@query(
    f"""WITH {_HINTED}, w AS (SELECT hint, asked, regexp_extract_all(lower(zone), '[a-z0-9]+') AS z, list_transform(lines, lambda x: array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' ')) AS l FROM hints),
    n AS (SELECT id, price, regexp_extract_all(lower(name), '[a-z0-9]+') AS n, CASE id % 3 WHEN 0 THEN ['schulz'] WHEN 1 THEN ['weber', 'vogel'] ELSE ['kurz'] END AS who FROM products),
    m AS (SELECT *, ' ' || array_to_string(z, ' ') || ' ' AS zs, ' ' || array_to_string(n, ' ') || ' ' AS ns, ' ' || array_to_string(n[:-3], ' ') || ' ' AS bs FROM w JOIN n ON contains(' ' || array_to_string(z, ' ') || ' ', ' ' || array_to_string(n[1:2], ' ') || ' ')),
    f AS (SELECT *, CASE WHEN contains(zs, ns) THEN n WHEN contains(zs, bs) AND contains(zs, ' bd ' || ['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii'][CAST(n[-1] AS INTEGER)] || ' ') THEN n[:-3] END AS found FROM m),
    s AS (SELECT hint, id, CASE WHEN asked IS NULL THEN 0 WHEN asked = price THEN 2 ELSE -1 END + CASE WHEN len(list_filter(who, lambda x: NOT list_contains(z, x))) = 0 THEN 2 ELSE 0 END + CASE WHEN list_contains(l, array_to_string(found, ' ')) OR l[1] || ' ' || l[2] = array_to_string(found, ' ') OR l[2] || ' ' || l[3] = array_to_string(found, ' ') THEN 1 ELSE 0 END + CASE WHEN len(found) >= 3 THEN 1 ELSE 0 END - CASE WHEN len(found) = 1 THEN 1 ELSE 0 END AS points FROM f WHERE found IS NOT NULL),
    t AS (SELECT *, max(points) OVER (PARTITION BY hint) AS top FROM s WHERE points >= 3)
    SELECT hint, max(top) AS points, CASE WHEN count(*) = 1 THEN min(id) END AS product FROM t WHERE points = top GROUP BY hint"""
)
def hinted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one product that each printed hint means, by points for price, makers and lines; of equals none. TXT-14, TXT-15, TXT-16, JOIN-27, ORD-02

    Candidates are those whose first words stand in the zone, found by equal runs of words.  What a name and its makers are worth for a text is told once for each two of them;
    the price, which takes or adds points whatever the text is, comes to it by counts of who costs as much, something else or nothing known.
    """
    hints, products = _hints_and_products(spark, sf_dir)
    printed = ["zone", "lines", "asked"]
    hints = hints.withColumn("one", F.min("hint").over(Window.partitionBy(*printed)))
    texts = hints.select("zone", "lines").distinct().withColumn("begins", F.explode(L.runs(F.col("zone"))))
    # of several ids, all bits that an odd number of them has: what is left without some of them is the one id where one is left
    tally = [F.count("*").alias("n"), F.count("id").alias("n_ids"), F.coalesce(F.bit_xor("id"), F.lit(0)).alias("ids")]
    titles, priced = products.groupBy("name", "makers").agg(*tally), products.groupBy("name", "makers", "price").agg(*tally)
    # both sides are longer than files of few distinct strings let Spark guess, so neither is broadcast
    pairs = texts.join(titles.select("name", "makers", L.first_words(F.col("name")).alias("begins")).hint("merge"), "begins")
    unknown = F.lit(None).cast("bigint")
    worth = L.title_points(F.col("name"), F.col("makers"), unknown, F.col("zone"), F.col("lines"), unknown).cast("int")
    # an equal price gives two points
    worthy = pairs.select("zone", "lines", "name", "makers", worth.alias("worth")).filter("worth >= 1")
    asked = hints.filter("hint = one").select("one", *printed).distinct()
    met = asked.join(worthy.hint("merge"), ["zone", "lines"]).select("one", "asked", "name", "makers", "worth")
    counts = [F.struct("n", "n_ids", "ids").alias("tally")]
    met = met.join(titles.select("name", "makers", *counts).withColumnRenamed("tally", "all").hint("merge"), ["name", "makers"])
    same = priced.filter("price IS NOT NULL").select("name", "makers", F.col("price").alias("asked"), *counts).withColumnRenamed("tally", "same").hint("merge")
    none = priced.filter("price IS NULL").select("name", "makers", *counts).withColumnRenamed("tally", "none")
    met = met.join(same, ["name", "makers", "asked"], "left").join(none, ["name", "makers"], "left")
    number = lambda of, c: F.coalesce(F.col(f"{of}.{c}"), F.lit(0))
    rest = lambda c: F.col(f"all.{c}") - number("same", c) - number("none", c)

    def kind(points: Column, n: Column, n_ids: Column, ids: Column) -> Column:
        return F.struct(points.cast("int").alias("points"), n.alias("n"), F.when((n == 1) & (n_ids == 1), ids).alias("id"))

    other_ids = F.col("all.ids").bitwiseXOR(number("same", "ids")).bitwiseXOR(number("none", "ids"))
    kinds = [
        kind(F.col("worth") + 2, *[number("same", c) for c in ("n", "n_ids", "ids")]),
        kind(F.col("worth"), *[F.when(F.col("asked").isNull(), F.col(f"all.{c}")).otherwise(number("none", c)) for c in ("n", "n_ids", "ids")]),
        kind(F.col("worth") - 1, F.when(F.col("asked").isNotNull(), rest("n")).otherwise(0), rest("n_ids"), other_ids),
    ]
    scored = met.select("one", F.inline(F.array(*kinds))).filter("n > 0 AND points >= 3")
    best = R.best_of_counted(scored, ["one"], "id", "points", "n")
    best = R.best_of_counted(hints.select("hint", "one").join(best.hint("merge"), "one"), ["hint"], "id", "points", "n")
    best = best.withColumn("id", F.when(F.col("n") == 1, F.col("id")))
    return best.select("hint", "points", F.col("id").alias("product"))


@query(
    """WITH e AS (SELECT l_orderkey, l_partkey, max(l_linenumber % 3) AS rank, bool_or(l_returnflag = 'A') AS mine FROM lineitem GROUP BY ALL), t AS (SELECT *, max(rank) OVER (PARTITION BY l_orderkey) AS top FROM e),
    b AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (mine) AS m, min(l_partkey) AS one, min(l_partkey) FILTER (mine) AS own FROM t WHERE rank = top AND rank > 0 GROUP BY l_orderkey)
    SELECT k.l_orderkey, CASE WHEN n = 1 THEN one WHEN m = 1 THEN own END AS l_partkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN b USING (l_orderkey)"""
)
def book_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the best rank of each order, a second test deciding between several; none where that leaves more than one. AGG-25, AGG-27"""
    return R.best_by_rank_then_test(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", F.col("l_linenumber") % 3, F.col("l_returnflag") == "A")


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber AS place, CASE WHEN l_linenumber % 2 = 0 THEN 'two words ' ELSE 'word' END || l_linenumber AS q, CAST(max(l_suppkey) % 6 AS BIGINT) AS hits FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT l_orderkey, coalesce(arg_min(q, place) FILTER (contains(q, ' ') AND hits >= 3), CASE WHEN max(hits) > 0 THEN arg_max(q, (hits, -place)) END, arg_min(q, place)) AS q FROM q GROUP BY l_orderkey"""
)
def queries_to_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that a collection of offers leads to, by the number of its hits. AGG-26"""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("place")).agg((F.max("l_suppkey") % 6).alias("hits"))
    q = F.concat(F.when(F.col("place") % 2 == 0, "two words ").otherwise("word"), F.col("place").cast("string"))
    return R.chosen_query(rows.withColumn("q", q), ["l_orderkey"], "q", "place", "hits")


@query(
    r"""WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'Foto: ' ELSE '' END || repeat(p_name || ' ', 1 + p_partkey % 31) || CASE WHEN p_partkey % 4 = 0 THEN 'Ende.' ELSE 'x' END AS text, CAST(6 + p_size % 15 AS DOUBLE) AS size, CAST(6 + p_size % 15 + p_partkey % 6 AS DOUBLE) AS most, p_type AS font, p_partkey % 5 = 0 AS bold FROM part),
    w AS (SELECT size, sum(length(text)) AS n FROM b GROUP BY size), body AS (SELECT arg_max(size, (n, -size)) AS body FROM w),
    f AS (SELECT font, sum(length(text)) AS n FROM b, body WHERE abs(size - body) < 0.2 * body GROUP BY font), g AS (SELECT arg_max(font, n) AS body_font FROM f),
    j AS (SELECT *, length(text) AS chars, font != body_font AS foreign_font, length(trim(text)) <= 140 AND NOT (regexp_matches(trim(text), '[.:;,]$') AND length(trim(text)) > 60) AS head FROM b, body, g),
    k AS (SELECT *, most >= body * 1.7 AND size <= body * 1.15 AND NOT bold AND NOT foreign_font AS initial FROM j)
    SELECT id, CASE WHEN starts_with(text, 'Foto:') OR most <= body * 0.9 THEN 'caption' WHEN bold AND foreign_font AND size >= body * 1.08 AND chars <= 140 AND head THEN 'heading' WHEN foreign_font AND most <= body * 1.12 AND chars <= 400 THEN CASE WHEN chars < 200 THEN 'quote' ELSE 'caption' END
      WHEN NOT initial AND most >= body * 1.45 AND (size >= body * 1.25 OR bold OR foreign_font) AND head THEN 'heading' WHEN NOT initial AND most >= body * 1.12 AND chars <= 260 AND head THEN CASE WHEN chars <= 120 THEN 'subheading' ELSE 'lead' END ELSE 'paragraph' END AS kind FROM k"""
)
def kinds_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block is a heading, a lead, a quote, a caption or running text, by its type against that of most of the text. UDF-10, AGG-10, AGG-11"""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.when(key % 13 == 0, "Foto: ").otherwise(""), F.repeat(F.concat("p_name", F.lit(" ")), (1 + key % 31).cast("int")), F.when(key % 4 == 0, "Ende.").otherwise("x"))
    blocks = read(spark, sf_dir, "part").select(key.alias("id"), text.alias("text"), (6 + size % 15).cast("double").alias("size"), (6 + size % 15 + key % 6).cast("double").alias("most"), F.col("p_type").alias("font"), (key % 5 == 0).alias("bold"))
    blocks = blocks.withColumn("chars", F.length("text"))
    # a size and a font, one each
    body = blocks.groupBy("size").agg(F.sum("chars").alias("n")).agg(F.max_by("size", F.struct(F.col("n"), -F.col("size")))).first()[0]
    near = blocks.filter(F.abs(F.col("size") - F.lit(body)) < 0.2 * F.lit(body))
    body_font = near.groupBy("font").agg(F.sum("chars").alias("n")).agg(F.max_by("font", "n")).first()[0]
    return blocks.select("id", H.block_kinds(F.col("text"), F.col("chars"), F.col("size"), F.col("most"), F.col("font"), F.col("bold"), F.lit(body), F.lit(body_font)).alias("kind"))


def article_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles made of an order's lines, with advertisements, citations, numbers and descriptions."""
    n, key = F.col("l_linenumber"), F.col("l_partkey")
    # an article's lines are dealt before they have texts, for what goes over its blocks
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    size = F.col("p_size").cast("string")
    kind = key % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("Anna Schulz. Der "), F.col("p_name"), F.lit(". "), size, F.lit("0 S., geb., € "), size, F.lit(",90")))
        .when(kind == 1, F.concat(F.col("p_name"), F.lit(" im Einsatz")))
        .when(kind == 2, F.concat(F.lit("Best.-Nr. 10"), F.lpad(size, 4, "0")))
        .when(kind == 3, F.concat(F.repeat(F.lit("lange Beschreibung "), 10), F.lit("216 S., Abb.")))
        .when(kind == 4, F.concat(F.repeat(F.concat("p_name", F.lit(" ")), 20)))
        .otherwise(F.lit("120 Seiten, Pb"))
    )
    return lines.join(part, "l_partkey").repartition("l_orderkey").select(F.col("l_orderkey").alias("article"), n.alias("block"), text.alias("text"), F.concat(F.lit("Heft "), F.col("l_orderkey").cast("string"), F.lit(" und mehr")).alias("title"))


@query()
def printed_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints to products in articles: numbers that are printed, and books that are described. TXT-17, TXT-19, TXT-20, TXT-56, SET-04"""
    found = H.find_hints(article_blocks(spark, sf_dir), "article", "title", "block", "text")
    return found.select("article", "block", "kind", "reference", "zone", F.array_join("lines", "|").alias("lines"), F.array_join("queries", "|").alias("queries"), "cents")
