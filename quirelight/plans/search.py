"""Full-text search, term statistics and matching by rare terms on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.operators import relational as R
from quirelight.plans.registry import query, read


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, at, line): the lines of every text, blank ones left out."""
    each = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.filter(F.trim("line") != "")


def terms(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


_LINES = "SELECT doc_id, source, pos, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) != ''"


@query(
    f"""WITH lines AS ({_LINES}),
    hits AS (SELECT * FROM lines WHERE regexp_matches(lower(line), '(^|[^\\p{{L}}\\p{{N}}])the') AND regexp_matches(lower(line), '(^|[^\\p{{L}}\\p{{N}}])re')),
    firsts AS (SELECT doc_id, arg_min(line, pos) AS line, count(*) AS n_lines FROM hits GROUP BY doc_id),
    flat AS (SELECT doc_id, n_lines, regexp_replace(line, '[ \\t\\r\\f\\v]+', ' ', 'g') AS line FROM firsts),
    cut AS (SELECT *, greatest(0, greatest(0, strpos(lower(line), 'the') - 1) - 70) AS start FROM flat)
    SELECT doc_id, n_lines, (CASE WHEN start > 0 THEN '...' ELSE '' END) || substring(line, start + 1, 220) || '...' AS snippet
    FROM cut ORDER BY n_lines DESC, doc_id LIMIT 25"""
)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 documents with the most lines in which every part of the query begins a word, with a snippet of the first such line."""
    hits = lines(read(spark, sf_dir, "documents")).filter(T.at_word_starts(F.col("line"), "the re"))
    firsts = hits.groupBy("doc_id").agg(F.min_by("line", "at").alias("line"), F.count("*").alias("n_lines"))
    return firsts.select("doc_id", "n_lines", T.snippet(F.col("line"), "the re").alias("snippet")).orderBy(F.desc("n_lines"), "doc_id").limit(25)


@query(
    f"""WITH lines AS ({_LINES}),
    hits AS (SELECT source, doc_id, count(*) AS n_lines FROM lines WHERE regexp_matches(lower(line), '(^|[^\\p{{L}}\\p{{N}}])the') GROUP BY ALL)
    SELECT source, doc_id, n_lines, place, CAST(greatest(0, alle - 3) AS BIGINT) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_lines DESC, doc_id) AS place, count(*) OVER (PARTITION BY source) AS alle FROM hits)
    WHERE place <= 3"""
)
def search_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three documents of each source for a query, and how many more there are."""
    hits = lines(read(spark, sf_dir, "documents")).filter(T.at_word_starts(F.col("line"), "the"))
    counts = hits.groupBy("source", "doc_id").agg(F.count("*").alias("n_lines"))
    # ranks are capped in each task before the shuffle; the totals are a grouped count of their own
    totals = counts.groupBy("source").agg(F.count("*").alias("_all"))
    best = R.first_n_per(counts, ["source"], [F.desc("n_lines"), F.col("doc_id")], 3, with_more=False)
    found = best.join(totals, "source")
    return found.select("source", "doc_id", "n_lines", F.col("place").cast("long").alias("place"), F.greatest(F.lit(0).cast("long"), F.col("_all") - 3).alias("more"))


@query(
    """WITH words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM words GROUP BY term"""
)
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each term stands, and its inverse document frequency."""
    docs = read(spark, sf_dir, "documents")
    n = docs.count()
    used = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return used.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.round(F.log(F.lit(n) / F.col("df")), 6))


@query(
    """WITH words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
    rare AS (SELECT term, CAST(round(1000 * ln((SELECT count(*) FROM benchmark) / count(*))) AS BIGINT) AS weight FROM words GROUP BY term HAVING count(*) * 20 <= (SELECT count(*) FROM benchmark)),
    keyed AS (SELECT item_id, term, weight FROM words JOIN rare USING (term)),
    used AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
    scored AS (SELECT doc_id, item_id, CAST(sum(weight) AS BIGINT) AS points FROM used JOIN keyed USING (term) GROUP BY ALL),
    best AS (SELECT doc_id, max(points) AS points FROM scored GROUP BY doc_id)
    SELECT doc_id, points, CASE WHEN count(*) = 1 THEN min(item_id) END AS item_id FROM scored JOIN best USING (doc_id, points) GROUP BY ALL"""
)
def best_item_by_rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item that shares the most weight of rare terms with a document; none where the best two are equal.

    A term counts if at most a twentieth of the items hold it, so its list of items stays short.
    """
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    words = items.select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    n = items.count()
    rare = words.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") * 20 <= n)
    rare = rare.select("term", F.round(1000 * F.log(F.lit(n) / F.col("df"))).cast("long").alias("weight"))
    keyed = words.join(rare, "term")
    used = docs.select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    scored = used.join(keyed, "term").groupBy("doc_id", "item_id").agg(F.sum("weight").alias("points"))
    return R.best_or_null(scored, ["doc_id"], "item_id", "points")


@query(
    """WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    SELECT doc_id, count(*) FILTER (term = 'the') AS n_exact, count(*) FILTER (starts_with(term, 'ret')) AS n_prefix
    FROM words WHERE term = 'the' OR starts_with(term, 'ret') GROUP BY doc_id"""
)
def postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a word, or one that the last word of the query begins."""
    used = read(spark, sf_dir, "documents").select("doc_id", F.explode(terms(F.col("text"))).alias("term"))
    exact, prefix = F.col("term") == "the", F.col("term").startswith("ret")
    return used.filter(exact | prefix).groupBy("doc_id").agg(F.count_if(exact).alias("n_exact"), F.count_if(prefix).alias("n_prefix"))


@query(
    f"""WITH lines AS ({_LINES}), sizes AS (SELECT source, count(DISTINCT doc_id) AS alle FROM lines GROUP BY source)
    SELECT source, line, count(DISTINCT doc_id) AS pages FROM lines GROUP BY source, line
    HAVING count(DISTINCT doc_id) >= greatest(3, CAST(ceil((SELECT alle FROM sizes s WHERE s.source = lines.source) * 0.02) AS BIGINT))"""
)
def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on at least three documents of a source and two in a hundred of them: running heads and footers."""
    return R.recurring(lines(read(spark, sf_dir, "documents")), "source", "doc_id", "line", 3, 0.02).select("source", "line", "pages")
