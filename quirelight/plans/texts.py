"""Text scalars applied to documents, pages, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.operators import relational as R
from quirelight.plans.registry import query, read


@query()
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typeset text without soft hyphens, hyphenated line ends and special spaces."""
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_print_text(F.col("text")).alias("clean"))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[0-9]{5,6}')) AS n_numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\bsrc([0-9]+)', 1))), ',') AS refs FROM documents"""
)
def numbers_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers of five or six digits a text has, and the references of one form."""
    text = F.col("text")
    n = F.size(F.regexp_extract_all(text, F.lit("[0-9]{5,6}"), 0)).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("n_numbers"), F.array_join(F.array_sort(T.references(text, r"\bsrc([0-9]+)")), ",").alias("refs"))


@query()
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teaser of each document: its first sentence of fitting length."""
    return read(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("teaser"))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pieces of every document for a search index."""
    pieces = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("at", "piece"))
    return pieces.filter("piece != ''")


@query(
    """SELECT page_id, length(t) AS n_chars, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, t[1:80] AS head FROM (
    SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM (
    SELECT page_id, url, replace(replace(html, '&ndash;', '–'), '&szlig;', 'ß') AS html FROM (
    SELECT page_id, url, replace(replace(replace(replace(replace(replace(html, '&auml;', 'ä'), '&ouml;', 'ö'), '&uuml;', 'ü'), '&Auml;', 'Ä'), '&Ouml;', 'Ö'), '&Uuml;', 'Ü') AS html FROM pages)))"""
)
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags and with common character references read."""
    text = T.strip_html(F.col("html"))
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return read(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), host.alias("host"), F.substring(text, 1, 80).alias("head"))


@query(
    """SELECT page_id, length(t) AS n_chars, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, t AS text FROM (
    SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM (
    SELECT page_id, url, replace(replace(html, '&ndash;', '–'), '&szlig;', 'ß') AS html FROM (
    SELECT page_id, url, replace(replace(replace(replace(replace(replace(html, '&auml;', 'ä'), '&ouml;', 'ö'), '&uuml;', 'ü'), '&Auml;', 'Ä'), '&Ouml;', 'Ö'), '&Uuml;', 'Ü') AS html FROM pages)))"""
)
def stripped_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each page without tags and with common character references read."""
    text = T.strip_html(F.col("html"))
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return read(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), host.alias("host"), text.alias("text"))


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS n_links, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<p[\\s>]')) AS n_paragraphs FROM pages"""
)
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, links and paragraphs of each page."""
    html = F.col("html")
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.size(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).cast("long").alias("n_links"),
        F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit(r"<p[\s>]"), 0)).cast("long").alias("n_paragraphs"),
    )


@query(
    """WITH t AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '), lambda x: x != '') AS tokens FROM documents),
    c AS (SELECT *, len(list_filter(tokens, lambda x: length(x) <= 2)) AS few, len(list_filter(tokens, lambda x: length(x) >= 3)) AS longer, len(list_filter(tokens, lambda x: length(x) >= 4)) AS words FROM t)
    SELECT doc_id, (len(tokens) >= 4 AND few * 10 > len(tokens) * 6 AND words <= 1) AS shattered,
    (len(list_filter(tokens, lambda x: regexp_matches(x, '[A-Za-zÄÖÜäöüß]{4}'))) > 0 AND (longer >= 2 OR (few * 2 < len(tokens) AND length(trim(text)) >= 12))) AS meaningful FROM c"""
)
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are shattered into letters, and which say something."""
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.looks_shattered(text).alias("shattered"), T.is_meaningful(text).alias("meaningful"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, upper(left(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'), 8)) || '-' || right('0000' || p_partkey, 4) AS sku FROM part")
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and article numbers made of names."""
    part = read(spark, sf_dir, "part")
    code = F.upper(F.left(F.regexp_replace("p_name", "[^A-Za-z0-9]", ""), F.lit(8)))
    tail = F.right(F.concat(F.lit("0000"), F.col("p_partkey").cast("string")), F.lit(4))
    return part.select("p_partkey", T.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), F.concat_ws("-", code, tail).alias("sku"))


@query(
    """SELECT o_orderkey, replace(format('{:,}', cents // 100), ',', '.') || ',' || right('0' || (cents % 100), 2) || ' €' AS price, strftime(o_orderdate, '%d.%m.%Y') AS day,
    CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + to_months(1) AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER) AS month_later, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) & 65535 AS INTEGER) AS day_number
    FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
)
def order_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and dates as they are shown, and the day a calendar month later."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return orders.select(
        "o_orderkey",
        T.euro_display(cents).alias("price"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
        R.months_later(day, F.lit(1)).alias("month_later"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).bitwiseAND(F.lit(65535)).cast("int").alias("day_number"),
    )
