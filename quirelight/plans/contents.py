"""Printed pages made from documents: contents pages with twelve entries each, and texts set in two columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions.text import bound
from quirelight.operators import contents as C
from quirelight.operators import lines as L
from quirelight.plans.registry import query, read


def entries_and_items(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries, and what is printed: some titles are misprinted, some numbers stand in the title's line or nowhere, and some pages have no text."""
    key = F.col("doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    rows = docs.select(key.alias("entry"), F.floor(key / 12).alias("page"), (key % 300 + 1).alias("printed"), words.alias("w")).filter("size(w) >= 9")
    place = F.col("entry") % 12
    rows = rows.withColumns({"left": F.floor(place / 6) * 0.46 + 0.08, "top": (place % 6) * 0.14 + 0.1})
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    entries = rows.select("entry", "page", joined(1, 5).alias("label"), joined(6, 4).alias("details"), "printed", F.col("left").alias("x0"), (F.col("top") + 0.01).alias("y0"), (F.col("left") + 0.3).alias("x1"), (F.col("top") + 0.05).alias("y1"))
    wrong = F.col("entry").isin(-1) | (F.col("entry") % 7 == 3) | (F.col("entry") % 11 == 5)
    inside = F.col("entry") % 5 == 2

    def item(n: int, text: Column, left: Column | float, down: float, wide: float, high: float) -> Column:
        x0, y0 = F.col("left") + left, F.col("top") + down
        return F.struct((F.col("entry") * 16 + n).alias("id"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + wide).alias("x1"), (y0 + high).alias("y1"))

    number = F.when(F.col("entry") % 11 != 5, F.col("printed").cast("string"))
    word = lambda k: F.get("w", F.lit(k))
    first = F.when(wrong, F.concat(F.lit("x"), word(0))).otherwise(word(0))
    first = F.when(inside & number.isNotNull(), F.concat(number, F.lit(" "), first)).otherwise(first)
    printed = [item(0, F.when(~inside, number), 0.0, -0.004, 0.03, 0.03)]
    printed += [item(1 + k, first if k == 0 else word(k), 0.06 + 0.09 * (k % 3), 0.02 * (k // 3) + 0.0005 * (k % 3), 0.08, 0.015) for k in range(5)]
    printed += [item(6 + k, word(5 + k), 0.06 + 0.075 * k, 0.04, 0.07, 0.015) for k in range(4)]
    items = rows.filter("page % 10 != 9").select("page", F.inline(F.array(*printed))).filter("text IS NOT NULL")
    return entries, items


@query()
def placed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where on its contents page every entry is printed. TXT-46, TXT-47, WIN-10, WIN-26, JOIN-41, JOIN-42, JOIN-43, JOIN-44, TXT-45"""
    entries, items = entries_and_items(read(spark, sf_dir, "documents"))
    return C.placed_entries(entries, items).select("entry", "page", "how", *[F.round(c, 6).alias(c) for c in C.BOX])


@query()
def contents_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries of a contents page were found by title, by number or not at all, and how many of their boxes clash. TXT-47, JOIN-30"""
    return C.balance(C.placed_entries(*entries_and_items(read(spark, sf_dir, "documents"))))


#: Words on a page, and characters of text whose words one task puts in order.
WORDS_A_PAGE, CHARS_A_TASK = 720, 8_000_000


def set_in_columns(docs: DataFrame) -> DataFrame:
    """Every word of every document as an item: twelve a row in two columns, sixty rows a page, with headings, gaps between paragraphs and slanted rows.

    Pages are dealt to tasks before they become items, as runs of words, so that only the text itself is shuffled.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / WORDS_A_PAGE).cast("int"))), lambda n: F.struct(n.alias("n"), F.slice(w, n * WORDS_A_PAGE + 1, WORDS_A_PAGE).alias("words")))
    pages = docs.select("doc_id", F.inline(bound(words, runs))).select((F.col("doc_id") * 10_000 + F.col("n").cast("long")).alias("page"), "n", "words")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_A_TASK))
    each = pages.repartition(tasks, "page").select("page", "n", F.posexplode("words").alias("at", "text"))
    each = each.join(F.broadcast(_layout(docs.sparkSession)), "at")
    return each.select("page", (F.col("n").cast("long") * WORDS_A_PAGE + F.col("at")).alias("id"), "text", "x0", "y0", "x1", "y1", "size")


def _layout(spark: SparkSession) -> DataFrame:
    """(at, x0, y0, x1, y1, size): where the words of a page stand, the same on all pages."""
    places = spark.range(WORDS_A_PAGE).select(F.col("id").cast("int").alias("at"), F.floor(F.col("id") / 12).alias("r"), (F.col("id") % 6).alias("c"), (F.floor(F.col("id") / 6) % 2).alias("side"))
    head = F.col("r") % 20 == 0
    size = F.when(head, 16.0).otherwise(10.0)
    x0 = 0.08 + 0.07 * F.col("c") + 0.47 * F.col("side")
    y0 = 0.03 + 0.015 * F.col("r") + 0.01 * F.floor(F.col("r") / 9) + 0.0004 * F.col("c")
    high = size / 900.0
    return places.select("at", x0.alias("x0"), y0.alias("y0"), (x0 + 0.062).alias("x1"), (y0 + high).alias("y1"), size.alias("size"))


@query()
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of typeset pages, cut at gaps between columns. WIN-07, WIN-09, AGG-13"""
    words, _ = L.points(set_in_columns(read(spark, sf_dir, "documents")))
    lines = L.lines_of(L.with_pieces(L.with_lines(words)))
    return lines.select("page", "line", "piece", "text", *[F.round(c, 3).alias(c) for c in ("x0", "x1", "top", "bottom")], "size", "max_size", "font", "bold")


@query()
def printed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of text of typeset pages: words to lines, lines to columns, columns to blocks, cleaned for reading. UDF-12, WIN-08, WIN-07, WIN-09"""
    blocks = L.page_blocks(*L.points(set_in_columns(read(spark, sf_dir, "documents"))))
    return blocks.select("page", "column", "block", "text", "n_lines", *[F.round(c, 4).alias(c) for c in ("x0", "top", "x1", "bottom")], "size", "max_size", "bold")
