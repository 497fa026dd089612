"""Words of printed pages put together to lines, columns and blocks of text.

words: page, id, text, x0, x1, top, bottom (points), size, font.  All steps are windows and groups of a page or of a part of it, and joins on the page,
so words that are dealt by page, once, are not shuffled again; what lines and blocks consist of is counted by grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.functions.scalars import glue_initial
from quirelight.functions.text import SOFT_HYPHEN, bound, clean_print_text
from quirelight.operators.geometry import kept_starts

# Fixed values, in points or times a line's height.
LINE_TOLERANCE, BLOCK_GAP, WORD_GAP, COLUMN_REACH = 2.2, 1.45, 10.0, 6.0
GUTTER_BIN, GUTTER_BINS, GUTTER_EDGE = 2.0, 4, 0.08


def with_lines(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """words with `line`, numbered in each page: by height (to a tenth of a point) and side, a word joins the line of the word before it if it is as high.

    The last word, not the first one, stands for a line, as slanted lines drift by more than the tolerance over their width.  In this order a word is at most a
    tenth higher up than the one before, and a line begins over the tolerance below all earlier ones, so with a tolerance above a tenth no word fits an earlier line.
    """
    if tolerance <= 0.2:
        raise ValueError("a tolerance of 0.2 points or less is within the rounding of heights")
    along = Window.partitionBy("page").orderBy("_height", "x0", "id")
    words = words.withColumn("_height", F.round("top", 1))
    words = words.withColumn("_new", F.coalesce((~(F.abs(F.col("top") - F.lag("top").over(along)) <= tolerance)).cast("int"), F.lit(0)))
    return words.withColumn("line", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_height", "_new")


def with_pieces(words: DataFrame) -> DataFrame:
    """words with `piece`: a line is cut where the gap to the word before is 10 points and 1.2 times the line's type or more."""
    along = Window.partitionBy("page", "line").orderBy("x0", "id")
    # the gap first: its order serves the median too
    words = words.withColumn("_gap", F.col("x0") - F.lag("x1").over(along)).withColumn("_size", F.median("size").over(Window.partitionBy("page", "line")))
    marked = words.withColumn("_new", F.coalesce((F.col("_gap") >= F.greatest(F.lit(WORD_GAP), F.col("_size") * 1.2)).cast("int"), F.lit(0)))
    return marked.withColumn("piece", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_size", "_gap")


def _most_frequent(values: Column) -> Column:
    """The most frequent one of an array, of equals the one that comes first."""
    def count(s: Column) -> Column:
        own, kinds = s["own"], s["kinds"]
        counts = F.transform(kinds, lambda v, i: F.struct(F.size(F.filter(own, lambda x: x.eqNullSafe(v))).alias("n"), (-i).alias("i"), v.alias("v")))
        # most often all are the same
        return F.when(F.size(kinds) <= 1, F.get(kinds, F.lit(0))).otherwise(F.array_max(counts)["v"])

    return bound(F.struct(values.alias("own"), F.array_distinct(values).alias("kinds")), count)


def lines_of(words: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(page, line, piece, text, x0, x1, top, bottom, size, max_size, font, bold) from words with these keys; carried: columns that are one value in a page."""
    made = words.groupBy("page", "line", "piece").agg(
        F.array_sort(F.collect_list(F.struct("x0", "id", "text", "font"))).alias("_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.median("size").alias("size"), F.max("size").alias("max_size"), *[F.first(c).alias(c) for c in carried],
    )
    made = made.withColumns({"text": F.array_join(F.col("_words.text"), " "), "font": _most_frequent(F.col("_words.font"))})
    return made.select("page", "line", "piece", "text", "x0", "x1", "top", "bottom", "size", "max_size", "font", F.contains(F.lower("font"), F.lit("bold")).alias("bold"), *carried)


def page_columns(words: DataFrame) -> DataFrame:
    """(page, starts, gutters): left edges that much of a page's type shares (null if there are none), and the middles of the empty strips between its words.

    Words, with the width of their page, are counted by size and place first; a page has few such rows.
    """
    at = lambda c, wide: F.floor(F.col(c) / wide)
    counts = words.groupBy("page", "width", "size", at("x0", 4.0).alias("bin"), at("x0", GUTTER_BIN).alias("left"), at("x1", GUTTER_BIN).alias("right")).agg(F.count("*").alias("n"))
    body = F.expr("percentile(CASE WHEN size > 0 THEN size END, 0.5, n) OVER (PARTITION BY page)")
    near = F.abs(F.col("size") - F.col("_body")) < 0.18 * F.col("_body")
    rows = counts.withColumn("_body", body).groupBy("page").agg(
        F.first("width").alias("width"), F.collect_list(F.when(near, F.struct("bin", "n"))).alias("_edges"), F.collect_set(F.struct("left", "right")).alias("_spans"),
    )
    bins = lambda e: F.transform(F.array_distinct(F.col("_edges.bin")), lambda b: F.struct(b.alias("bin"), F.aggregate(F.filter(e, lambda x: x["bin"] == b), F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n")))
    taken = F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(F.greatest(F.lit(0), s["left"]), s["right"])))))
    rows = rows.select("page", "width", F.array_sort(bins(F.col("_edges"))).alias("_bins"), taken.alias("_taken"))
    pairs = F.arrays_zip(F.slice("_taken", 1, F.greatest(F.lit(0), F.size("_taken") - 1)).alias("a"), F.slice("_taken", 2, F.greatest(F.lit(0), F.size("_taken") - 1)).alias("b"))
    empty = F.transform(F.filter(pairs, lambda s: s["b"] - s["a"] - 1 >= GUTTER_BINS), lambda s: (s["a"] + 1 + s["b"]) / 2 * GUTTER_BIN)
    inner = F.filter(empty, lambda g: (g > F.col("width") * GUTTER_EDGE) & (g < F.col("width") * (1 - GUTTER_EDGE)))
    return rows.select("page", kept_starts(F.col("_bins")).alias("starts"), inner.alias("gutters"))


def with_columns(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with `column`: by left edges that much of a page's type shares, else by the empty strips between its words.  pages: page, starts, gutters."""
    middle = (F.col("x0") + F.col("x1")) / 2
    by_start = F.greatest(F.lit(0), F.size(F.filter("starts", lambda s: s <= F.col("x0") + COLUMN_REACH)) - 1)
    by_gutter = F.size(F.filter("gutters", lambda g: g < middle))
    column = F.when(F.col("starts").isNotNull(), by_start).otherwise(by_gutter)
    return lines.join(pages, "page").withColumn("column", column).drop("starts", "gutters")


def blocks_of(lines: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(page, column, block, text, n_lines, x0, x1, top, bottom, size, max_size, font, bold, continues_word) from lines with a column; carried: columns that are one value in a page.

    In a column, a block ends where the gap to the next line is over 1.45 line heights, the line lies beside, or its type or weight differs.
    """
    along = Window.partitionBy("page", "column").orderBy(F.round("top", 1), "x0", "line", "piece")
    before = lambda c: F.lag(c).over(along)
    high = F.greatest(before("bottom") - before("top"), F.lit(1.0))
    beside = (F.col("x1") < before("x0") - 5) | (F.col("x0") > before("x1") + 5)
    other = F.abs(F.col("size") - before("size")) >= F.greatest(F.lit(1.2), before("size") * 0.25)
    ends = (F.col("top") - before("bottom") > high * BLOCK_GAP) | beside | other | (F.col("bold") != before("bold"))
    marked = lines.withColumns({"_new": F.coalesce(ends.cast("int"), F.lit(0)), "_place": F.row_number().over(along)})
    marked = marked.withColumn("block", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["page", "column", "block"]
    chars = F.length("text")
    made = marked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_place", "text", "font"))).alias("_lines"), F.count("*").alias("n_lines"), *[F.min(c).alias(c) for c in ("x0", "top")], *[F.max(c).alias(c) for c in ("x1", "bottom", "max_size")],
        F.coalesce(F.median(F.when(F.col("size") != 0, F.col("size"))), F.lit(0.0)).alias("size"), (F.sum(F.when(F.col("bold"), chars).otherwise(0)) > 0.6 * F.greatest(F.lit(1), F.sum(chars))).alias("bold"), *[F.first(c).alias(c) for c in carried],
    )
    made = made.withColumns({"_raw": F.array_join(F.col("_lines.text"), "\n"), "font": _most_frequent(F.col("_lines.font"))})
    # a filter on the text would clean it once more, below the column; a list of one text or none does not
    cleaned = F.filter(F.array(F.struct(glue_initial(clean_print_text(F.col("_raw"))).alias("text"))), lambda s: s["text"] != "")
    made = made.select("*", F.endswith(F.rtrim("_raw"), F.lit(SOFT_HYPHEN)).alias("continues_word"), F.inline(cleaned))
    return made.select(*keys, "text", "n_lines", "x0", "x1", "top", "bottom", "size", "max_size", "font", "bold", "continues_word", *carried)


def points(items: DataFrame, aspect: float = 1 / 1.4142) -> tuple[DataFrame, DataFrame]:
    """(words, sizes) from items (page, id, text, x0, y0, x1, y1 as shares of the page, size in points).

    A page is as high as the upper median of size over height tells; signs of symbol fonts go, and items without other text or without height.
    """
    plain = F.regexp_replace("text", r"[\uE000-\uF8FF]", "")
    kept = items.filter("page IS NOT NULL AND y1 > y0 AND size > 0").withColumn("text", plain).filter(F.trim("text") != "")
    # from above, the middle one, or the first of two
    kept = kept.withColumn("_ratio", F.col("size") / (F.col("y1") - F.col("y0"))).withColumn("height", F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _ratio DESC) OVER (PARTITION BY page)")).withColumn("width", F.col("height") * aspect)
    scaled: dict[str, Column] = {"x0": F.col("x0") * F.col("width"), "x1": F.col("x1") * F.col("width"), "top": F.col("y0") * F.col("height"), "bottom": F.col("y1") * F.col("height")}
    words = kept.select("page", "id", "text", *[c.alias(n) for n, c in scaled.items()], F.col("size").cast("double").alias("size"), F.lit("").alias("font"), "height", "width")
    return words, words.groupBy("page").agg(F.first("height").alias("height"), F.first("width").alias("width"))


def page_blocks(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """The blocks of text of pages, from their words and the pages' sizes (which words from `points` have themselves), with all sides as shares of the page."""
    size = ("height", "width")
    words = words if {*size} <= {*words.columns} else words.join(sizes, "page")
    lines = with_columns(lines_of(with_pieces(with_lines(words)), size), page_columns(words))
    share = lambda c, of: (F.col(c) / F.col(of)).alias(c)
    return blocks_of(lines, size).select("page", "column", "block", "text", "n_lines", share("x0", "width"), share("top", "height"), share("x1", "width"), share("bottom", "height"), "size", "max_size", "font", "bold", "continues_word")
