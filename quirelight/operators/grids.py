"""Tables with cells that span rows and columns, and paragraphs dealt to frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def visible_cells(cells: DataFrame, table: str) -> DataFrame:
    """The cells (row, col, row_span, col_span, ...) that no earlier one covers, with spans that end at the table's edge.

    Cells are read by row and column, as sorted batches; the state is, of each column of the table at hand, the row up to which it is taken,
    so a table of any number of rows streams through.
    """
    size = cells.groupBy(table).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    least = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1)))
    joined = cells.join(size, table).withColumns({"row_span": F.least(least("row_span"), F.col("_rows") - F.col("row")).cast("int"), "col_span": F.least(least("col_span"), F.col("_cols") - F.col("col")).cast("int")})
    ordered = joined.drop("_rows").repartition(table).sortWithinPartitions(table, "row", "col")

    def walk(batches):
        known, taken = None, []
        for pdf in batches:
            seen = []
            for key, row, col, down, across, width in zip(*(pdf[c].tolist() for c in (table, "row", "col", "row_span", "col_span", "_cols")), strict=True):
                if key != known:
                    known, taken = key, [0] * width
                free = taken[col] <= row
                if free:
                    for c in range(col, col + across):
                        taken[c] = max(taken[c], row + down)
                seen.append(free)
            yield pdf[pd.Series(seen, index=pdf.index, dtype=bool)]

    return ordered.mapInPandas(walk, ordered.schema).drop("_cols")


def with_headers(cells: DataFrame, table: str, declared: str, fill: str, bold: str) -> DataFrame:
    """cells with `header`: as many rows as the table declares, or the first one where it is told apart from the second by its fills, or is all bold."""
    fills = lambda k: F.collect_set(F.when(F.col("row") == k, F.coalesce(F.col(fill), F.lit(""))))
    first = F.col("row") == 0
    looks = cells.groupBy(table).agg(
        F.max(F.coalesce(declared, F.lit(0))).alias("_declared"), (F.max("row") + 1).alias("_rows"), F.array_sort(fills(0)).alias("_f0"), F.array_sort(fills(1)).alias("_f1"), F.coalesce(F.bool_and(F.when(first, F.col(bold))), F.lit(False)).alias("_bold")
    )
    alone = ~F.array_contains("_f0", "") & (F.col("_f0") != F.col("_f1"))
    inferred = F.when((F.col("_rows") > 1) & (F.size("_f0") > 0) & (alone | F.col("_bold")), 1).otherwise(0)
    rows = F.least(F.when(F.col("_declared") > 0, F.col("_declared")).otherwise(inferred), F.col("_rows"))
    return cells.join(looks.select(table, rows.alias("_head")), table).withColumn("header", F.col("row") < F.col("_head")).drop("_head")


def on_frames(paragraphs: DataFrame, frames: DataFrame, story: str, length: str, area: str, order_p: list[str], order_f: list[str], key_p: str, key_f: str) -> DataFrame:
    """(story, key_p, key_f, share): the frame that each paragraph of a story falls in, and how far down in it.

    Both run along scales from 0 to 1, paragraphs by their lengths and frames by their areas; the middle of a paragraph tells.  The scales are prefix sums that one pass in
    order puts together, so no paragraph meets more than its own frame.
    """
    all_of = Window.partitionBy(story)
    before = lambda c, order: F.coalesce(F.sum(c).over(all_of.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = paragraphs.withColumn("_l", F.greatest(F.lit(1), F.col(length)))
    p = p.select(story, F.col(key_p).alias("_p"), ((before("_l", order_p) + F.col("_l") / 2) / F.sum("_l").over(all_of)).alias("_at"))
    f = frames.withColumn("_a", F.greatest(F.lit(1e-6), F.col(area)))
    total = F.sum("_a").over(all_of)
    f = f.select(story, F.col(key_f).alias("_f"), (before("_a", order_f) / total).alias("_at"), (F.col("_a") / total).alias("_wide"))
    both = f.withColumn("_side", F.lit(0)).unionByName(p.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy(story).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_f").alias("f"), F.col("_at").alias("at"), F.col("_wide").alias("wide"))), ignorenulls=True).over(so_far)
    met = both.withColumn("_held", held).filter("_side = 1")
    share: Column = (F.col("_at") - F.col("_held.at")) / F.col("_held.wide")
    return met.select(story, F.col("_p").alias(key_p), F.col("_held.f").alias(key_f), share.alias("share"))
