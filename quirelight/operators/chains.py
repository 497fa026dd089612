"""Links from row to row: places along chains, and stacks of boxes above one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.sources.folders import cut_lineage


def chain_places(rows: DataFrame, group: str, key: str, following: str, begins: Column, order: Sequence[str]) -> DataFrame:
    """rows with `place`, from 1 in each group: from each beginning along the links, then the rest.

    Beginnings go by `order`; a row that several reach stands with the first of them, and everything behind it does too.
    What no beginning reaches (rings without one) comes last, by `order`.  Links out of the group end a chain; a chain that runs
    into a ring goes round it once.

    Pointers double: after k rounds every row knows the first beginning within 2**k links before it, and the row 2**k links after it.
    So a chain of n rows takes log2(n) rounds of a join and a grouped minimum, whatever its shape.
    """
    own = rows.select(group, key, F.col(following).alias("_next"), F.struct(*order, key).alias("_rank"), F.coalesce(begins, F.lit(False)).alias("_begins"))
    there = own.select(group, F.col(key).alias("_next"))
    links = own.select(group, key, "_next").join(there, [group, "_next"], "left_semi").select(group, key, "_next")
    links = cut_lineage(links)
    label = F.struct(F.col("_rank").alias("rank"), F.lit(0).cast("long").alias("far"))
    first = cut_lineage(own.filter("_begins").select(group, key, label.alias("_first")))
    step = 1
    while not links.isEmpty():
        reached = first.join(links, [group, key]).select(group, F.col("_next").alias(key), F.struct(F.col("_first.rank").alias("rank"), (F.col("_first.far") + step).alias("far")).alias("_first"))
        known = first
        first = cut_lineage(first.unionByName(reached).groupBy(group, key).agg(F.min("_first").alias("_first")))
        ahead = links.select(group, F.col(key).alias("_next"), F.col("_next").alias("_after"))
        if step > 1 and first.count() == known.count() and first.exceptAll(known).isEmpty():
            break
        links = cut_lineage(links.join(ahead, [group, "_next"]).select(group, key, F.col("_after").alias("_next")))
        step *= 2
    placed = rows.join(first, [group, key], "left")
    along = Window.partitionBy(group).orderBy(F.col("_first").isNull(), "_first.rank", "_first.far", F.struct(*order, key))
    return placed.withColumn("place", F.row_number().over(along)).drop("_first")


def stacked_above(bases: DataFrame, frames: DataFrame, page: str, key: str, steps: int, gap: float, lap: float, wider: float) -> DataFrame:
    """(page, base, step, frame): from each base upwards, the nearest frame over it, then the nearest over that, `steps` at most.

    A frame counts if at least half of the narrower of it and the base is shared across, if it is at most `wider` times as wide as the base, and if
    its lower edge is at most `gap` over the top reached so far and at most `lap` below it.  Of equally near ones the lesser key is taken.
    """
    b = bases.select(page, F.col(key).alias("base"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("top"))
    f = frames.select(page, F.col(key).alias("frame"), "x0", "y0", "x1", "y1")
    narrower = F.least(F.col("x1") - F.col("x0"), F.col("bx1") - F.col("bx0"))
    shared = F.least("x1", "bx1") - F.greatest("x0", "bx0")
    fits = (narrower > 0) & (shared >= narrower / 2) & (F.col("x1") - F.col("x0") <= wider * (F.col("bx1") - F.col("bx0"))) & (F.col("frame") != F.col("base"))
    pairs = cut_lineage(b.join(f, page).filter(fits).select(page, "base", "frame", "top", "y0", "y1"))
    tops = pairs.select(page, "base", "top").distinct()
    found = None
    pairs = pairs.drop("top")
    for step in range(1, steps + 1):
        apart = F.col("top") - F.col("y1")
        near = pairs.join(tops, [page, "base"]).withColumn("apart", apart).filter(F.col("apart").between(-lap, gap))
        if found is not None:
            near = near.join(found.select(page, "base", "frame"), [page, "base", "frame"], "left_anti")
        best = near.groupBy(page, "base").agg(F.min(F.struct("apart", "frame", "y0")).alias("best"))
        taken = cut_lineage(best.select(page, "base", F.lit(step).alias("step"), "best.frame", F.col("best.y0").alias("top")))
        tops = taken.select(page, "base", "top")
        taken = taken.drop("top")
        found = taken if found is None else found.unionByName(taken)
    return found
