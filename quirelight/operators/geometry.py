"""Rectangles on pages: areas, overlaps, containment, gutters and merging.

Boxes are columns x0, y0, x1, y1, origin top left.  Joins of boxes are equal joins on the page (a page
holds a bounded number of boxes) with the geometry as the remaining condition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.functions.text import bound
from quirelight.sources.folders import cut_lineage

BOX = ("x0", "y0", "x1", "y1")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def box_area(prefix: str = "") -> Column:
    return area(*(F.col(prefix + c) for c in BOX))


def overlap_area(a: str, b: str) -> Column:
    return area(
        F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0")),
        F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0")),
        F.least(F.col(f"{a}x1"), F.col(f"{b}x1")),
        F.least(F.col(f"{a}y1"), F.col(f"{b}y1")),
    )


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 for two empty boxes."""
    both = overlap_area(a, b)
    whole = box_area(a) + box_area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def box_pairs(left: DataFrame, right: DataFrame, page: str, id_col: str, same: bool = False) -> DataFrame:
    """Pairs of boxes of a page as a_* and b_*; with `same`, each pair of one table once."""
    a = left.select(page, *[F.col(c).alias(f"a_{c}") for c in (id_col, *BOX)])
    b = right.select(page, *[F.col(c).alias(f"b_{c}") for c in (id_col, *BOX)])
    pairs = a.join(b, page)
    return pairs.filter(F.col(f"a_{id_col}") < F.col(f"b_{id_col}")) if same else pairs


def contained_share(a: str = "a_", b: str = "b_", margin: float = 0.0) -> Column:
    """Area of b over area of a where b lies in a up to a margin, else null."""
    inside = (
        (F.col(f"{b}x0") >= F.col(f"{a}x0") - margin)
        & (F.col(f"{b}y0") >= F.col(f"{a}y0") - margin)
        & (F.col(f"{b}x1") <= F.col(f"{a}x1") + margin)
        & (F.col(f"{b}y1") <= F.col(f"{a}y1") + margin)
    )
    return F.when(inside & (box_area(a) > 0), box_area(b) / box_area(a))


def point_distance(x: Column, y: Column) -> Column:
    """Squared distance of a point from the row's box."""
    dx = F.greatest(F.col("x0") - x, F.lit(0.0), x - F.col("x1"))
    dy = F.greatest(F.col("y0") - y, F.lit(0.0), y - F.col("y1"))
    return dx * dx + dy * dy


def gutters(df: DataFrame, page: str, width: float = 2.0, least: int = 4) -> DataFrame:
    """(page, first_bin, bins): runs of at least `least` empty bins between occupied ones on the x axis."""
    bins = F.sequence(F.floor(F.col("x0") / width).cast("int"), F.floor(F.col("x1") / width).cast("int"))
    used = df.select(page, F.explode(bins).alias("bin")).distinct()
    following = F.lead("bin").over(Window.partitionBy(page).orderBy("bin"))
    return used.withColumn("_next", following).filter(F.col("_next") - F.col("bin") > least).select(page, (F.col("bin") + 1).alias("first_bin"), (F.col("_next") - F.col("bin") - 1).alias("bins"))


def column_starts(df: DataFrame, page: str, size: str, width: float = 4.0, share: float = 0.03, least: int = 4, gap: float = 30.0, enough: int = 30) -> DataFrame:
    """(page, start): left edges that many words of the page's body type share, each at least `gap` from the one kept before.

    Body type is within 18 % of the median size.  Pages with fewer than `enough` such words, or with less than
    two such edges, have none.  The fold runs over a page's bins, which the width of the page bounds.
    """
    median = df.filter(F.col(size) > 0).groupBy(page).agg(F.median(size).alias("_body"))
    body = df.join(median, page).filter(F.abs(F.col(size) - F.col("_body")) < 0.18 * F.col("_body"))
    counts = body.groupBy(page, F.floor(F.col("x0") / width).alias("bin")).agg(F.count("*").alias("n"))
    bins = counts.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("_bins"))
    return bins.select(page, kept_starts(F.col("_bins"), width, share, least, gap, enough).alias("_starts")).select(page, F.explode("_starts").alias("start"))


def kept_starts(bins: Column, width: float = 4.0, share: float = 0.03, least: int = 4, gap: float = 30.0, enough: int = 30) -> Column:
    """The left edges of column_starts from the sorted array of (bin, n) of a page's body type, null if it has none."""
    def starts_of(own: Column) -> Column:
        every = F.aggregate(own, F.lit(0).cast("long"), lambda s, b: s + b["n"])
        peaks = bound(every, lambda n: F.filter(own, lambda b: b["n"] >= F.greatest(F.lit(float(least)), n * share)))
        kept = F.aggregate(F.transform(peaks, lambda b: b["bin"] * F.lit(width)), F.array().cast("array<double>"), keep)
        return bound(kept, lambda k: F.when((every >= enough) & (F.size(k) >= 2), k))

    def keep(kept: Column, x: Column) -> Column:
        near = (F.size(kept) > 0) & (x - F.try_element_at(kept, F.lit(-1)) < gap)
        return F.when(near, kept).otherwise(F.array_append(kept, x))

    return bound(bins, starts_of)


def grid_spread(df: DataFrame, key: str, cells: int = 4) -> DataFrame:
    """(key, spread): share of the cells of a unit grid that a key's boxes touch."""
    span = lambda lo, hi: F.sequence(
        F.greatest(F.lit(0), F.floor(F.col(lo) * cells)).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col(hi) * cells)).cast("int")
    )
    touched = df.select(key, F.explode(span("x0", "x1")).alias("cx"), "y0", "y1").select(key, "cx", F.explode(span("y0", "y1")).alias("cy"))
    return touched.groupBy(key).agg((F.count_distinct("cx", "cy") / (cells * cells)).alias("spread"))


def merged_boxes(df: DataFrame, keys: list[str], order: str, gap: float = 0.012) -> DataFrame:
    """Groups of boxes that grow while another lies within `gap`, in the given order; (keys, x0, y0, x1, y1, n).

    A finished group is not looked at again, so the order of the boxes is part of the result.  One task
    sees the boxes of one key, which are those of one text on one page.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(order)[list(BOX)].to_numpy().tolist()
        out = []
        while left:
            x0, y0, x1, y1 = left.pop(0)
            n, grown = 1, True
            while grown:
                grown = False
                for k, (a, b, c, d) in enumerate(left):
                    if a <= x1 + gap and c >= x0 - gap and b <= y1 + gap and d >= y0 - gap:
                        x0, y0, x1, y1, n, grown = min(x0, a), min(y0, b), max(x1, c), max(y1, d), n + 1, True
                        left.pop(k)
                        break
            out.append((*[pdf[c].iloc[0] for c in keys], x0, y0, x1, y1, n))
        return pd.DataFrame(out, columns=[*keys, *BOX, "n"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    return df.groupBy(*keys).applyInPandas(grow, f"{kinds}, x0 double, y0 double, x1 double, y1 double, n long")


def reading_order(df: DataFrame, page: str, wide: float = 0.62, split: float = 0.12, tie: str = "id") -> DataFrame:
    """Adds column_no and place: wide boxes first by y, the others by column and y; a column starts at a jump of the centres."""
    centre = (F.col("x0") + F.col("x1")) / 2
    is_wide = (F.col("x1") - F.col("x0")) > wide
    narrow = Window.partitionBy(page, is_wide).orderBy(centre, tie)
    jump = F.when(centre - F.lag(centre).over(narrow) > split, 1).otherwise(0)
    marked = df.withColumn("_jump", jump).withColumn("_wide", is_wide).withColumn("_centre", centre)
    count = F.sum("_jump").over(Window.partitionBy(page, "_wide").orderBy("_centre", tie).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("column_no", F.when(F.col("_wide"), F.lit(-1)).otherwise(count).cast("int"))
    place = F.row_number().over(Window.partitionBy(page).orderBy("column_no", "y0", tie))
    return marked.withColumn("place", place).drop("_jump", "_wide", "_centre")


# Fixed values of pictures on pages: overlap of the smaller and growth up to which two are one, share of text at which a box is no picture.
ONE_OVERLAP, ONE_GROWTH, TEXT_SHARE = 0.45, 1.8, 0.07


def joined_pictures(pictures: DataFrame, words: DataFrame, page: str, order: str) -> DataFrame:
    """(page, x0, y0, x1, y1, n): boxes that lie on one another become one, until no two do.

    Two do if they share 45 % of the smaller, if the box round both is at most 1.8 times as large as what they cover, and if words fill at most 7 % of it.
    The first pair in order that does is joined in the place of its first box, then all is looked at again; so the order is part of the result, and one task sees the boxes and words of a page.
    """
    size = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])

    def shared(a, b):
        return size((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))

    def fits(a, b, text):
        both = shared(a, b)
        if both <= 0 or both < min(size(a), size(b)) * ONE_OVERLAP:
            return None
        whole = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        filled = np.clip(np.minimum(text[:, 2], whole[2]) - np.maximum(text[:, 0], whole[0]), 0, None) * np.clip(np.minimum(text[:, 3], whole[3]) - np.maximum(text[:, 1], whole[1]), 0, None)
        return None if size(whole) > (size(a) + size(b) - both) * ONE_GROWTH or filled.sum() > TEXT_SHARE * size(whole) else whole

    def join(pdf: pd.DataFrame, wdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        open_, n = [tuple(b) for b in pdf[list(BOX)].to_numpy().tolist()], [1] * len(pdf)
        text = wdf[list(BOX)].to_numpy(float).reshape(-1, 4)
        while True:
            found = next(((i, j, w) for i in range(len(open_)) for j in range(i + 1, len(open_)) if (w := fits(open_[i], open_[j], text))), None)
            if not found:
                break
            i, j, whole = found
            open_[i], n[i] = whole, n[i] + n.pop(j)
            open_.pop(j)
        return pd.DataFrame([(pdf[page].iloc[0], *b, k) for b, k in zip(open_, n, strict=True)], columns=[page, *BOX, "n"])

    kind = pictures.schema[page].dataType.simpleString()
    with_words = words.select(page, *BOX).join(pictures.select(page).distinct(), page, "left_semi")
    return pictures.groupBy(page).cogroup(with_words.groupBy(page)).applyInPandas(join, f"{page} {kind}, x0 double, y0 double, x1 double, y1 double, n long")


def text_in(boxes: DataFrame, words: DataFrame, page: str, key: str, cells: int = 4) -> DataFrame:
    """boxes with `density`, the area of the words in each over its own, and `spread`, the share of its grid's cells that words touch."""
    pairs = box_pairs(boxes, words.select(page, F.lit(None).alias(key), *BOX), page, key)
    inner = {"x0": F.greatest("a_x0", "b_x0"), "y0": F.greatest("a_y0", "b_y0"), "x1": F.least("a_x1", "b_x1"), "y1": F.least("a_y1", "b_y1")}
    touched = pairs.withColumns(inner).filter("x1 > x0 AND y1 > y0")
    cell = lambda c, lo, hi: F.least(F.lit(cells - 1), F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * cells)).cast("int")
    span = lambda k: F.sequence(cell(f"{k}0", f"a_{k}0", f"a_{k}1"), cell(f"{k}1", f"a_{k}0", f"a_{k}1"))
    names = F.flatten(F.transform(span("x"), lambda x: F.transform(span("y"), lambda y: x * cells + y)))
    own = touched.groupBy(page, F.col(f"a_{key}").alias(key)).agg(F.sum(box_area()).alias("_filled"), F.size(F.array_distinct(F.flatten(F.collect_set(names)))).alias("_cells"))
    joined = boxes.join(own, [page, key], "left")
    return joined.withColumns({"density": F.when(box_area() > 0, F.coalesce("_filled", F.lit(0.0)) / box_area()).otherwise(0.0), "spread": F.coalesce("_cells", F.lit(0)) / (cells * cells)}).drop("_filled", "_cells")


def picture_regions(pictures: DataFrame, words: DataFrame, body: DataFrame, trim: DataFrame, page: str, key: str) -> DataFrame:
    """(page, x0, y0, x1, y1, n): what of a page's pictures is shown, joined where they lie on one another.

    pictures: page, key, box, stencil, pixels (or null); words and those in body type, and the trimmed page itself, as boxes.  Out go stencils, what is too small
    within the trim, page-filling ones with text on them (over 58 % of the page, over 2 % text), and those over which body text is spread (3 % of the page or more, over 7 % text in over 45 % of the cells).
    """
    net = trim.select(page, *[F.col(c).alias(f"t_{c}") for c in BOX])
    cut = pictures.filter("NOT stencil").join(net, page)
    cut = cut.withColumns({"x0": F.greatest("x0", "t_x0"), "y0": F.greatest("y0", "t_y0"), "x1": F.least("x1", "t_x1"), "y1": F.least("y1", "t_y1"), "net": F.greatest(area(*(F.col(f"t_{c}") for c in BOX)), F.lit(1e-6))})
    pixels = F.when(F.col("pixels") > 0, F.col("pixels"))
    cut = cut.filter(~too_small(pixels, area=0.010, side=0.055, aspect=5.5, pixels=90)).select(page, key, *BOX, "net")
    judged = text_in(cut, words, page, key).filter(~((box_area() / F.col("net") > 0.58) & (F.col("density") > 0.02))).drop("density", "spread")
    judged = text_in(judged, body, page, key).filter(~((box_area() >= 0.03) & (F.col("density") > TEXT_SHARE) & (F.col("spread") > 0.45)))
    joined = joined_pictures(cut_lineage(judged.select(page, key, *BOX)), body, page, key)
    short = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    large = joined.filter((box_area() >= 0.010) & (short >= 0.055)).withColumn("_region", F.monotonically_increasing_id()).join(net, page)
    large = cut_lineage(large.withColumn("net", F.greatest(area(*(F.col(f"t_{c}") for c in BOX)), F.lit(1e-6))))
    shown = text_in(large, words, page, "_region").filter(~((box_area() / F.col("net") > 0.58) & (F.col("density") > 0.02)))
    return shown.select(page, *BOX, "n")


def reader_regions(regions: DataFrame, article: str, page: str, target: str, order: str, least: float = 0.004) -> DataFrame:
    """(article, page, target, x0, y0, x1, y1, n): a reader's areas: sides in order and on the page, small ones out, those that lead somewhere as they are, the others of an article on a page grown together."""
    low = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(f"{k}0", f"{k}1")))
    high = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.greatest(f"{k}0", f"{k}1")))
    straight = regions.withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")}).filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    leads = straight.filter(F.col(target).isNotNull()).select(article, page, target, *BOX, F.lit(1).cast("long").alias("n"))
    grown = merged_boxes(straight.filter(F.col(target).isNull()), [article, page], order).withColumn(target, F.lit(None).cast(regions.schema[target].dataType))
    return leads.unionByName(grown.select(*leads.columns))


def too_small(source: Column, area: float, side: float, aspect: float, pixels: int) -> Column:
    """Whether the row's box is no picture: by area, shorter side, ratio of the sides, or a known number of pixels."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    short, long = F.least(width, height), F.greatest(width, height)
    return (short <= 0) | (box_area() < area) | (short < side) | (long / F.greatest(short, F.lit(1e-12)) > aspect) | F.coalesce(source < pixels, F.lit(False))


def affine(a: Column | float, b: Column | float, c: Column | float, d: Column | float, e: Column | float, f: Column | float) -> Column:
    """The map (x, y) -> (a x + c y + e, b x + d y + f)."""
    given = {"a": a, "b": b, "c": c, "d": d, "e": e, "f": f}
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("double").alias(name) for name, x in given.items()])


def affine_product(first: Column, then: Column) -> Column:
    """One map that does the first and then the other."""
    a, b, c, d, e, f = (first[k] for k in "abcdef")
    A, B, C, D, E, G = (then[k] for k in "abcdef")
    return affine(A * a + C * b, B * a + D * b, A * c + C * d, B * c + D * d, A * e + C * f + E, B * e + D * f + G)


def bounds_after(matrix: Column) -> Column:
    """(left, top, right, bottom) of the row's box after a map."""
    corners = [(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
    across = [matrix["a"] * x + matrix["c"] * y + matrix["e"] for x, y in corners]
    down = [matrix["b"] * x + matrix["d"] * y + matrix["f"] for x, y in corners]
    return F.struct(F.least(*across).alias("left"), F.least(*down).alias("top"), F.greatest(*across).alias("right"), F.greatest(*down).alias("bottom"))


def first_of_alike(df: DataFrame, id_col: str, group: str, vector: str, bound: float, shape: str, leeway: float, block: int = 512) -> DataFrame:
    """(id, first): of a group's rows in the order of their ids, a row goes to the first one that was kept and is like it; kept rows have no `first`.

    Two rows are alike if the root mean square of their vectors' difference is below the bound and their shapes differ by no more than that share of the larger.
    Being like a row that went itself counts for nothing, so verdicts come in rounds: a row stays once no earlier row like it may still stay, and goes once one does.
    Rows with equal vectors and shapes are one, that of the first.  The others are cut into pieces by their id; every pair of pieces of a group is a cell, and a
    cell yields the pairs that are alike.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), F.col(vector).alias("e"), F.col(shape).alias("shape"))
    same = cut_lineage(rows.groupBy("grp", "e", "shape").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    sizes = same.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    cut = same.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("grp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "e", "shape")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        e, shapes, ids = np.stack(pdf["e"].to_numpy()), pdf["shape"].to_numpy(), pdf["id"].to_numpy()
        square = (e * e).sum(axis=1)
        out = []
        for at in range(0, len(e), block):
            apart = square[at : at + block, None] + square[None, :] - 2 * e[at : at + block] @ e.T
            earlier = np.arange(len(e))[None, :] < np.arange(at, min(at + block, len(e)))[:, None]
            near = earlier & (apart < bound * bound * e.shape[1] + 1e-6)
            near &= np.abs(shapes[at : at + block, None] - shapes[None, :]) <= leeway * np.maximum(shapes[at : at + block, None], shapes[None, :])
            i, j = np.nonzero(near)  # near ones are weighed exactly
            close = np.sqrt(((e[at + i] - e[j]) ** 2).sum(axis=1) / e.shape[1]) < bound
            out.append(np.stack([ids[at + i[close]], ids[j[close]]]))
        pairs = np.concatenate(out, axis=1)
        return pd.DataFrame({"id": pairs[0], "earlier": pairs[1]})

    pairs = cut_lineage(cells.groupBy("grp", "p", "q").applyInPandas(judge, f"id {kind}, earlier {kind}").distinct())
    stays = same.select("id").join(pairs, "id", "left_anti")  # those without an earlier one like them
    gone, left = None, pairs
    while not left.isEmpty():
        stays = cut_lineage(stays)
        new = left.join(stays.select(F.col("id").alias("earlier")), "earlier", "left_semi").groupBy("id").agg(F.min("earlier").alias("first"))
        gone = cut_lineage(new if gone is None else gone.unionByName(new))
        # a row that went keeps no other from staying
        left = left.join(gone.select("id"), "id", "left_anti").join(gone.select(F.col("id").alias("earlier")), "earlier", "left_anti")
        left = cut_lineage(left)
        decided = stays.select("id").unionByName(gone.select("id"))
        stays = stays.unionByName(same.select("id").join(decided, "id", "left_anti").join(left.select("id"), "id", "left_anti"))
    # the first kept one like a row, not the first that was found
    if gone is not None:
        gone = pairs.join(gone.select("id"), "id", "left_semi").join(stays.select(F.col("id").alias("earlier")), "earlier", "left_semi").groupBy("id").agg(F.min("earlier").alias("first"))
    copies = rows.join(same.withColumnRenamed("id", "_one"), ["grp", "e", "shape"]).select("id", "_one")
    firsts = copies.join(gone.withColumnRenamed("id", "_one"), "_one", "left") if gone is not None else copies.withColumn("first", F.lit(None).cast(kind))
    return firsts.select(F.col("id").alias(id_col), F.coalesce("first", F.when(F.col("id") != F.col("_one"), F.col("_one"))).alias("first"))
