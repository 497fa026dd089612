"""Entries of a printed contents page laid on the lines that print them.

items: page, id, text, x0, y0, x1, y1 (shares of the page).  They become segments: lines, cut at gaps between
columns.  An entry's title is found where a segment, and those below it in its column, use up its text letter by letter; where it is
not, the printed number tells, if it stands just once.  What the lines of an entry cover is its box, and neighbours that lap a
little share the difference.

Joins are equal joins on the page, which holds a bounded number of items; a walk in order over sorted batches, with eight lines of
state, makes the lines, and one task sees the boxes of one page where neighbours are parted.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.functions.text import bound
from quirelight.operators.geometry import BOX, box_pairs, overlap_area
from quirelight.sources.folders import cut_lineage

# Fixed values, as shares of the page or of a line's height.
COLUMN_GAP, FLUSH, LINE_GAP, NUMBER_REACH, EDGE_REACH = 0.025, 0.02, 0.6, 0.35, 0.08
MARGIN_X, MARGIN_Y, TITLE_LINES, DETAIL_LINES = 0.004, 0.003, 4, 6
# Ligatures of typeset text.
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ß", "ss"))


def letters(text: Column) -> Column:
    """Letters and digits of any script in small letters, ligatures resolved: how printed text is compared."""
    def plain(low: Column) -> Column:
        for sign, written in _LIGATURES:
            low = F.replace(low, F.lit(sign), F.lit(written))
        return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")

    return bound(F.lower(text), plain)


def without_number(text: Column, number: Column) -> Column:
    """The text without the printed number before or behind it, null if it has none."""
    def cut(s: Column) -> Column:
        t, z = s["t"], s["z"]
        return (
            F.when(t == z, "")
            .when(F.startswith(t, F.concat(z, F.lit(" "))), F.substring(t, F.length(z) + 2, F.length(t)))
            .when(F.endswith(t, F.concat(F.lit(" "), z)), F.substring(t, F.lit(1), F.length(t) - F.length(z) - 1))
        )

    return bound(F.struct(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("t"), number.cast("string").alias("z")), cut)


def segments(items: DataFrame) -> DataFrame:
    """(page, seg, text, x0, y0, x1, y1, text_x0, text_y1, text_height, number): lines cut at column gaps, numbered by height and side.

    Two items share a line if the middle of each lies in the height of the other, the line's first item standing for it; the last
    eight lines are asked, the newest first.  An item that is a number is a segment of its own.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "line long"])

    def walk(batches):
        page, n, last = None, 0, deque(maxlen=8)
        for pdf in batches:
            lines = []
            for p, text, y0, y1 in zip(pdf["page"].tolist(), pdf["text"].tolist(), pdf["y0"].tolist(), pdf["y1"].tolist(), strict=True):
                if p != page:
                    page, n = p, 0
                    last.clear()
                if text.strip().isdigit():
                    lines.append(-1)
                    continue
                middle = (y0 + y1) / 2
                found = next((k for k, a, b in reversed(last) if a <= middle <= b and y0 <= (a + b) / 2 <= y1), None)
                if found is None:
                    found, n = n, n + 1
                    last.append((found, y0, y1))
                lines.append(found)
            yield pdf.assign(line=pd.Series(lines, index=pdf.index, dtype="int64"))

    lined = items.repartition("page").sortWithinPartitions("page", "y0", "x0", "id").mapInPandas(walk, schema)
    lined = lined.withColumn("line", F.when(F.col("line") < 0, F.col("id") + (1 << 40)).otherwise(F.col("line")))
    along = Window.partitionBy("page", "line").orderBy("x0", "id")
    before = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    lined = lined.withColumn("_new", F.coalesce((F.col("x0") - before > COLUMN_GAP).cast("int"), F.lit(0)))
    lined = lined.withColumn("piece", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    digits = F.regexp_like(F.trim("text"), F.lit("^[0-9]+$"))
    worded = lambda f, c: F.coalesce(f(F.when(~digits, c)), f(c))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", F.trim("text").alias("text")))), lambda i: i["text"])
    made = lined.groupBy("page", "line", "piece").agg(
        F.array_join(words, " ").alias("text"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
        worded(F.min, F.col("x0")).alias("text_x0"), worded(F.max, F.col("y1")).alias("text_y1"), worded(F.max, F.col("y1") - F.col("y0")).alias("text_height"),
    )
    bare = F.replace("text", F.lit(" "), F.lit(""))
    number = F.when(F.regexp_like(bare, F.lit("^[0-9]{1,18}$")), bare.cast("long"))
    seg = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "line", "piece"))
    return made.select("page", seg.alias("seg"), "text", *BOX, "text_x0", "text_y1", "text_height", number.alias("number"))


def _named(segs: DataFrame, prefix: str) -> DataFrame:
    return segs.select("page", *[F.col(c).alias(prefix + c) for c in segs.columns if c != "page"])


def _laps(a: str, b: str) -> Column:
    return F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")


def _apart(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{a}x0") - F.col(f"{b}x1"), F.col(f"{b}x0") - F.col(f"{a}x1"))


def lines_below(segs: DataFrame) -> DataFrame:
    """(page, seg, below): the next segment right under each one in its column.

    It begins flush with the text, with the segment, or with a number that stands beside it.
    """
    words = segs.filter("number IS NULL")
    beside = _named(segs, "a_").join(_named(segs.filter("number IS NOT NULL"), "n_"), "page")
    beside = beside.filter((F.col("a_seg") != F.col("n_seg")) & (_laps("n_", "a_") >= 0.3 * (F.col("n_y1") - F.col("n_y0"))) & (_apart("n_", "a_") <= EDGE_REACH))
    edges = beside.groupBy("page", F.col("a_seg").alias("seg")).agg(F.collect_set("n_x0").alias("more"))
    own = segs.join(edges, ["page", "seg"], "left").withColumn("edges", F.concat(F.array("text_x0", "x0"), F.coalesce("more", F.array().cast("array<double>")))).drop("more")
    pairs = _named(own, "a_").join(_named(words, "b_"), "page")
    under = (F.col("a_seg") != F.col("b_seg")) & (F.col("b_y0") >= F.col("a_text_y1") - 0.3 * F.col("a_text_height"))
    flush = F.exists("a_edges", lambda e: F.abs(F.col("b_text_x0") - e) <= FLUSH)
    near = pairs.filter(under & flush).groupBy("page", "a_seg").agg(F.min(F.struct("b_y0", "b_seg", F.struct("a_text_y1", "a_text_height", "b_text_height").alias("h"))).alias("m"))
    height = F.greatest("m.h.a_text_height", "m.h.b_text_height", F.lit(0.004))
    return near.filter(F.col("m.b_y0") - F.col("m.h.a_text_y1") <= LINE_GAP * height).select("page", F.col("a_seg").alias("seg"), F.col("m.b_seg").alias("below"))


def _follow(paths: DataFrame, segs: DataFrame, below: DataFrame, steps: int, readings: Callable[[Column], list[Column]]) -> DataFrame:
    """paths (page, at, got, want, lines, ...) followed downwards while the text of the next line, in its first reading that fits, goes on with `want`."""
    following = below.join(segs.select("page", F.col("seg").alias("below"), F.col("text").alias("_text")), ["page", "below"]).withColumnsRenamed({"seg": "at", "below": "_below"})
    paths = paths.withColumn("_open", F.lit(True))
    for _ in range(steps):
        joined = paths.join(following, ["page", "at"], "left")
        read = F.array(*[letters(x) for x in readings(F.col("_text"))])
        fits = bound(F.struct(read.alias("r"), F.col("got").alias("g"), F.col("want").alias("w")), lambda s: F.get(F.filter(s["r"], lambda r: (r != "") & F.startswith(s["w"], F.concat(s["g"], r))), F.lit(0)))
        joined = joined.withColumn("_more", F.when(F.col("_open") & (F.col("got") != F.col("want")), fits))
        goes = F.col("_more").isNotNull()
        paths = joined.withColumns(
            {"got": F.when(goes, F.concat("got", "_more")).otherwise(F.col("got")), "at": F.when(goes, F.col("_below")).otherwise(F.col("at")), "lines": F.when(goes, F.array_append("lines", F.col("_below"))).otherwise(F.col("lines")), "_open": goes}
        ).drop("_text", "_below", "_more")
        paths = cut_lineage(paths)
        if paths.filter("_open").isEmpty():
            break
    return paths.drop("_open")


def _by_title(entries: DataFrame, segs: DataFrame, below: DataFrame) -> DataFrame:
    """(entry, lines) of the entries whose whole title stands on the page, at the place nearest to where it was guessed."""
    want = entries.select("page", "entry", "printed", F.col("x0").alias("guess_x"), F.col("y0").alias("guess_y"), letters(F.col("label")).alias("want")).filter("want != ''")
    readings = lambda text: [without_number(text, F.col("printed")), text]
    starts = want.join(segs.filter("number IS NULL").select("page", F.col("seg").alias("at"), "text", "text_x0", F.col("y0").alias("line_y")), "page")
    way = F.posexplode(F.array(*[letters(r) for r in readings(F.col("text"))])).alias("reading", "got")
    starts = starts.select("*", way).filter((F.col("got") != "") & F.startswith("want", "got"))
    starts = starts.withColumns({"first": F.col("at"), "lines": F.array("at"), "far": F.abs(F.col("text_x0") - F.col("guess_x")) + F.abs(F.col("line_y") - F.col("guess_y"))})
    ended = _follow(starts.drop("text"), segs, below, TITLE_LINES - 1, readings).filter("got = want")
    return ended.groupBy("entry").agg(F.min_by("lines", F.struct("far", "first", "reading")).alias("lines"))


def _by_number(entries: DataFrame, titled: DataFrame, segs: DataFrame) -> DataFrame:
    """(entry, lines, beside) of other entries whose number stands just once among what earlier entries have left.

    titled: entry, page, used (the segment that it holds).  What an entry holds matters to later ones of the same page and number only, so a fold over these few decides.
    """
    open_ = entries.filter("printed IS NOT NULL").join(titled, "entry", "left_anti").select("page", "entry", "printed")
    free = open_.join(segs.filter("number IS NOT NULL").withColumnRenamed("number", "printed"), ["page", "printed"]).select("page", "entry", "printed", "seg", F.lit(False).alias("inline"))
    rest = without_number(F.col("text"), F.col("printed"))
    inline = open_.join(segs.filter("number IS NULL").select("page", "seg", "text"), "page").filter(F.coalesce(rest, F.lit("")) != "").select("page", "entry", "printed", "seg", F.lit(True).alias("inline"))
    held = titled.groupBy("page", F.col("used").alias("seg")).agg(F.min("entry").alias("by"))
    # a number's own line: the nearest text beside it
    sides = _named(segs.filter("number IS NOT NULL"), "n_").join(_named(segs.filter("number IS NULL"), "t_"), "page")
    least = F.least(F.col("n_y1") - F.col("n_y0"), F.col("t_y1") - F.col("t_y0"))
    sides = sides.filter((_laps("n_", "t_") >= 0.3 * least) & (_apart("n_", "t_") <= NUMBER_REACH))
    sides = sides.groupBy("page", F.col("n_seg").alias("seg")).agg(F.min_by("t_seg", F.struct(_apart("n_", "t_"), "t_seg")).alias("line"))
    offers = free.unionByName(inline).join(held, ["page", "seg"], "left").join(sides, ["page", "seg"], "left")
    offers = offers.filter("by IS NULL OR by >= entry").withColumn("line", F.when(F.col("inline"), F.col("seg")).otherwise(F.col("line")))
    each = offers.groupBy("page", "printed", "entry").agg(F.array_sort(F.collect_list(F.struct("seg", "line", "inline"))).alias("offers"))
    turns = each.groupBy("page", "printed").agg(F.array_sort(F.collect_list(F.struct("entry", "offers"))).alias("turns"))

    def decide(state: Column, turn: Column) -> Column:
        left = F.filter(turn["offers"], lambda o: ~F.array_contains(state["used"], o["seg"]))
        one = bound(left, lambda o: F.when((F.size(o) == 1) & F.get(o, F.lit(0))["line"].isNotNull(), F.get(o, F.lit(0))))

        def put(o: Column) -> Column:
            made = F.struct(turn["entry"].alias("entry"), o["seg"].alias("used"), o["line"].alias("line"), o["inline"].alias("inline"))
            return F.struct(F.when(o.isNotNull(), F.array_append(state["used"], o["seg"])).otherwise(state["used"]).alias("used"), F.when(o.isNotNull(), F.array_append(state["out"], made)).otherwise(state["out"]).alias("out"))

        return bound(one, put)

    kinds = {f.name: f.dataType.simpleString() for f in offers.schema}
    start = F.struct(F.array().cast(f"array<{kinds['seg']}>").alias("used"), F.array().cast(f"array<struct<entry:{kinds['entry']},used:{kinds['seg']},line:{kinds['line']},inline:boolean>>").alias("out"))
    folded = turns.select(F.inline(F.aggregate("turns", start, decide, lambda s: s["out"])))
    return folded.select("entry", F.array("line").alias("lines"), F.when(~F.col("inline"), F.col("used")).alias("beside"))


def parted(boxes: DataFrame, page: str, key: str) -> DataFrame:
    """boxes with those of a page that stand under one another, lapping by less than half the lower height, ending and beginning in the middle of the lap.

    Boxes are taken by height and side, each with those after it, and what one pair moves the next one sees.
    """

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0", key]).reset_index(drop=True)
        x0, y0, x1, y1 = (pdf[c].tolist() for c in BOX)
        for i in range(len(pdf)):
            for j in range(i + 1, len(pdf)):
                width = min(x1[i] - x0[i], x1[j] - x0[j])
                lap = y1[i] - y0[j]
                if width > 0 and min(x1[i], x1[j]) - max(x0[i], x0[j]) >= 0.5 * width and 0 < lap <= 0.5 * min(y1[i] - y0[i], y1[j] - y0[j]):
                    y1[i] = y0[j] = (y1[i] + y0[j]) / 2
        return pdf.assign(y0=y0, y1=y1)

    return boxes.groupBy(page).applyInPandas(part, boxes.schema)


def placed_entries(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(entry, page, how, x0, y0, x1, y1): how is title, number, none (no box then) or no text (the guess stays).

    entries: entry, in the order in which they hold what they find; page, label, details, printed (number or null), and the guessed x0, y0, x1, y1.
    """
    # both are read in many steps, and what they are made from is not read again
    entries, items = cut_lineage(entries), cut_lineage(items)
    segs = cut_lineage(segments(items))
    below = cut_lineage(lines_below(segs))
    with_text = entries.join(items.select("page").distinct(), "page", "left_semi")
    titled = cut_lineage(_by_title(with_text, segs, below).join(with_text.select("entry", "page", "printed", "details"), "entry"))
    # the number beside a title whose lines do not tell it
    parts = titled.select("entry", "page", "printed", F.explode("lines").alias("seg")).join(segs.select("page", "seg", "text", *BOX), ["page", "seg"])
    told = F.bool_or(without_number(F.col("text"), F.col("printed")).isNotNull())
    frames = parts.groupBy("entry", "page", "printed").agg(told.alias("told"), *[F.min(c).alias(f"t_{c}") for c in ("x0", "y0")], *[F.max(c).alias(f"t_{c}") for c in ("x1", "y1")]).filter("NOT coalesce(told, false)")
    numbers = frames.join(_named(segs.filter("number IS NOT NULL"), "n_").withColumnRenamed("n_number", "printed"), ["page", "printed"])
    numbers = numbers.filter((_laps("n_", "t_") >= 0.3 * (F.col("n_y1") - F.col("n_y0"))) & (_apart("n_", "t_") <= NUMBER_REACH))
    numbers = numbers.groupBy("entry").agg(F.min_by("n_seg", F.struct(_apart("n_", "t_"), "n_seg")).alias("beside"))
    titled = cut_lineage(titled.join(numbers, "entry", "left"))
    used = titled.select("entry", "page", F.coalesce("beside", F.get("lines", F.lit(0))).alias("used"))
    numbered = cut_lineage(_by_number(with_text, used, segs))
    # the lines of the details under the title
    details = titled.select("entry", "page", F.element_at("lines", -1).alias("at"), F.lit("").alias("got"), letters(F.col("details")).alias("want"), F.array().cast("array<int>").alias("lines")).filter("want != ''")
    details = _follow(details, segs, below, DETAIL_LINES, lambda text: [text]).select("entry", F.col("lines").alias("more"))
    found = titled.select("entry", "lines", "beside", F.lit("title").alias("how")).unionByName(numbered.withColumn("how", F.lit("number")))
    found = found.join(details, "entry", "left").withColumn("parts", F.concat("lines", F.coalesce("more", F.array().cast("array<int>")), F.when(F.col("beside").isNotNull(), F.array("beside")).otherwise(F.array().cast("array<int>"))))
    each = found.join(entries.select("entry", "page"), "entry").select("entry", "page", "how", F.explode("parts").alias("seg")).join(segs.select("page", "seg", *BOX), ["page", "seg"])
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    covered = each.groupBy("entry", "page", "how").agg(
        clamp(F.min("x0") - MARGIN_X).alias("x0"), clamp(F.min("y0") - MARGIN_Y).alias("y0"), clamp(F.max("x1") + MARGIN_X).alias("x1"), clamp(F.max("y1") + MARGIN_Y).alias("y1")
    )
    guessed = entries.join(items.select("page").distinct(), "page", "left_anti").select("entry", "page", F.lit("no text").alias("how"), *BOX)
    boxed = parted(covered.unionByName(guessed), "page", "entry")
    nowhere = with_text.join(found, "entry", "left_anti").select("entry", "page", F.lit("none").alias("how"), *[F.lit(None).cast("double").alias(c) for c in BOX])
    return boxed.unionByName(nowhere)


def balance(placed: DataFrame) -> DataFrame:
    """(page, entries, by_title, by_number, unplaced, no_text, overlapping): overlapping counts pairs of boxes that share over a fifth of the smaller one."""
    placed = cut_lineage(placed)
    count = lambda how: F.count_if(F.col("how") == how)
    sums = placed.groupBy("page").agg(F.count("*").alias("entries"), count("title").alias("by_title"), count("number").alias("by_number"), count("none").alias("unplaced"), count("no text").alias("no_text"))
    boxed = placed.filter("x0 IS NOT NULL")
    size = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    smaller = F.least(size("a_"), size("b_"))
    laps = box_pairs(boxed, boxed, "page", "entry", same=True).filter((smaller > 0) & (overlap_area("a_", "b_") > 0.2 * smaller))
    return sums.join(laps.groupBy("page").agg(F.count("*").alias("overlapping")), "page", "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(0)).cast("long"))
