"""Lines, frames, pictures and tables of pages: boxes made from parts, vectors as pictures, order lines as cells.

Each query's docstring ends with the survey rows that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.operators import geometry as G
from quirelight.operators import relational as R
from quirelight.operators import sequences as Q
from quirelight.plans.layouts import _BOXES, boxes
from quirelight.plans.registry import query, read


@query(
    f"""WITH b AS ({_BOXES}) SELECT id, (x1 - x0) <= 0 OR (y1 - y0) <= 0 OR (x1 - x0) * (y1 - y0) < 0.010 OR least(x1 - x0, y1 - y0) < 0.055 OR greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) > 5.5 OR (id % 3 > 0 AND id % 200 < 90) AS small FROM b"""
)
def small_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are too small, too thin or of too few pixels for a picture; without a pixel count, that does not matter. FLT-20"""
    pixels = F.when(F.col("id") % 3 > 0, F.col("id") % 200)
    return boxes(spark, sf_dir).select("id", G.too_small(pixels, area=0.010, side=0.055, aspect=5.5, pixels=90).alias("small"))


@query(
    f"""WITH b AS ({_BOXES}) SELECT a.page, a.id, round(sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) AS density
    FROM b a JOIN b ON a.page = b.page AND a.id != b.id GROUP BY a.page, a.id, a.x0, a.x1, a.y0, a.y1"""
)
def covered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of all others of its page that lies in a box, over its own. AGG-18"""
    own = boxes(spark, sf_dir)
    pairs = G.box_pairs(own, own, "page", "id").filter("a_id != b_id")
    return pairs.groupBy("page", "a_id").agg(F.round(F.sum(G.overlap_area("a_", "b_")) / F.first(G.box_area("a_")), 6).alias("density")).withColumnRenamed("a_id", "id")


@query(
    f"""WITH b AS ({_BOXES}), o AS (SELECT a.page, a.id AS a_id, b.id AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS smaller
    FROM b a JOIN b ON a.page = b.page AND a.id < b.id) SELECT page, a_id, b_id FROM o WHERE common > 0.2 * smaller"""
)
def clashing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of a page that share over a fifth of the smaller one. JOIN-30"""
    own = boxes(spark, sf_dir)
    pairs = G.box_pairs(own, own, "page", "id", same=True)
    return pairs.filter(G.overlap_area("a_", "b_") > 0.2 * F.least(G.box_area("a_"), G.box_area("b_"))).select("page", "a_id", "b_id")


@query(
    f"""WITH b AS ({_BOXES}), t AS (SELECT * FROM b WHERE id % 3 = 0), p AS (SELECT * FROM b WHERE id % 3 != 0)
    SELECT page, id FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = p.page AND t.x0 >= p.x0 - 0.01 AND t.y0 >= p.y0 - 0.01 AND t.x1 <= p.x1 + 0.01 AND t.y1 <= p.y1 + 0.01 AND (t.x1 - t.x0) * (t.y1 - t.y0) >= 0.3 * (p.x1 - p.x0) * (p.y1 - p.y0))"""
)
def frames_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture frames that no text fills by three tenths from the inside. JOIN-16, JOIN-17"""
    own = boxes(spark, sf_dir)
    texts, pictures = own.filter("id % 3 = 0"), own.filter("id % 3 != 0")
    under = G.box_pairs(pictures, texts, "page", "id").filter(G.contained_share(margin=0.01) >= 0.3).select("page", F.col("a_id").alias("id"))
    return pictures.join(under, ["page", "id"], "left_anti").select("page", "id")


@query(
    f"""WITH b AS (SELECT b.*, CASE WHEN id % 28 = 0 THEN 'Foto: ' ELSE '' END || p_name AS text FROM ({_BOXES}) b JOIN part ON id = p_partkey), c AS (SELECT * FROM b WHERE id % 4 = 0), p AS (SELECT * FROM b WHERE id % 4 != 0),
    m AS (SELECT c.page, c.id AS caption, c.text, p.id AS picture, c.y0 - p.y1 AS gap FROM c JOIN p ON c.page = p.page AND c.y0 - p.y1 BETWEEN -0.012 AND 0.055 AND least(c.x1, p.x1) - greatest(c.x0, p.x0) >= 0.5 * greatest(p.x1 - p.x0, 1e-6) AND c.x1 - c.x0 <= 1.6 * greatest(p.x1 - p.x0, 1e-6)),
    n AS (SELECT page, caption, text, min(picture) AS met, arg_min(picture, (gap, picture)) AS picture FROM m GROUP BY ALL)
    SELECT page, picture, arg_min(caption, (met, caption)) AS caption, left(arg_min(text, (met, caption)), 400) AS text FROM n WHERE NOT regexp_matches(lower(trim(text)), '^(fotos?|bild|grafik):') GROUP BY page, picture"""
)
def captions_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions under pictures: close below, under at least half of the picture's width and no wider than 1.6 times it.

    A caption goes to the nearest such picture; of several, a picture has the one that met a picture first; lines that name a photographer are no captions. JOIN-19
    """
    name = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("a_id"), F.concat(F.when(F.col("p_partkey") % 28 == 0, "Foto: ").otherwise(""), F.col("p_name")).alias("text"))
    own = boxes(spark, sf_dir)
    pairs = G.box_pairs(own.filter("id % 4 = 0"), own.filter("id % 4 != 0"), "page", "id").withColumn("gap", F.col("a_y0") - F.col("b_y1"))
    wide = F.greatest(F.col("b_x1") - F.col("b_x0"), F.lit(1e-6))
    fits = F.col("gap").between(-0.012, 0.055) & (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0") >= 0.5 * wide) & (F.col("a_x1") - F.col("a_x0") <= 1.6 * wide)
    met = pairs.filter(fits).groupBy("page", "a_id").agg(F.min("b_id").alias("met"), F.min_by("b_id", F.struct("gap", "b_id")).alias("picture")).join(name, "a_id")
    told = met.filter(~F.regexp_like(F.lower(F.trim("text")), F.lit("^(fotos?|bild|grafik):")))
    best = told.groupBy("page", "picture").agg(F.min(F.struct("met", F.col("a_id").alias("caption"), "text")).alias("best"))
    return best.select("page", "picture", "best.caption", F.left("best.text", F.lit(400)).alias("text"))


@query(
    """WITH w AS (SELECT p_partkey // 10 AS line, p_partkey AS id, p_name AS text, p_size AS size, p_type AS font, (p_partkey * 7 % 16) / 16.0::DOUBLE AS x0 FROM part)
    SELECT line, min(x0) AS x0, max(x0) AS x1, string_agg(text, ' ' ORDER BY x0, id) AS text, median(size) AS size, max(size) AS most, arg_max(font, (n, -first)) AS font FROM (SELECT w.*, count(*) OVER (PARTITION BY line, font) AS n, min(id) OVER (PARTITION BY line, font) AS first FROM w) GROUP BY line"""
)
def line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a line has from its words: its ends, its text in order, the median and largest size, the most frequent type, of equals the first. AGG-13, AGG-11, AGG-12"""
    key = F.col("p_partkey")
    words = read(spark, sf_dir, "part").select(F.floor(key / 10).alias("line"), key.alias("id"), F.col("p_name").alias("text"), F.col("p_size").alias("size"), F.col("p_type").alias("font"), ((key * 7 % 16) / 16.0).alias("x0"))
    fonts = words.groupBy("line", "font").agg(F.count("*").alias("n"), F.min("id").alias("first")).groupBy("line").agg(F.max_by("font", F.struct("n", -F.col("first"))).alias("font"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", "text"))), lambda w: w["text"]), " ")
    lines = words.groupBy("line").agg(F.min("x0").alias("x0"), F.max("x0").alias("x1"), text.alias("text"), F.median("size").alias("size"), F.max("size").alias("most"))
    return lines.join(fonts, "line")


@query(
    f"""WITH b AS (SELECT id // 200 AS book, page, round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1, id FROM ({_BOXES})), p AS (SELECT book, count(DISTINCT page) AS n_pages FROM b GROUP BY book),
    r AS (SELECT book, x0, y0, x1, y1, count(DISTINCT page) AS pages FROM b GROUP BY ALL) SELECT b.id, b.book FROM b JOIN p USING (book) JOIN r USING (book, x0, y0, x1, y1) WHERE pages < greatest(4, CAST(floor(n_pages * 0.25) AS BIGINT))"""
)
def frames_that_do_not_recur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames but for those that stand in the same place on a quarter of the pages, rounded down, and on four at least. AGG-15"""
    rounded = [F.round(c, 2).alias(c) for c in G.BOX]
    frames = boxes(spark, sf_dir).select("id", F.floor(F.col("id") / 200).alias("book"), "page", *rounded)
    pages = frames.groupBy("book").agg(F.count_distinct("page").alias("n_pages"))
    places = frames.groupBy("book", *G.BOX).agg(F.count_distinct("page").alias("pages")).join(pages, "book")
    recurring = places.filter(F.col("pages") >= F.greatest(F.lit(4), F.floor(F.col("n_pages") * 0.25)))
    return frames.join(recurring, ["book", *G.BOX], "left_anti").select("id", "book")


@query(
    f"""WITH b AS ({_BOXES}) SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_max(id, (y1 - y0, -y0, -id)) AS title, count(DISTINCT (round_even(least(1, x0), 1), round_even(least(1, y0), 1))) AS regions, array_to_string(list_sort(list(id)), ',') AS frames FROM b GROUP BY page"""
)
def page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box round a page's frames, the largest as its title (of equals the topmost), distinct regions clamped to the page, and the frames. AGG-37, AGG-41, AGG-46, AGG-48, GEO-03"""
    clamped = [F.bround(F.least(F.lit(1.0), F.col(c)), 1) for c in ("x0", "y0")]
    return boxes(spark, sf_dir).groupBy("page").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max_by("id", F.struct(F.col("y1") - F.col("y0"), -F.col("y0"), -F.col("id"))).alias("title"), F.count_distinct(F.struct(*clamped)).alias("regions"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("frames")
    )


@query(
    """WITH a AS (SELECT l_orderkey AS article, sum(CASE WHEN l_returnflag != 'N' THEN CAST(l_extendedprice AS BIGINT) % 400 END) AS body, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS first, count(DISTINCT l_suppkey) AS pages FROM lineitem GROUP BY l_orderkey)
    SELECT article, greatest(CAST(0.05 AS DOUBLE), round(CAST(1.0 AS DOUBLE) - CASE WHEN coalesce(body, 0) < 280 THEN 0.35 ELSE 0 END - CASE WHEN first != 'A' THEN 0.25 ELSE 0 END - CASE WHEN pages > 6 THEN 0.15 ELSE 0 END - CASE WHEN first = 'R' THEN 0.2 ELSE 0 END, 2)) AS confidence FROM a"""
)
def article_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure an article is: less for little text, no heading in front, many pages, or a start in small letters. AGG-36"""
    body = F.sum(F.when(F.col("l_returnflag") != "N", F.rint("l_extendedprice").cast("long") % 400))  # halves go to the even number, as in SQL
    first = F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    found = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article")).agg(body.alias("body"), first.alias("first"), F.count_distinct("l_suppkey").alias("pages"))
    loss = lambda test, by: F.when(test, by).otherwise(0.0)
    score = 1.0 - loss(F.coalesce("body", F.lit(0)) < 280, 0.35) - loss(F.col("first") != "A", 0.25) - loss(F.col("pages") > 6, 0.15) - loss(F.col("first") == "R", 0.2)
    return found.select("article", F.greatest(F.lit(0.05), F.round(score, 2)).alias("confidence"))


@query(
    """WITH p AS (SELECT p_brand AS book, p_partkey AS index, CASE WHEN p_size % 4 = 0 THEN CAST(p_partkey + p_size AS VARCHAR) WHEN p_size % 4 = 1 THEN 'II' ELSE ' ' END AS label FROM part)
    SELECT book, coalesce(arg_min(CAST(label AS BIGINT) - index, index) FILTER (regexp_full_match(trim(label), '[0-9]+')), 0) AS shift FROM (SELECT book, index, CASE WHEN regexp_full_match(trim(label), '[0-9]+') THEN label ELSE NULL END AS label FROM p) GROUP BY book"""
)
def printed_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much printed page numbers differ from places, from a book's first page with a number; 0 without one. AGG-47"""
    key, size = F.col("p_partkey"), F.col("p_size")
    label = F.when(size % 4 == 0, (key + size).cast("string")).when(size % 4 == 1, "II").otherwise(" ")
    pages = read(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), key.alias("index"), F.trim(label).try_cast("long").alias("number"))
    shift = F.min_by(F.col("number") - F.col("index"), F.when(F.col("number").isNotNull(), F.col("index")))
    return pages.groupBy("book").agg(F.coalesce(shift, F.lit(0)).alias("shift"))


@query(
    """WITH s AS (SELECT p_brand AS book, p_partkey AS page, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS following FROM part WHERE p_size % 5 = 0)
    SELECT p_partkey AS page, s.page AS article FROM part LEFT JOIN s ON p_brand = book AND p_partkey >= s.page AND (following IS NULL OR p_partkey < following)"""
)
def articles_by_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page: the last one that began at or before it. WIN-15, WIN-28, JOIN-13"""
    part = read(spark, sf_dir, "part")
    span = Window.partitionBy("p_brand").orderBy("p_partkey")
    start = F.when(F.col("p_size") % 5 == 0, F.col("p_partkey"))
    return part.select(F.col("p_partkey").alias("page"), F.last(start, ignorenulls=True).over(span).alias("article"))


@query(
    """WITH t AS (SELECT conv_id, turn, length(text) AS n, role FROM conversations), f AS (SELECT *, CASE WHEN n < 280 AND role != 'system' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS own FROM t), g AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM f)
    SELECT conv_id, CAST(part AS BIGINT) AS part, min(turn) AS first, CAST(sum(n) AS BIGINT) AS n_chars, count(*) AS n_turns FROM g GROUP BY ALL"""
)
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short parts without a title, joined to the one before them. WIN-17"""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    marked = Q.islands(turns, ["conv_id"], ["turn"], ~((F.col("n") < 280) & (F.col("role") != "system")), "part")
    return marked.groupBy("conv_id", "part").agg(F.min("turn").alias("first"), F.sum("n").alias("n_chars"), F.count("*").alias("n_turns"))


@query(
    """WITH s AS (SELECT p_partkey, p_brand, p_size, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part), r AS (SELECT *, sum(CASE WHEN before IS NULL OR abs(p_size - before) > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS run FROM s)
    SELECT p_brand, CAST(run AS BIGINT) AS run, min(p_partkey) AS first, count(*) AS n FROM r GROUP BY ALL"""
)
def size_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches without a jump of the size. WIN-34"""
    before = F.lag("p_size").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    marked = Q.islands(read(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], F.abs(F.col("p_size") - before) > 20, "run")
    return marked.groupBy("p_brand", "run").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT p_partkey, p_size AS page, p_type = 'PROMO' AND p_retailprice < 1400 AS short FROM part), n AS (SELECT *, count(*) FILTER (short) OVER (PARTITION BY page) AS shorts FROM a)
    SELECT page, CASE WHEN short AND shorts >= 2 THEN -1 ELSE p_partkey END AS part, count(*) AS n, min(p_partkey) AS head FROM n GROUP BY ALL"""
)
def grouped_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two short notices of a page or more as one group under their first; all others alone. WIN-33, UDF-13"""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("page"), ((F.col("p_type") == "PROMO") & (F.col("p_retailprice") < 1400)).alias("short"))
    shorts = part.groupBy("page").agg(F.count_if("short").alias("shorts"))
    group = F.when(F.col("short") & (F.col("shorts") >= 2), F.lit(-1)).otherwise(F.col("p_partkey"))
    return part.join(shorts, "page").groupBy("page", group.alias("part")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("head"))


@query(
    """WITH p AS (SELECT p_partkey, 600 + p_partkey % 3000 AS w, 400 + p_size * 70 AS h, p_size % 3 AS level FROM part)
    SELECT p_partkey, CAST(CASE WHEN greatest(w, h) <= 1200 THEN w ELSE greatest(1, floor(w * (1200 / greatest(w, h)) + 0.5)) END AS BIGINT) AS width, CAST(CASE WHEN greatest(w, h) <= 1200 THEN h ELSE greatest(1, floor(h * (1200 / greatest(w, h)) + 0.5)) END AS BIGINT) AS height,
      (SELECT min(l) FROM range(1, 13) r(l) WHERE (CAST(greatest(w, h) AS BIGINT) >> CAST(l AS BIGINT)) <= 512) AS levels, CAST(ceil(ceil(w / pow(2, level)) / 512) AS BIGINT) AS tile_columns, CAST(least(w, 512 * pow(2, level)) AS BIGINT) AS first_tile_width, greatest(0, (w - 1000) / 2) AS cut_left, least(w, 1000) AS cut_width FROM p"""
)
def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes capped at the longest edge, levels and tiles of a pyramid, and the cut to the trim size. GEO-19, GEO-20, GEO-27, GEO-28"""
    w, h, scale = F.col("w"), F.col("h"), F.pow(F.lit(2), F.col("p_size") % 3)
    sized = read(spark, sf_dir, "part").select("p_partkey", "p_size", (600 + F.col("p_partkey") % 3000).alias("w"), (400 + F.col("p_size") * 70).cast("long").alias("h"))
    most = F.greatest(w, h)
    capped = lambda x: F.when(most <= 1200, x).otherwise(F.greatest(F.lit(1), F.floor(x * (1200 / most) + 0.5))).cast("long")
    levels = F.greatest(F.lit(1), F.floor(F.log2(most / F.lit(513.0))) + 1).cast("long")
    return sized.select(
        "p_partkey", capped(w).alias("width"), capped(h).alias("height"), levels.alias("levels"), F.ceil(F.ceil(w / scale) / 512).cast("long").alias("tile_columns"), F.least(w, 512 * scale).cast("long").alias("first_tile_width"), F.greatest(F.lit(0.0), (w - 1000) / 2).alias("cut_left"), F.least(w, F.lit(1000).cast("long")).alias("cut_width")
    )


@query(
    f"""WITH b AS ({_BOXES}), h AS (SELECT *, CASE id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.1 ELSE 0.8 END::DOUBLE AS l, CASE id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.8 ELSE 1.5 END::DOUBLE AS r FROM b)
    SELECT id, round((x0 - l) / (r - l), 6) AS x0, round((2 - y1) / 2, 6) AS y0, round((x1 - l) / (r - l), 6) AS x1, round((2 - y0) / 2, 6) AS y1, x1 > l AND x0 < r AS visible FROM h"""
)
def boxes_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a sheet in the measures of its whole, left or right half, counted from the top; whether they can be seen there. GEO-15, GEO-16, GEO-30"""
    left, right = 0.1, 1.5
    half = F.col("id") % 3
    l, r = F.when(half == 2, (left + right) / 2).otherwise(left), F.when(half == 1, (left + right) / 2).otherwise(right)  # noqa: E741
    share = lambda x: F.round((F.col(x) - l) / (r - l), 6)
    flipped = lambda y: F.round((2 - F.col(y)) / 2, 6)
    return boxes(spark, sf_dir).select("id", share("x0").alias("x0"), flipped("y1").alias("y0"), share("x1").alias("x1"), flipped("y0").alias("y1"), ((F.col("x1") > l) & (F.col("x0") < r)).alias("visible"))


@query(
    f"""WITH b AS ({_BOXES}), m AS (SELECT *, 2.0::DOUBLE AS a, (id % 5) / 2.0::DOUBLE AS c, 0.5::DOUBLE AS d, 1.0::DOUBLE AS e, 0.25::DOUBLE AS f FROM b)
    SELECT id, least(a * x0 + c * y0, a * x1 + c * y0, a * x0 + c * y1, a * x1 + c * y1) + e AS left, least(d * y0, d * y1) + f AS top, greatest(a * x0 + c * y0, a * x1 + c * y0, a * x0 + c * y1, a * x1 + c * y1) + e AS right, greatest(d * y0, d * y1) + f AS bottom FROM m"""
)
def transformed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of boxes after an affine map, which is the product of a shear with a stretch and a move. GEO-12, GEO-13"""
    shear = G.affine(1.0, 0.0, F.col("id") % 5 / 4.0, 1.0, 0.0, 0.0)
    whole = G.affine_product(shear, G.affine(2.0, 0.0, 0.0, 0.5, 1.0, 0.25))
    moved = boxes(spark, sf_dir).select("id", G.bounds_after(whole).alias("b"))
    return moved.select("id", "b.left", "b.top", "b.right", "b.bottom")


@query(
    """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, 1 + CAST(vec_id % 3 AS DOUBLE) * 0.02 AS aspect, CASE WHEN vec_id % 4 > 0 THEN 'caption ' || vec_id END AS caption, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
    walk AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS first, [struct_pack(id := CAST(NULL AS BIGINT), e := CAST([] AS DOUBLE[]), aspect := CAST(0 AS DOUBLE))][2:] AS kept FROM v GROUP BY label
      UNION ALL SELECT label, k, vec_id, first, CASE WHEN first IS NULL THEN list_append(kept, struct_pack(id := vec_id, e := e, aspect := aspect)) ELSE kept END FROM
      (SELECT v.label, v.k, v.vec_id, v.e, v.aspect, w.kept, list_filter(w.kept, lambda x: abs(x.aspect - v.aspect) <= 0.03 * greatest(x.aspect, v.aspect) AND list_distance(x.e, v.e) / sqrt(len(v.e)) < 0.1)[1].id AS first FROM walk w JOIN v ON v.label = w.label AND v.k = w.k + 1)),
    j AS (SELECT walk.vec_id, first, caption FROM walk JOIN v USING (vec_id)), more AS (SELECT first, arg_min(caption, vec_id) FILTER (caption IS NOT NULL) AS caption FROM j WHERE first IS NOT NULL GROUP BY first)
    SELECT j.vec_id, j.first IS NULL AS kept, CASE WHEN j.first IS NULL THEN coalesce(j.caption, more.caption) END AS caption FROM j LEFT JOIN more ON more.first = j.vec_id"""
)
def first_of_alike_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures of an article without those that hardly differ from one kept before, in shape and by the root mean square of their fingerprints; what these were captioned goes to the kept one. GEO-22, SET-11"""
    key = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select(key, "label", F.col("embedding").cast("array<double>").alias("e"), (1 + (key % 3).cast("double") * 0.02).alias("aspect"), F.when(key % 4 > 0, F.concat(F.lit("caption "), key.cast("string"))).alias("caption"))
    alike = G.first_of_alike(rows, "vec_id", "label", "e", 0.1, "aspect", 0.03)
    joined = rows.join(alike, "vec_id")
    more = joined.filter("first IS NOT NULL AND caption IS NOT NULL").groupBy(F.col("first").alias("vec_id")).agg(F.min_by("caption", "vec_id").alias("more"))
    kept = F.col("first").isNull()
    return joined.join(more, "vec_id", "left").select("vec_id", kept.alias("kept"), F.when(kept, F.coalesce("caption", "more")).alias("caption"))
