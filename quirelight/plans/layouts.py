"""Page geometry on boxes that are made from parts, twenty a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.operators import geometry as G
from quirelight.plans.registry import query, read

_BOXES = "SELECT p_partkey AS id, p_partkey // 20 AS page, (p_partkey * 7 % 16) / 16.0 AS x0, (p_partkey * 5 % 32) / 32.0 AS y0, (p_partkey * 7 % 16) / 16.0 + (1 + p_size % 16) / 64.0 AS x1, (p_partkey * 5 % 32) / 32.0 + (1 + p_size % 8) / 64.0 AS y1 FROM part"
_BOXES = _BOXES.replace("16.0", "CAST(16 AS DOUBLE)").replace("32.0", "CAST(32 AS DOUBLE)").replace("64.0", "CAST(64 AS DOUBLE)")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, page, x0, y0, x1, y1); all sides are multiples of 1/64."""
    key, size = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (key * 7 % 16) / 16.0, (key * 5 % 32) / 32.0
    return read(spark, sf_dir, "part").select(key.alias("id"), F.floor(key / 20).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + (1 + size % 16) / 64.0).alias("x1"), (y0 + (1 + size % 8) / 64.0).alias("y1"))


@query(
    f"""WITH b AS ({_BOXES}), p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common,
    (a.x1 - a.x0) * (a.y1 - a.y0) AS one, (b.x1 - b.x0) * (b.y1 - b.y0) AS other FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
    SELECT page, a_id, b_id, round(common / (one + other - common), 6) AS iou FROM p WHERE common > 0"""
)
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of a page that overlap, with intersection over union."""
    own = boxes(spark, sf_dir)
    pairs = G.box_pairs(own, own, "page", "id", same=True).filter(G.overlap_area("a_", "b_") > 0)
    return pairs.select("page", "a_id", "b_id", F.round(G.iou("a_", "b_"), 6).alias("iou"))


@query(
    f"""WITH b AS ({_BOXES}) SELECT a.page, a.id AS a_id, b.id AS b_id, round((b.x1 - b.x0) * (b.y1 - b.y0) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) AS share
    FROM b a JOIN b ON a.page = b.page AND a.id != b.id WHERE b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1"""
)
def boxes_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that lie in another of their page, with the share of it that they fill."""
    own = boxes(spark, sf_dir)
    pairs = G.box_pairs(own, own, "page", "id").filter("a_id != b_id").withColumn("share", F.round(G.contained_share(), 6))
    return pairs.filter("share IS NOT NULL").select("page", "a_id", "b_id", "share")


@query(
    f"""WITH b AS ({_BOXES}), d AS (SELECT *, pow(greatest(x0 - 0.5, 0, 0.5 - x1), 2) + pow(greatest(y0 - 0.5, 0, 0.5 - y1), 2) AS distance FROM b)
    SELECT page, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY distance, id) AS k FROM d) WHERE k = 1"""
)
def box_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each page that is nearest to its centre."""
    near = boxes(spark, sf_dir).withColumn("distance", G.point_distance(F.lit(0.5), F.lit(0.5)))
    best = near.groupBy("page").agg(F.min(F.struct("distance", "id")).alias("best"))
    return best.select("page", "best.id", "best.distance")


@query(
    f"""WITH b AS ({_BOXES}), u AS (SELECT DISTINCT page, unnest(range(CAST(floor(x0 / 0.03125) AS BIGINT), CAST(floor(x1 / 0.03125) AS BIGINT) + 1)) AS bin FROM b),
    n AS (SELECT *, lead(bin) OVER (PARTITION BY page ORDER BY bin) AS following FROM u)
    SELECT page, bin + 1 AS first_bin, following - bin - 1 AS bins FROM n WHERE following - bin > 1"""
)
def page_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty strips between the boxes of a page."""
    found = G.gutters(boxes(spark, sf_dir), "page", 0.03125, 1)
    return found.select("page", F.col("first_bin").cast("long").alias("first_bin"), F.col("bins").cast("long").alias("bins"))


@query(
    f"""WITH w AS (SELECT p_partkey // 400 AS page, x0, p_size FROM ({_BOXES}) JOIN part ON p_partkey = id), m AS (SELECT page, median(p_size) AS body FROM w GROUP BY page), b AS (SELECT w.* FROM w JOIN m USING (page) WHERE abs(p_size - body) < 0.18 * body),
    c AS (SELECT page, CAST(floor(x0 / 0.03125) AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY page) AS total FROM c),
    p AS (SELECT page, list([bin * CAST(0.03125 AS DOUBLE)] ORDER BY bin) AS peaks FROM t WHERE total >= 30 AND n >= greatest(4, total * 0.05) GROUP BY page),
    k AS (SELECT page, list_reduce(peaks, lambda kept, x: CASE WHEN x[1] - kept[-1] < 0.1 THEN kept ELSE list_concat(kept, x) END) AS starts FROM p)
    SELECT page, unnest(starts) AS start FROM k WHERE len(starts) >= 2"""
)
def column_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left edges that one in twenty of a page's words in body type share, a tenth of the page from the one kept before. AGG-17"""
    words = boxes(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    words = words.withColumn("page", F.floor(F.col("id") / 400))
    return G.column_starts(words, "page", "p_size", 0.03125, 0.05, 4, 0.1)


@query(
    f"""WITH b AS ({_BOXES}), x AS (SELECT page, y0, y1, unnest(range(CAST(greatest(0, floor(x0 * 4)) AS BIGINT), CAST(least(3, floor(x1 * 4)) AS BIGINT) + 1)) AS cx FROM b),
    y AS (SELECT DISTINCT page, cx, unnest(range(CAST(greatest(0, floor(y0 * 4)) AS BIGINT), CAST(least(3, floor(y1 * 4)) AS BIGINT) + 1)) AS cy FROM x)
    SELECT page, count(*) / 16 AS spread FROM y GROUP BY page"""
)
def page_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a page's grid that its boxes touch."""
    return G.grid_spread(boxes(spark, sf_dir), "page", 4)


@query()
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page that lie close together, grown into one in the order of their ids."""
    return G.merged_boxes(boxes(spark, sf_dir), ["page"], "id")


@query(
    f"""WITH b AS ({_BOXES}), c AS (SELECT *, (x0 + x1) / 2 AS mid, (x1 - x0) > 0.2 AS wide FROM b),
    j AS (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY page, wide ORDER BY mid, id) > 0.12 THEN 1 ELSE 0 END AS jump FROM c),
    k AS (SELECT *, CAST(CASE WHEN wide THEN -1 ELSE sum(jump) OVER (PARTITION BY page, wide ORDER BY mid, id ROWS UNBOUNDED PRECEDING) END AS INTEGER) AS column_no FROM j)
    SELECT page, id, column_no, CAST(row_number() OVER (PARTITION BY page ORDER BY column_no, y0, id) AS INTEGER) AS place FROM k"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order the boxes of a page are read."""
    return G.reading_order(boxes(spark, sf_dir), "page", wide=0.2).select("page", "id", "column_no", "place")
