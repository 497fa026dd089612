"""Articles put together from boxes: headings and initials to their texts, pictures to tiles, frames in reading order.

Each query's docstring ends with the survey rows that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.operators import geometry as G
from quirelight.operators import grids
from quirelight.operators import relational as R
from quirelight.operators.assignment import exclusive_choices
from quirelight.operators.chains import chain_places, stacked_above
from quirelight.plans.layouts import _BOXES, boxes
from quirelight.plans.registry import query, read

#: How far sideways, or above, a text may begin from its heading and still be in its column.
COLUMN = 0.08

_IN_TURN = """choice AS (SELECT grp, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS one, CAST(NULL AS BIGINT) AS other, CAST([] AS BIGINT[]) AS taken FROM turns GROUP BY grp
  UNION ALL
  SELECT grp, k, one, other, CASE WHEN other IS NULL THEN taken ELSE list_append(taken, other) END FROM
    (SELECT t.grp, t.k, t.one, c.taken, (SELECT arg_min(p.other, p.liking) FROM p WHERE p.one = t.one AND NOT list_contains(c.taken, p.other)) AS other FROM choice c JOIN turns t ON t.grp = c.grp AND t.k = c.k + 1))"""


@query(
    f"""WITH RECURSIVE b AS (SELECT *, id // 200 AS grp FROM ({_BOXES})), h AS (SELECT * FROM b WHERE id % 4 = 0), t AS (SELECT * FROM b WHERE id % 4 != 0),
    turns AS MATERIALIZED (SELECT grp, id AS one, row_number() OVER (PARTITION BY grp ORDER BY page, y0, x0, id) AS k FROM h),
    p AS MATERIALIZED (SELECT h.id AS one, t.id AS other, struct_pack(pages := t.page - h.page, col := CASE WHEN t.page = h.page AND abs(t.x0 - h.x0) <= 0.08 AND t.y0 >= h.y0 - 0.08 THEN 0 ELSE 1 END, far := abs(t.y0 - h.y0) + abs(t.x0 - h.x0), id := t.id) AS liking
      FROM h JOIN t ON t.grp = h.grp AND t.page - h.page BETWEEN 0 AND 1),
    {_IN_TURN} SELECT one AS heading, other AS body FROM choice WHERE other IS NOT NULL"""
)
def heading_to_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each heading announces: headings by page, height and side take the next one of their page or the following, in their column first. JOIN-22"""
    own = boxes(spark, sf_dir).withColumn("issue", F.floor(F.col("id") / 200))
    heads = own.filter("id % 4 = 0").select("issue", F.col("id").alias("heading"), F.col("page").alias("h_page"), F.col("x0").alias("h_x0"), F.col("y0").alias("h_y0"), F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page"))
    pairs = heads.join(own.filter("id % 4 != 0").withColumnRenamed("id", "body"), ["issue", "page"])
    same = (F.col("page") == F.col("h_page")) & (F.abs(F.col("x0") - F.col("h_x0")) <= COLUMN) & (F.col("y0") >= F.col("h_y0") - COLUMN)
    far = F.abs(F.col("y0") - F.col("h_y0")) + F.abs(F.col("x0") - F.col("h_x0"))
    liking = [(F.col("page") - F.col("h_page")).alias("pages"), F.when(same, 0).otherwise(1).alias("col"), far.alias("far")]
    return exclusive_choices(pairs, ["heading"], ["body"], [F.col("h_page"), F.col("h_y0"), F.col("h_x0")], liking)


@query(
    f"""WITH RECURSIVE b AS (SELECT b.*, page AS grp, p_name AS text, p_size % 5 = 0 AS initial FROM ({_BOXES}) b JOIN part ON id = p_partkey),
    turns AS MATERIALIZED (SELECT grp, id AS one, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM b WHERE NOT initial AND regexp_matches(ltrim(text), '^[a-z]')),
    p AS MATERIALIZED (SELECT t.one, i.id AS other, struct_pack(far := abs(i.x0 - b.x0) + abs(i.y0 - b.y0), id := i.id) AS liking FROM turns t JOIN b ON b.id = t.one JOIN b i ON i.page = b.page AND i.initial),
    {_IN_TURN} SELECT one AS id, upper(left(i.text, 1)) || b.text AS text FROM choice JOIN b ON b.id = one JOIN b i ON i.id = other"""
)
def initials_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin with a small letter, behind the nearest initial of their page that no earlier text has taken. JOIN-23"""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), (F.col("p_size") % 5 == 0).alias("initial"))
    own = boxes(spark, sf_dir).join(part, "id")
    texts = own.filter(~F.col("initial") & F.regexp_like(F.ltrim("text"), F.lit("^[a-z]")))
    pairs = G.box_pairs(texts, own.filter("initial"), "page", "id")
    far = F.abs(F.col("b_x0") - F.col("a_x0")) + F.abs(F.col("b_y0") - F.col("a_y0"))
    chosen = exclusive_choices(pairs, ["a_id"], ["b_id"], [F.col("a_id").alias("turn")], [far.alias("far")])
    initial = own.select(F.col("id").alias("b_id"), F.upper(F.left("text", F.lit(1))).alias("letter"))
    return chosen.join(initial, "b_id").join(texts.select(F.col("id").alias("a_id"), "text"), "a_id").select(F.col("a_id").alias("id"), F.concat("letter", "text").alias("text"))


@query(
    f"""WITH RECURSIVE b AS (SELECT b.*, page AS grp, string_split(p_name, ' ') AS words, string_split(lead(p_name) OVER (ORDER BY id), ' ') AS file FROM ({_BOXES}) b JOIN part ON id = p_partkey),
    turns AS MATERIALIZED (SELECT grp, id AS one, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM b WHERE id % 3 = 0),
    o AS (SELECT t.grp, t.id AS one, i.id AS other, len(list_intersect(list_distinct(t.words), coalesce(i.file, []))) / len(list_distinct(t.words)) AS named, least(i.x1 - i.x0, t.x1 - t.x0) AS w, least(i.y1 - i.y0, t.y1 - t.y0) AS h,
      greatest(0, least(i.x1, t.x1) - greatest(i.x0, t.x0)) AS across, greatest(0, least(i.y1, t.y1) - greatest(i.y0, t.y0)) AS down, t.y0 - i.y1 AS above, greatest(t.x0 - i.x1, i.x0 - t.x1) AS beside FROM b t JOIN b i ON i.page = t.page AND t.id % 3 = 0 AND i.id % 3 = 1),
    s AS (SELECT *, w > 0 AND across >= 0.5 * w AS same_column, h > 0 AND down >= 0.5 * h AS same_row FROM o),
    n AS (SELECT *, same_column AND above BETWEEN -0.02 AND 0.06 OR same_row AND beside <= 0.05 AS near FROM s),
    p AS MATERIALIZED (SELECT one, other, struct_pack(points := -(named * 2 + CASE WHEN near THEN 1.0::DOUBLE ELSE 0 END - 0.1::DOUBLE * greatest(0, CASE WHEN same_column THEN above ELSE beside END)), id := other) AS liking FROM n WHERE near OR named >= 0.6),
    {_IN_TURN} SELECT one AS tile, other AS picture FROM choice WHERE other IS NOT NULL"""
)
def covers_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture of each tile, above it or beside it or named like it, by points; tiles take theirs in order. JOIN-24"""
    name = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"))
    # a picture's file is named after the next part
    file = name.select((F.col("id") - 1).alias("id"), F.col("words").alias("file"))
    own = boxes(spark, sf_dir)
    tiles, pictures = own.filter("id % 3 = 0"), own.filter("id % 3 = 1")
    pairs = G.box_pairs(tiles, pictures, "page", "id").join(name.withColumnRenamed("id", "a_id"), "a_id").join(file.withColumnRenamed("id", "b_id"), "b_id", "left")
    side = lambda p, k: F.col(f"{p}_{k}1") - F.col(f"{p}_{k}0")
    laps = lambda k: F.greatest(F.lit(0.0), F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0"))
    pairs = pairs.withColumns({"named": F.size(F.array_intersect("words", F.coalesce("file", F.array().cast("array<string>")))) / F.size(F.array_distinct("words")), "w": F.least(side("a", "x"), side("b", "x")), "h": F.least(side("a", "y"), side("b", "y"))})
    column, row = (F.col("w") > 0) & (laps("x") >= 0.5 * F.col("w")), (F.col("h") > 0) & (laps("y") >= 0.5 * F.col("h"))
    above, beside = F.col("a_y0") - F.col("b_y1"), F.greatest(F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"))
    pairs = pairs.withColumns({"column": column, "above": above, "beside": beside, "near": (column & above.between(-0.02, 0.06)) | (row & (beside <= 0.05))})
    points = F.col("named") * 2 + F.when(F.col("near"), 1.0).otherwise(0.0) - 0.1 * F.greatest(F.lit(0.0), F.when(F.col("column"), F.col("above")).otherwise(F.col("beside")))
    chosen = exclusive_choices(pairs.filter("near OR named >= 0.6"), ["a_id"], ["b_id"], [F.col("a_id").alias("turn")], [(-points).alias("points")])
    return chosen.select(F.col("a_id").alias("tile"), F.col("b_id").alias("picture"))


_FRAMES = f"""f AS MATERIALIZED (SELECT b.*, id // 25 AS story, CASE WHEN p_size % 5 != 0 THEN id // 25 * 25 + (id % 25 + p_size) % 25 END AS following, CASE WHEN p_size % 3 != 0 THEN id // 25 * 25 + (id % 25 + p_size * 3) % 25 + CASE WHEN p_size % 7 = 0 THEN 1000000 ELSE 0 END END AS previous FROM ({_BOXES}) b JOIN part ON id = p_partkey)"""


@query(
    f"""WITH RECURSIVE {_FRAMES}, s AS (SELECT *, row_number() OVER (ORDER BY page, y0, x0, id) AS rank FROM f WHERE previous IS NULL OR previous NOT IN (SELECT id FROM f g WHERE g.story = f.story)),
    walk AS (SELECT story, id, rank, 0 AS far FROM s UNION ALL SELECT f.story, following, rank, far + 1 FROM walk JOIN f ON f.id = walk.id AND f.story = walk.story WHERE far < 25 AND following IN (SELECT id FROM f)),
    first AS (SELECT id, min(struct_pack(rank := rank, far := far)) AS first FROM walk GROUP BY id)
    SELECT f.story, f.id, CAST(row_number() OVER (PARTITION BY f.story ORDER BY first IS NULL, first.rank, first.far, page, y0, x0, f.id) AS INTEGER) AS place FROM f LEFT JOIN first ON f.id = first.id"""
)
def story_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of a story in reading order: along their links from each frame without a predecessor, then the rest by place. JOIN-29"""
    key, size = F.col("id"), F.col("p_size")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    story = F.floor(key / 25)
    following = F.when(size % 5 != 0, story * 25 + (key % 25 + size) % 25)
    previous = F.when(size % 3 != 0, story * 25 + (key % 25 + size * 3) % 25 + F.when(size % 7 == 0, 1000000).otherwise(0))
    frames = boxes(spark, sf_dir).join(part, "id").select("*", story.alias("story"), following.alias("following"), previous.alias("previous"))
    there = frames.select("story", F.col("id").alias("previous"), F.lit(True).alias("there"))
    frames = frames.join(there, ["story", "previous"], "left")
    return chain_places(frames, "story", "id", "following", F.col("there").isNull(), ["page", "y0", "x0"]).select("story", "id", "place")


@query(
    f"""WITH RECURSIVE b AS ({_BOXES}), a AS (SELECT * FROM b WHERE id % 5 = 0), f AS (SELECT * FROM b WHERE id % 5 != 0),
    p AS MATERIALIZED (SELECT a.page, a.id AS base, f.id AS frame, f.y0, f.y1, a.y0 AS top FROM a JOIN f ON a.page = f.page WHERE least(f.x1 - f.x0, a.x1 - a.x0) > 0 AND least(f.x1, a.x1) - greatest(f.x0, a.x0) >= least(f.x1 - f.x0, a.x1 - a.x0) / 2 AND f.x1 - f.x0 <= 1.5 * (a.x1 - a.x0)),
    walk AS (SELECT DISTINCT page, base, 0 AS step, CAST(NULL AS BIGINT) AS frame, top, CAST([] AS BIGINT[]) AS found FROM p
      UNION ALL SELECT page, base, step + 1, best.frame, best.y0, list_append(found, best.frame) FROM
      (SELECT w.*, (SELECT min(struct_pack(apart := w.top - p.y1, frame := p.frame, y0 := p.y0)) FROM p WHERE p.page = w.page AND p.base = w.base AND w.top - p.y1 BETWEEN -0.0625 AND 0.125 AND NOT list_contains(w.found, p.frame)) AS best FROM walk w WHERE step < 3) WHERE best IS NOT NULL)
    SELECT page, base, step, frame FROM walk WHERE step > 0"""
)
def title_frames_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that stand over an advertisement, from below upwards, each over the one found before, three at most. JOIN-46"""
    own = boxes(spark, sf_dir)
    return stacked_above(own.filter("id % 5 = 0"), own.filter("id % 5 != 0"), "page", "id", 3, 0.125, 0.0625, 1.5)


_CELLS = "SELECT p_partkey // 24 AS tbl, CAST(p_partkey % 24 // 4 AS INTEGER) AS z, CAST(p_partkey % 4 AS INTEGER) AS s, 1 + CAST(p_size % 7 = 0 AS INTEGER) + CAST(p_size % 11 = 0 AS INTEGER) AS down, 1 + CAST(p_size % 5 = 0 AS INTEGER) AS across, p_name AS text, CASE WHEN p_size % 4 > 0 THEN p_type END AS fill, p_size % 9 < 8 AS bold, CAST(p_partkey // 24 % 3 = 0 AS INTEGER) AS declared FROM part WHERE p_size % 13 != 0"


@query(
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY z, s) AS k, max(z) OVER (PARTITION BY tbl) + 1 AS n_rows, max(s) OVER (PARTITION BY tbl) + 1 AS n_cols FROM ({_CELLS})),
    walk AS (SELECT tbl, CAST(0 AS BIGINT) AS k, [struct_pack(z := 0, s := 0, z1 := 0, s1 := 0)][2:] AS kept, false AS free FROM c GROUP BY tbl
      UNION ALL SELECT tbl, k, CASE WHEN free THEN list_append(kept, struct_pack(z := z, s := s, z1 := z + least(down, n_rows - z), s1 := s + least(across, n_cols - s))) ELSE kept END, free FROM
      (SELECT c.*, w.kept, len(list_filter(w.kept, lambda x: c.z >= x.z AND c.z < x.z1 AND c.s >= x.s AND c.s < x.s1)) = 0 AS free FROM walk w JOIN c ON c.tbl = w.tbl AND c.k = w.k + 1)),
    v AS (SELECT c.* FROM walk JOIN c USING (tbl, k) WHERE free AND k > 0),
    h AS (SELECT tbl, max(declared) AS declared, max(z) + 1 AS n, list_sort(list_distinct(list(coalesce(fill, '')) FILTER (z = 0))) AS f0, list_sort(list_distinct(list(coalesce(fill, '')) FILTER (z = 1))) AS f1, coalesce(bool_and(bold) FILTER (z = 0), false) AS bold FROM v GROUP BY tbl)
    SELECT tbl, z AS "row", s AS col, CAST(least(down, n_rows - z) AS INTEGER) AS row_span, CAST(least(across, n_cols - s) AS INTEGER) AS col_span, text,
      z < least(CASE WHEN h.declared > 0 THEN h.declared WHEN n > 1 AND len(f0) > 0 AND (NOT list_contains(f0, '') AND f0 != coalesce(f1, []) OR h.bold) THEN 1 ELSE 0 END, n) AS header FROM v JOIN h USING (tbl)"""
)
def spanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of tables without those that a spanning cell hides, spans cut at the edge, and the rows that are headers. ARR-01"""
    key, size = F.col("p_partkey"), F.col("p_size")
    is_ = lambda test: test.cast("int")
    cells = read(spark, sf_dir, "part").filter(size % 13 != 0).select(
        F.floor(key / 24).alias("tbl"), F.floor(key % 24 / 4).cast("int").alias("row"), (key % 4).cast("int").alias("col"), (1 + is_(size % 7 == 0) + is_(size % 11 == 0)).alias("row_span"), (1 + is_(size % 5 == 0)).alias("col_span"),
        F.col("p_name").alias("text"), F.when(size % 4 > 0, F.col("p_type")).alias("fill"), (size % 9 < 8).alias("bold"), is_(F.floor(key / 24) % 3 == 0).alias("declared"),
    )
    seen = grids.with_headers(grids.visible_cells(cells, "tbl"), "tbl", "declared", "fill", "bold")
    return seen.select("tbl", "row", "col", "row_span", "col_span", "text", "header")


@query(
    f"""WITH b AS (SELECT b.*, id // 25 AS story, greatest(1, length(p_name) * p_size) AS len, greatest(1e-6, (x1 - x0) * (y1 - y0)) AS space FROM ({_BOXES}) b JOIN part ON id = p_partkey),
    p AS (SELECT story, id, (coalesce(sum(len) OVER (PARTITION BY story ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len / 2) / sum(len) OVER (PARTITION BY story) AS mid FROM b WHERE id % 5 != 0),
    f AS (SELECT story, id, coalesce(sum(space) OVER (PARTITION BY story ORDER BY page, y0, x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(space) OVER (PARTITION BY story) AS start, space / sum(space) OVER (PARTITION BY story) AS wide FROM b WHERE id % 5 = 0)
    SELECT p.story, p.id AS paragraph, f.id AS frame, round((mid - start) / wide, 6) AS share FROM p ASOF JOIN f ON p.story = f.story AND p.mid >= f.start"""
)
def paragraphs_on_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of its story that each paragraph falls in, by text before it and room before the frame. WIN-14"""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.length("p_name") * F.col("p_size")).alias("len"))
    own = boxes(spark, sf_dir).join(part, "id").withColumns({"story": F.floor(F.col("id") / 25), "space": G.box_area()})
    found = grids.on_frames(own.filter("id % 5 != 0").withColumnRenamed("id", "paragraph"), own.filter("id % 5 = 0").withColumnRenamed("id", "frame"), "story", "len", "space", ["paragraph"], ["page", "y0", "x0", "frame"], "paragraph", "frame")
    return found.select("story", "paragraph", "frame", F.round("share", 6).alias("share"))


_OLD = "SELECT l_orderkey AS issue, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS article, CAST(min(l_suppkey) % 8 AS BIGINT) AS page, l_linenumber AS rnk, max(l_linestatus) AS status, max(l_returnflag) AS flag, CAST(min(l_quantity) AS INTEGER) AS moved FROM lineitem GROUP BY l_orderkey, l_linenumber"
_NEW = "SELECT o_orderkey AS issue, -(o_orderkey * 10 + k) AS article, (o_custkey + k * 3) % 8 AS page, CAST(k AS INTEGER) AS rnk FROM orders, range(1, 4) r(k) WHERE o_orderkey % 2 = 0 AND k <= o_orderkey % 4 + 1"


def _merge(spark: SparkSession, sf_dir: str):
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("issue"), F.col("l_linenumber").alias("rnk")).agg((F.min("l_suppkey") % 8).alias("page"), F.max("l_linestatus").alias("status"), F.max("l_returnflag").alias("flag"), F.min("l_quantity").cast("int").alias("moved"))
    old = lines.withColumn("article", F.col("issue") * 10 + F.col("rnk"))
    orders = read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("issue"), "o_custkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rnk"))
    new = orders.filter("rnk <= issue % 4 + 1").select("issue", (-(F.col("issue") * 10 + F.col("rnk"))).alias("article"), ((F.col("o_custkey") + F.col("rnk") * 3) % 8).alias("page"), "rnk")
    ranks = old.filter("page % 2 = 0").select("article", F.col("moved").alias("rnk"))
    references = {
        "contents": old.select(F.col("article").alias("entry"), (F.col("issue") * 10 + 1).alias("article")),
        "progress": read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_orderkey") * 10 + 2).alias("article")),
    }
    return R.replaced(old.drop("flag", "moved"), old.filter("flag = 'R'").select("article"), new, ranks, references, "issue", "article", "page", "rnk", "status", "F", "O")


@query(
    f"""WITH old AS ({_OLD}), new AS ({_NEW}), ready AS (SELECT issue, bool_and(status = 'F') AS ready FROM old GROUP BY issue),
    every AS (SELECT issue, article, page, CASE WHEN page % 2 = 0 THEN moved ELSE rnk END AS rnk, 0 AS fresh, status FROM old WHERE flag != 'R' UNION ALL SELECT new.issue, article, page, rnk, 1, CASE WHEN ready THEN 'F' ELSE 'O' END FROM new LEFT JOIN ready ON ready.issue = new.issue)
    SELECT issue, article, page, status, CAST(row_number() OVER (PARTITION BY issue ORDER BY page, rnk, fresh, article) AS INTEGER) AS place FROM every"""
)
def replaced_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of an issue after some were taken out and others put in, counted anew by page and place. SNK-07, AGG-31"""
    return _merge(spark, sf_dir)[0]


@query(
    f"""WITH old AS ({_OLD}), new AS ({_NEW}) SELECT issue, CAST(sum(r) AS BIGINT) AS n_removed, CAST(sum(i) AS BIGINT) AS n_inserted, CAST(sum(l) AS BIGINT) AS n_left FROM
    (SELECT issue, CAST(flag = 'R' AS INTEGER) AS r, 0 AS i, CAST(flag != 'R' AS INTEGER) AS l FROM old UNION ALL SELECT issue, 0, 1, 1 FROM new) GROUP BY issue"""
)
def merge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge would take out, put in and leave of each issue, without doing it. SNK-07"""
    return _merge(spark, sf_dir)[1]


@query(
    f"""WITH old AS ({_OLD}), new AS ({_NEW}), s AS (SELECT issue, page, arg_min(article, (rnk, article)) AS successor FROM new GROUP BY ALL), m AS (SELECT old.article, successor FROM old LEFT JOIN s USING (issue, page) WHERE flag = 'R'),
    refs AS (SELECT 'contents' AS kind, article AS entry, issue * 10 + 1 AS article FROM old UNION ALL SELECT 'progress', o_orderkey, o_orderkey * 10 + 2 FROM orders)
    SELECT kind, entry, CASE WHEN m.article IS NOT NULL THEN successor ELSE refs.article END AS article FROM refs LEFT JOIN m ON m.article = refs.article"""
)
def repointed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents entries and readers' places that named an article that went, pointed at the first new one of its page. SNK-07"""
    found = _merge(spark, sf_dir)[2]
    frames = [df.select(F.lit(kind).alias("kind"), "entry", "article") for kind, df in found.items()]
    return frames[0].unionByName(frames[1])


def _pictures_and_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Large boxes, three pages of them together, as pictures, and small ones as words."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    own = boxes(spark, sf_dir).join(part, "id").withColumn("page", F.floor(F.col("page") / 3))
    wide = own.filter("id % 3 != 0")
    pictures = wide.select("page", "id", "x0", "y0", (F.col("x1") + 0.1 * (F.col("id") % 4)).alias("x1"), (F.col("y1") + 0.15 * (F.col("id") % 3)).alias("y1"), (F.col("p_size") % 17 == 0).alias("stencil"), (F.col("p_size") * 7).alias("pixels"))
    words = own.filter("id % 3 = 0").select("page", "id", "x0", "y0", (F.col("x0") + 0.04).alias("x1"), (F.col("y0") + 0.02).alias("y1"), (F.col("p_size") % 4 != 0).alias("body"))
    return pictures, words


@query()
def picture_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a page's pictures is shown: no stencils, backgrounds or type areas, and those that lie on one another as one. GEO-06, GEO-07, AGG-18"""
    pictures, words = _pictures_and_words(spark, sf_dir)
    trim = pictures.select("page").distinct().select("page", F.lit(0.02).alias("x0"), F.lit(0.02).alias("y0"), F.lit(0.98).alias("x1"), F.lit(0.98).alias("y1"))
    return G.picture_regions(pictures, words, words.filter("body"), trim, "page", "id").select("page", *[F.round(c, 6).alias(c) for c in G.BOX], "n")


@query()
def reader_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas that a reader can touch: straightened and cut to the page, links as they are, the boxes of an article grown together. GEO-09"""
    pictures, _ = _pictures_and_words(spark, sf_dir)
    turned = F.col("id") % 5 == 0
    rows = pictures.select((F.col("id") % 4).alias("article"), "page", "id", F.when(turned, F.col("x1")).otherwise(F.col("x0")).alias("x0"), "y0", F.when(turned, F.col("x0")).otherwise(F.col("x1")).alias("x1"), "y1", F.when(F.col("id") % 7 == 0, F.col("id") % 11).alias("target"))
    return G.reader_regions(rows, "article", "page", "target", "id").select("article", "page", "target", *[F.round(c, 6).alias(c) for c in G.BOX], "n")
