"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index is a table of postings (term, document, position) of all terms of the benchmark, written once,
in one scan of the texts, to the folder that the cluster shares; everything else is read from it.  A
window of an item can only occur where its rarest term does, so each window is looked up by that term
first: its postings, moved by the term's place in the item, give the alignments (document, item, shift)
at which the window may lie.  The list of the second-rarest term, moved alike, is intersected with them;
what is left is intersected with the lists of the terms round the anchor, and runs of positions as long as
a window are exact matches.  Proximity matches come from the same postings.

Terms are counted over the whole corpus.  Frequent terms cost little: they are read only where a rarer
term of their window has led.

Defined cases: null and empty texts have no words; texts are read whole, however long; items of fewer words
than a window are one window, items of none are never found; equal windows of two items are found for
both; an item is read with all rows that carry its id; ids of documents may repeat or be null (each row
is a document of its own); an empty table gives no rows, an empty benchmark no hits; further columns are
not read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.llm.common import ascii_lower, cut_lineage, shared_folder

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of benchmark terms up to which a lookup table is broadcast; beyond it, lookups are shuffle joins.
BROADCAST_BYTES = 32 << 20
#: What a row of a lookup table takes besides its term.
_ROW_BYTES = 64
#: Stands behind the words of each document and tells how many they are; no word can hold it.
_END = "\x00"


def words(text: Column) -> Column:
    """Words of lower-cased (A-Z only) text, in order; an empty array for null."""
    low = F.coalesce(ascii_lower(text.cast("string")), F.lit(""))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class Index:
    """Postings of a corpus for the terms of a benchmark: postings (doc, pos, tid), and the documents (doc, id, n_words).

    doc numbers the rows of docs.  bench holds the items word by word: row, item, len, at, term, tid.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, window: int):
        spark, self.window = docs.sparkSession, window
        bench = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("words")).filter("size(words) > 0")
        bench = bench.withColumn("row", F.monotonically_increasing_id())
        bench = cut_lineage(bench.select("row", "item", F.size("words").alias("len"), F.posexplode("words").alias("at", "term")))
        vocabulary = cut_lineage(bench.select("term").distinct().withColumn("tid", F.monotonically_increasing_id() + 1))
        sums = vocabulary.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
        self.vocabulary_bytes = sums[0] * _ROW_BYTES + (sums[1] or 0)
        self.bench = cut_lineage(bench.join(_small(vocabulary, self.vocabulary_bytes), "term"))
        self.bench_bytes = self.bench.count() * _ROW_BYTES

        numbered = docs.select(F.col(doc_id).alias("id"), words(F.col(doc_text)).alias("words")).withColumn("doc", F.monotonically_increasing_id())
        spread = numbered.select("doc", "id", F.posexplode(F.array_append("words", F.lit(_END))).alias("pos", "term"))
        known = vocabulary.union(spark.range(1).select(F.lit(_END).alias("term"), F.col("id").alias("tid")))
        found = spread.join(_small(known, self.vocabulary_bytes), "term")
        found = found.select("tid", "doc", "pos", F.when(F.col("tid") == 0, F.col("id")).alias("id"))
        folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
        found.sortWithinPartitions("tid").write.parquet(folder)
        stored = spark.read.schema(found.schema).parquet(folder)
        self.postings = stored.filter("tid > 0").select("doc", "pos", "tid")
        self.docs = stored.filter("tid = 0").select("doc", "id", F.col("pos").cast("long").alias("n_words"))

        df = self.postings.groupBy("tid").agg(F.count("*").alias("df"))
        self.frequency = cut_lineage(vocabulary.join(df, "tid", "left").na.fill(0, ["df"]).select("tid", "df"))

    def lists(self, tids: DataFrame) -> DataFrame:
        """Postings of the terms of a table with a column tid, joined with it."""
        return self.postings.join(_small(tids, self.bench_bytes), "tid")

    def anchors(self) -> DataFrame:
        """(row, len, first, second): places in an item of the two rarest terms of a window; ties go to the left."""
        places = self.bench.join(self.frequency, "tid").select("row", "len", "at", F.struct("df", "at").alias("rare"))
        span = Window.partitionBy("row").orderBy("at").rowsBetween(0, self.window - 1)  # one item at a time
        held = places.withColumn("two", F.slice(F.sort_array(F.collect_list("rare").over(span)), 1, 2))
        held = held.filter(F.col("at") <= F.greatest(F.lit(0), F.col("len") - self.window))
        held = held.filter(F.forall("two", lambda r: r["df"] > 0))  # a term that no document has: nothing to find
        return held.select("row", "len", F.col("two")[0]["at"].alias("first"), F.element_at("two", -1)["at"].alias("second")).distinct()


def exact_matches(index: Index) -> DataFrame:
    """(doc, row, shift, start, end): runs of document words [start, end) that repeat at least one window of an item.

    shift is the place in the document of the item's first word, if it stood there.
    """
    places = index.bench.select("row", "at", "tid")
    anchors = (
        index.anchors()
        .join(places.withColumnRenamed("at", "first"), ["row", "first"])
        .join(places.withColumnsRenamed({"at": "second", "tid": "tid2"}), ["row", "second"])
    )
    anchors = cut_lineage(anchors.select("row", "len", "first", "second", "tid", "tid2"))
    aligned = index.lists(anchors.select("row", "first", "second", "tid", "tid2"))
    shift = F.col("pos") - F.col("first")
    aligned = aligned.select("doc", "row", "first", shift.alias("shift"), "tid2", (shift + F.col("second")).alias("pos2"))
    second = index.lists(anchors.select("tid2").distinct().withColumnRenamed("tid2", "tid"))
    second = second.withColumnsRenamed({"pos": "pos2", "tid": "tid2"})
    alive = aligned.join(second, ["doc", "pos2", "tid2"], "left_semi").select("doc", "row", "shift", "first").distinct()
    alive = cut_lineage(alive)

    named = alive.select("doc").distinct()
    read = index.postings.join(_small(named, named.count() * _ROW_BYTES), "doc", "left_semi")
    whole = places.withColumn("len", F.count("*").over(Window.partitionBy("row")))
    near = F.abs(F.col("at") - F.col("first")) < index.window
    due = alive.join(_small(whole, index.bench_bytes), "row").filter(near)
    due = due.select("doc", "row", "shift", "len", (F.col("shift") + F.col("at")).alias("pos"), "tid").distinct()
    hits = due.join(read, ["doc", "pos", "tid"]).select("doc", "row", "shift", "len", "pos").distinct()
    runs = hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("doc", "row", "shift").orderBy("pos")))
    runs = runs.groupBy("doc", "row", "shift", "len", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return runs.filter(F.col("end") - F.col("start") >= F.least(F.col("len"), F.lit(index.window))).drop("run", "len")


def proximity_matches(index: Index, terms: int = 3, within: int = 20) -> DataFrame:
    """(doc, item, pos): places where the `terms` rarest distinct terms of an item all lie within so many words of the rarest.

    Looser than a phrase: order and gaps do not count.  Items of fewer distinct terms need all of them.
    """
    rare = index.bench.select("row", "item", "term", "tid").distinct().join(index.frequency, "tid")
    order = F.row_number().over(Window.partitionBy("row").orderBy("df", "term"))
    rare = rare.withColumn("rank", order).filter(F.col("rank") <= terms)
    rare = cut_lineage(rare.withColumn("need", F.count("*").over(Window.partitionBy("row"))).select("row", "item", "need", "rank", "tid"))
    placed = index.lists(rare)
    # blocks of `within` words: what is near a place lies in its block or a neighbour, so the join is on equal keys
    block = F.floor(F.col("pos") / within)
    rarest = placed.filter("rank = 1").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    others = placed.select("doc", "row", F.col("rank").alias("rank2"), F.col("pos").alias("pos2"), block.alias("block"))
    near = rarest.join(others, ["doc", "row", "block"]).filter(F.abs(F.col("pos2") - F.col("pos")) <= within)
    found = near.groupBy("doc", "row", "item", "need", "pos").agg(F.count_distinct("rank2").alias("n"))
    return found.filter("n = need").select("doc", "item", "pos").distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    proximity: bool = False,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items) for every row of docs; items: ids with windows that occur, as sorted strings.

    With `proximity`, n_near_items too: how many items have a proximity match.
    """
    index = Index(docs, items, doc_id, doc_text, item_id, item_text, window)
    found = cut_lineage(exact_matches(index))
    items_of = index.bench.filter("at = 0").select("row", F.col("item").cast("string").alias("item"))
    which = found.select("doc", "row").distinct().join(items_of, "row").groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    # the union of the runs of a document: a run starts a new stretch where it begins past all earlier ends
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("doc", "start", "end").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    hit = spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit"))
    judged = index.docs.join(which.join(hit, "doc"), "doc", "left").na.fill(0, ["n_hit"])
    columns = ["id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    if proximity:
        near = proximity_matches(index).groupBy("doc").agg(F.count_distinct(F.col("item").cast("string")).alias("n_near_items"))
        judged = judged.join(near, "doc", "left").na.fill(0, ["n_near_items"])
        columns.append("n_near_items")
    return judged.select(*columns).withColumn("n_items", F.size("items").cast("long"))
