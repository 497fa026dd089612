"""Sharding by longest processing time: groups that must stay together, largest first, go to the least-loaded shard.

Rows of one text form a group.  What decides a group's shard is its total size alone, so the driver
needs only how many groups there are of each size, not the groups.  Every size below 2**digits counts by
itself, and so does the size of each of the largest groups, `exact` at most.  Only where there are more
large groups than that, those next in size go by classes that agree in their `digits` leading binary
digits, so that the size taken for one is off by less than a 2**(1-digits) part (0.012 %).  That bounds
what the driver gets to 2**(digits-1) classes for each doubling of the size and `exact` more, whatever
the number of documents.  The classes go through the heap from the largest down; a class of many groups
is laid level first, which gives the counts that pushing its groups one by one would.  Executors then
rank the groups of a class by the digest of their text and read their shard off the counts.

The law is `bytes`: the sizes of the shards come out near equal, as far as single groups allow.

Defined cases: a null text has no bytes and is equal to the empty text; null ids are rows like any
other; repeated rows each get a slot; an empty table gives no rows.  A text of any length is one row of its size, and
further columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.llm.common import cut_lineage


def lay_out(classes: Iterable[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """(class, groups, bytes) by falling size -> for each class, how many groups each shard takes."""
    loads = [0] * shards
    taken: dict[int, list[int]] = {}
    for key, count, total in classes:
        size = max(1, total // count)
        counts = _level(loads, size, count)
        left = count - sum(counts)
        loads = [load + n * size for load, n in zip(loads, counts, strict=True)]
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            counts[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        for load, s in heap:
            loads[s] = load
        # sizes inside a class may differ a little; the mean stands for each, and the sum is kept whole
        taken[key] = counts
    return taken


def _cut(classes: list, exact: int) -> int:
    """The least class from which on there are `exact` groups at most, from (class, groups) by falling class."""
    groups, cut = 0, 1 << 62
    for key, n in classes:
        groups += n
        if groups > exact:
            break
        cut = key
    return cut


def _level(loads: list[int], size: int, count: int) -> list[int]:
    """What the heap has given out when no shard stands below the highest level that `count` groups of one size reach."""

    def filled(level: int) -> list[int]:
        return [max(0, -((load - level) // size)) for load in loads]

    lo, hi = min(loads), max(loads) + size * (count + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(filled(mid)) <= count else (lo, mid - 1)
    return filled(lo)


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, digits: int = 14, exact: int = 4096
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; no text is shuffled.

    The ranks of one class and the slots of one shard are dealt in 256 parts, by the first byte of a
    digest, so that a common size or a shard is never one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
    )
    rows = cut_lineage(rows)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    low = F.greatest(F.lit(0), F.floor(F.log2("bytes")).cast("int") - (digits - 1))
    step = F.expr("shiftleft(1L, low)")
    groups = groups.withColumn("low", low).withColumn("class", (F.floor(F.col("bytes") / step) * step).cast("long"))
    groups = cut_lineage(groups.select("key", "bytes", "class", F.substring("key", 1, 2).alias("part")))
    cut = _cut(groups.groupBy("class").count().orderBy(F.desc("class")).collect(), exact)
    groups = groups.withColumn("class", F.when(F.col("class") >= cut, F.col("bytes")).otherwise(F.col("class")))

    parts = groups.groupBy("class", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = parts.groupBy("class").agg(F.sum("n"), F.sum("bytes")).orderBy(F.desc("class")).collect()
    taken = lay_out(((r[0], r[1], r[2]) for r in sizes), shards)
    ends = [(key, [sum(counts[: s + 1]) for s in range(shards)]) for key, counts in taken.items()]
    ends = docs.sparkSession.createDataFrame(ends, "class long, ends array<long>")

    so_far = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(so_far), F.lit(0))).select("class", "part", "start")
    # equal numbers of the parts' ranks meet the shards in turn: a class's groups are ranked part by part
    rank = F.row_number().over(Window.partitionBy("class", "part").orderBy("key")) - 1
    ranked = groups.withColumn("rank", rank).join(starts, ["class", "part"]).join(ends, "class")
    placed = ranked.select("key", F.expr("size(filter(ends, e -> e <= start + rank))").alias("shard"))

    of_id = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    dealt = rows.join(placed, "key").withColumn("part", of_id)
    dealt = cut_lineage(dealt.select("id", "size", "text_crc32", "shard", "part"))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")) - 1
    return (
        dealt.withColumn("place", place)
        .join(F.broadcast(starts), ["shard", "part"])  # 256 rows a shard at most
        .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )
