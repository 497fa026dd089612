"""Relational building blocks: access, coverage, unique choice, merges, renumbering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open validity; a missing bound is open."""
    return F.coalesce(start <= at, F.lit(True)) & F.coalesce(at < end, F.lit(True))


def strictly_valid_at(start: Column, end: Column, revoked: Column, at: Column) -> Column:
    """Half-open validity that needs both bounds and no revocation."""
    return F.coalesce((start <= at) & (at < end), F.lit(False)) & revoked.isNull()


def active_with_grace(status: Column, ended: Column, period_end: Column, at: Column, states: Sequence[str], days: int = 3) -> Column:
    """A status that counts, not ended, and at most some days past the paid period."""
    grace = period_end + F.make_dt_interval(F.lit(days))
    return status.isin(*states) & F.coalesce(ended > at, F.lit(True)) & F.coalesce(grace > at, F.lit(True))


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, with_more: bool = True) -> DataFrame:
    """The first n rows of each key, with their place and how many rows stay out.

    Without `more`, each task ranks its own rows first and only n of a key go through the shuffle.
    """
    span = Window.partitionBy(*keys)
    placed = df.withColumn("place", F.row_number().over(span.orderBy(*order)))
    if with_more:
        placed = placed.withColumn("more", F.greatest(F.lit(0), F.count("*").over(span) - n))
    return placed.filter(F.col("place") <= n)


def unique_or_null(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value where a key has exactly one row, else null."""
    return df.groupBy(*keys).agg(F.when(F.count("*") == 1, F.first(value)).alias(value))


def best_or_null(df: DataFrame, keys: Sequence[str], value: str, points: str) -> DataFrame:
    """The value with the most points, null where the best two are equal.

    Two numbers a key are enough: the best points with their value, and how often the best occurs.
    """
    top = df.groupBy(*keys).agg(F.max(points).alias("_top"))
    at_top = df.join(top, list(keys)).filter(F.col(points) == F.col("_top"))
    return at_top.groupBy(*keys).agg(F.max("_top").alias("points"), F.when(F.count("*") == 1, F.min(value)).alias(value))


def best_of_counted(df: DataFrame, keys: Sequence[str], value: str, points: str, n: str) -> DataFrame:
    """(keys, points, n, value): the most points, how many have them, and the least of these; each row of df stands for n values, of which it holds the least."""
    sums = df.groupBy(*keys, points).agg(F.sum(n).alias(n), F.min(value).alias(value))
    return sums.groupBy(*keys).agg(F.max(points).alias(points), F.max_by(n, points).alias(n), F.max_by(value, points).alias(value))


def missing_pairs(wanted: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of wanted whose keys do not exist; missing keys are equal to each other."""
    pairs = reduce(lambda a, b: a & b, [wanted[k].eqNullSafe(existing[k]) for k in keys])
    return wanted.join(existing, pairs, "left_anti")


def covered_items(subs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(sub, item) for items that appear within a subscription, and the one that was current when it began.

    subs: sub, key, started, until.  items: item, key, at, shown (the date by which "current" goes).
    The second part is an as-of join: the newest item shown before the start, by one grouped maximum.
    """
    pairs = subs.join(items, key)
    within = pairs.filter((F.col("at") >= F.col("started")) & (F.col("at") <= F.col("until"))).select("sub", "item")
    before = pairs.filter(F.col("shown") < F.col("started")).groupBy("sub").agg(F.max(F.struct("shown", "item"))["item"].alias("item"))
    return union_distinct([within, before])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the newest `value` of right at or before `at`, null where there is none.

    Both sides are merged by one shuffle on the key and read in order of time, instead of pairing every
    row with all earlier ones.  Among equal times, rows of right count first.
    """
    own = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    other = right.select(key, at, F.col(value).alias("_value"), F.lit(0).alias("_side"))
    order = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = own.unionByName(other, allowMissingColumns=True).withColumn("_seen", F.last("_value", ignorenulls=True).over(order))
    return merged.filter("_side = 1").drop("_value", "_side").withColumnRenamed("_seen", value)


def months_later(at: Column, months: Column) -> Column:
    """Calendar months on; a day that the month has not runs over into the next one."""
    return (F.add_months(F.trunc(at, "MM"), months) + F.make_dt_interval(F.dayofmonth(at) - 1)).cast("date")


def chained_periods(df: DataFrame, keys: Sequence[str], created: str, months: str, tie: str) -> DataFrame:
    """(keys, tie, starts, ends): each purchase begins at its date or where the one before ends, whichever is later.

    A fold over one key's purchases in order; the lists hold one buyer's rows.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(created).cast("date").alias("created"), F.col(tie).alias("tie"), F.col(months).cast("int").alias("months"))))

    def step(state: Column, row: Column) -> Column:
        start = F.greatest(row["created"], state["end"])  # a missing end is ignored
        end = months_later(start, row["months"])
        made = F.struct(row["tie"].alias(tie), start.alias("starts"), end.alias("ends"))
        return F.struct(end.alias("end"), F.array_append(state["out"], made).alias("out"))

    kind = df.schema[tie].dataType.simpleString()
    empty = F.array().cast(f"array<struct<{tie}:{kind},starts:date,ends:date>>")
    state = F.struct(F.lit(None).cast("date").alias("end"), empty.alias("out"))
    folded = df.groupBy(*keys).agg(F.aggregate(rows, state, step, lambda s: s["out"]).alias("rows"))
    return folded.select(*keys, F.inline("rows"))


def renumber(df: DataFrame, parent: str, order: Sequence[Column], name: str = "order") -> DataFrame:
    """Places 1 to n within each parent."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest row of each key; of equal versions the new side counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per(both, keys, [F.col(version).desc_nulls_last(), F.col("_new").desc()]).drop("_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose keys it has not; repeated new keys are inserted once."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return old.unionByName(fresh.select(*old.columns))


def overlay(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Both tables by key; where both have a row, the right one's values count."""
    right = right.withColumnsRenamed({v: f"_{v}" for v in values}).withColumn("_there", F.lit(True))
    joined = left.join(right, list(keys), "full")
    return joined.select(*keys, *[F.when(F.col("_there"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def replace_by_provenance(old: DataFrame, new: DataFrame, column: str, provenance: str) -> DataFrame:
    """Rows of one provenance are replaced by the new ones, all others stay."""
    return old.filter(~F.col(column).eqNullSafe(F.lit(provenance))).unionByName(new)


def open_gap(df: DataFrame, parent: str, place: str, gaps: DataFrame) -> DataFrame:
    """Places from gaps.at on move up by gaps.n, one gap a parent."""
    joined = df.join(gaps, parent, "left")
    moved = F.when(F.col(place) >= F.col("at"), F.col(place) + F.col("n")).otherwise(F.col(place))
    return joined.withColumn(place, moved).drop("at", "n")


def cascade_delete(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Parents without the gone keys, and every child table without their rows."""
    return {"": parents.join(gone, key, "left_anti")} | {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def three_way_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Column) -> DataFrame:
    """Old rows that an editor holds, plus new rows of keys that none of those has, renumbered later by the caller."""
    held = old.filter(kept)
    return held.unionByName(new.join(held.select(*keys), list(keys), "left_anti").select(*old.columns))


def equal_sets(left: DataFrame, right: DataFrame, left_id: str, right_id: str, member: str) -> DataFrame:
    """(left_id, right_id) with the same set of members, joined on the sorted sets themselves."""
    a = left.groupBy(left_id).agg(F.array_sort(F.collect_set(member)).alias("_set"))
    b = right.groupBy(right_id).agg(F.array_sort(F.collect_set(member)).alias("_set"))
    return a.join(b, "_set").select(left_id, right_id)


def set_classes(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, class_key, class_size) for each key: the smallest key with the same set of members, and how many have it.

    One row a key, however many are alike.
    """
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("_set"))
    classes = sets.groupBy("_set").agg(F.min(key).alias("class_key"), F.count("*").alias("class_size"))
    return sets.join(classes, "_set").select(key, "class_key", "class_size")


def weighted_mode(df: DataFrame, keys: Sequence[str], value: str, weight: Column) -> DataFrame:
    """The value with the largest summed weight in each key; ties go to the smallest value."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"))
    return latest_per(sums, keys, [F.col("weight").desc(), F.col(value).asc()])


def recurring(df: DataFrame, parent: str, page: str, value: str, least: int, share: float) -> DataFrame:
    """(parent, value, pages): values on at least `least` distinct pages and that share of the parent's pages."""
    pages = df.groupBy(parent).agg(F.count_distinct(page).alias("all_pages"))
    seen = df.groupBy(parent, value).agg(F.count_distinct(page).alias("pages"))
    return seen.join(pages, parent).filter(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("all_pages") * share))).drop("all_pages")


def replaced(old: DataFrame, gone: DataFrame, new: DataFrame, ranks: DataFrame, references: dict[str, DataFrame], group: str, key: str, page: str, rank: str, status: str, done: str, waiting: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(rows, counts, references) after rows of a group have been taken out and others put in, renumbered by page and rank.

    old and new have group, key, page and rank, old its status; gone has keys, ranks new ranks of rows that stay.  New rows are `done` where every old row of the group is, else
    `waiting`.  References (each with a column of the key) to a row that went go to the first new row of its page, to nothing where there is none.
    counts (group, n_removed, n_inserted, n_left) is read from the input alone, so a dry run tells what the real one will do.
    """
    removed = old.join(gone.select(key), key, "left_semi")
    kept = old.join(gone.select(key), key, "left_anti").join(ranks.withColumnRenamed(rank, "_rank"), key, "left")
    counted = [kept.select(group, F.lit(0).alias("r"), F.lit(0).alias("i"), F.lit(1).alias("l")), removed.select(group, F.lit(1).alias("r"), F.lit(0).alias("i"), F.lit(0).alias("l")), new.select(group, F.lit(0).alias("r"), F.lit(1).alias("i"), F.lit(1).alias("l"))]
    counts = reduce(DataFrame.unionByName, counted).groupBy(group).agg(F.sum("r").alias("n_removed"), F.sum("i").alias("n_inserted"), F.sum("l").alias("n_left"))
    ready = old.groupBy(group).agg(F.bool_and(F.col(status) == done).alias("_ready"))
    put = new.join(ready, group, "left").withColumn(status, F.when(F.col("_ready"), done).otherwise(waiting))
    columns = [group, key, page, status]
    rows = kept.select(*columns, F.coalesce("_rank", rank).alias("_by"), F.lit(0).alias("_new")).unionByName(put.select(*columns, F.col(rank).alias("_by"), F.lit(1).alias("_new")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(page, "_by", "_new", key))
    successors = new.groupBy(group, page).agg(F.min_by(key, F.struct(rank, key)).alias("_successor"))
    moves = removed.select(group, page, key).join(successors, [group, page], "left").select(key, "_successor", F.lit(True).alias("_went"))
    pointed = {name: r.join(moves, key, "left").withColumn(key, F.when(F.col("_went"), F.col("_successor")).otherwise(F.col(key))).drop("_successor", "_went") for name, r in references.items()}
    return rows.select(*columns, place.alias("place")), counts, pointed


def best_by_rank_then_test(df: DataFrame, keys: Sequence[str], value: str, rank: Column, test: Column) -> DataFrame:
    """(keys, value): the one value of the best positive rank; of several, the one that passes the test, null where that is not one either.

    A value counts once, by its best rank.
    """
    each = df.groupBy(*keys, value).agg(F.max(rank).alias("_rank"), F.bool_or(F.coalesce(test, F.lit(False))).alias("_test"))
    counts = each.filter("_rank > 0").groupBy(*keys, "_rank").agg(F.count("*").alias("n"), F.count_if("_test").alias("t"), F.min(value).alias("one"), F.min(F.when(F.col("_test"), F.col(value))).alias("tested"))
    top = counts.groupBy(*keys).agg(F.max_by(F.struct("n", "t", "one", "tested"), "_rank").alias("b"))
    chosen = F.when(F.col("b.n") == 1, F.col("b.one")).when(F.col("b.t") == 1, F.col("b.tested"))
    return df.select(*keys).distinct().join(top, list(keys), "left").select(*keys, chosen.alias(value))


def chosen_query(df: DataFrame, keys: Sequence[str], query: str, place: str, hits: str, enough: int = 3) -> DataFrame:
    """(keys, query): the first of several words with enough hits, else the one with most hits, of equals the first; without any hit the first."""
    several = F.contains(F.trim(query), F.lit(" ")) & (F.col(hits) >= enough)
    most = F.max_by(query, F.struct(F.col(hits), -F.col(place)))
    return df.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(several, F.col(query)), F.when(several, F.col(place))), F.when(F.max(hits) > 0, most), F.min_by(query, place)).alias(query))
