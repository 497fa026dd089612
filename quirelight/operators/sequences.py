"""Order-dependent operators: islands, runs, prefix sums, trailing counts and exact limiters."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the stretches of each key; a new one begins where `breaks` holds, and at the first row."""
    span = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.row_number().over(span) == 1, 1).otherwise(F.coalesce(breaks, F.lit(False)).cast("int"))
    marked = df.withColumn("_flag", flag)
    return marked.withColumn(name, F.sum("_flag").over(span.rowsBetween(Window.unboundedPreceding, 0))).drop("_flag")


def gap_islands(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap: Column | float, name: str = "island") -> DataFrame:
    """Stretches without a gap larger than `gap` between neighbours."""
    span = Window.partitionBy(*keys).orderBy(at, tie)
    return islands(df, keys, [at, tie], F.col(at) - F.lag(at).over(span) > gap, name)


def rising_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Stretches of values that do not fall."""
    span = Window.partitionBy(*keys).orderBy(*order)
    return islands(df, keys, order, F.col(value) < F.lag(value).over(span), name)


def cumulative_share(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Prefix sum of a value over its total."""
    span = Window.partitionBy(*keys)
    running = F.sum(value).over(span.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, running / F.sum(value).over(span))


def attempts_before(df: DataFrame, keys: Sequence[str], at: Column, seconds: int, name: str = "attempts") -> DataFrame:
    """How many rows of the key lie in the trailing window, the row itself included."""
    micros = F.unix_micros(at)
    span = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn(name, F.count("*").over(span))


def limited(df: DataFrame, key: str, micros: str, tie: str, seconds: int, most: int) -> DataFrame:
    """Adds `accepted`: a row is accepted if fewer than `most` accepted rows of its key lie in the trailing window.

    Refused rows leave no trace, so a count over attempts would refuse too many.  A row exactly `seconds`
    old still counts.  The state is a queue of at most `most` times per key, walked once in order; rows
    arrive as sorted batches, so no key has to fit in memory.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "accepted boolean"])

    def walk(batches):
        known, times = None, deque()
        for pdf in batches:
            verdicts = []
            for k, at in zip(pdf[key].tolist(), pdf[micros].tolist(), strict=True):
                if k != known:
                    known, times = k, deque()
                while times and at - times[0] > seconds * 1_000_000:
                    times.popleft()
                fine = len(times) < most
                if fine:
                    times.append(at)
                verdicts.append(fine)
            yield pdf.assign(accepted=pd.Series(verdicts, index=pdf.index, dtype=bool))

    return df.repartition(key).sortWithinPartitions(key, micros, tie).mapInPandas(walk, schema)


def keep_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Marks all but the newest n rows of each key as evicted."""
    return df.withColumn("evicted", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > n)


def first_per_ledger(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Exactly one row for each ledger key, the first in order; replays are dropped."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")
