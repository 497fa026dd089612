"""Streaming jobs that take in what is there and end, as a scheduler runs them.

State lives in Spark's state store below the shared folder, results in Parquet files; a batch that is
run again after a failure overwrites its own folder, so each job's result counts every row once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.operators.relational import latest_per
from quirelight.sources.folders import shared_folder


def written(stream: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """All that the stream gives, with the number of its batch as `batch`.

    A job with a name keeps its state and results in the folder of that name, and goes on there when it is run again.
    """
    folder = shared_folder(stream.sparkSession, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(f"{_ddl(stream)}, batch bigint").parquet(f"{folder}/out").drop(*([] if mode == "update" else ["batch"]))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _timed(stream: DataFrame, at: str, late: str) -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def usage(stream: DataFrame, at: str, keys: Sequence[str], value: str, width: str, late: str, order: Sequence[str]) -> DataFrame:
    """(keys, start, n, total) by tumbling windows; the last update of a window counts.

    Floating sums depend on the order of their terms, and rows come in by tasks and batches.  So the state holds a window's values, and
    total adds them in the given order, however the rows were dealt; it is null where no value is there.
    """
    term = F.struct(*order, F.col(value).cast("double").alias("_value"))
    counted = _timed(stream, at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.collect_list(F.when(F.col(value).isNotNull(), term)).alias("_terms"))
    total = F.when(F.size("_terms") > 0, F.aggregate(F.array_sort("_terms"), F.lit(0.0), lambda sum_, t: sum_ + t["_value"]))
    updates = latest_per(written(counted.select(*keys, F.col("window.start").alias("start"), "n", "_terms"), "update"), [*keys, "start"], [F.desc("batch")])
    return updates.select(*keys, "start", "n", total.alias("total"))


def once(stream: DataFrame, at: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of each key; repeats within the watermark are dropped."""
    return written(_timed(stream, at, late).dropDuplicatesWithinWatermark(list(keys)))


def latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, by the given columns."""
    return latest_per(written(stream), keys, [F.desc(c) for c in order])
