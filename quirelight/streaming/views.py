"""Views that a change feed keeps up to date, partition by partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.sources.folders import shared_folder


def maintained(changes: DataFrame, key: str, rebuild: Callable[[DataFrame], DataFrame], name: str | None = None) -> DataFrame:
    """The view as it stands after all changes that are there, a folder of files for each key.

    Each batch of changes names the keys that it touches; rebuild(keys) gives the view's rows of these keys as they are by now, and only their
    folders are written anew.  A batch that runs again writes the same, so changes may be delivered more than once.  A key without rows
    any more keeps one that tells so, which readers do not see.  A named job goes on in its folder when it is run again.
    """
    spark = changes.sparkSession
    folder = shared_folder(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        keys = rows.select(key).distinct()
        fresh = rebuild(keys).withColumn("_gone", F.lit(False))
        empty = keys.join(fresh.select(key).distinct(), key, "left_anti").withColumn("_gone", F.lit(True))
        whole = fresh.unionByName(empty, allowMissingColumns=True)
        # one task a key, so a folder has one file and a hot key is split by the writer's limit only
        placed = whole.repartition(key).write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 5_000_000)
        placed.mode("overwrite").partitionBy(key).parquet(f"{folder}/view")

    run = changes.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    kind = changes.schema[key].dataType.simpleString()
    found = spark.read.parquet(f"{folder}/view")
    return found.filter("NOT _gone").drop("_gone").withColumn(key, F.col(key).cast(kind))
