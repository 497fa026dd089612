"""Files as tables and streams, and the folder that a whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a local session that names none (tests) gets one of its own, once."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirelight-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str | None = None) -> str:
    """A folder below the checkpoint folder: of this name, so that a restarted job finds it again, or a new one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_folder(spark)
    return f"{top}/{name or uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stream_of(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    # streams take folders or patterns but no single file; the brackets name this one and no neighbour
    single = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(single)
