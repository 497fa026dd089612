"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  lower() is the quick path, exact where the text is pure ASCII."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of spark.checkpoint.dir, which every executor shares.

    Only a local session (as in tests) that names no such folder gets one of its own; a cluster has to name one.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirelight-"))
    return context.getCheckpointDir()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores put to it until df has no such column (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that make a task worth its start and its files.
ROWS_A_TASK = 1 << 15


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many small rows, in as many tasks as these are worth, but one for every core; where it has fewer, as it is.

    Each task of a shuffle leaves some files on the disk, even without rows, until the driver lets go of the shuffle.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


#: Bytes of rows that go to a Python worker at once.  Worker and executor hold a batch several times over (as rows, buffers and results), for every core.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about BATCH_BYTES at most; a smaller bound of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(name).strip().lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit[:1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back to the system at its end: Python workers outlive their tasks, and what one stage's memos took is not there for the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return wrapped
