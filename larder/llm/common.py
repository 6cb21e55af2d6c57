"""Helpers shared by the corpus operators: table reading, checkpoints, seeds."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared ``spark.checkpoint.dir``; without one only a local session gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="larder-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    """Null texts count as empty texts in every operator."""
    return F.coalesce(F.col(column), F.lit(""))


def release() -> None:
    """Gives freed memory back: what Arrow's and the C library's allocators keep counts for a worker or the driver until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; numpy's and Python's memory is there, and Arrow's pools don't trim it
    if trim is not None:
        trim(0)
