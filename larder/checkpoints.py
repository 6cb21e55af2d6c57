"""Cutting of lineage in the folder that the driver and all executors share, and dealing out of rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read from there; only a local session gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="larder-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """``df`` dealt over all cores by a hash of ``by``, before work that costs much a row.

    A file of few, well compressed row groups is read by few tasks, and what is computed on its rows would
    stay in them. The number is given, so that adaptive execution doesn't put the partitions together again.
    """
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts or min(shuffled, 4 * spark.sparkContext.defaultParallelism), *by)
