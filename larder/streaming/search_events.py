"""Telemetry and observations as streams: windowed counts, and versions applied per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.history import close_and_insert, insert_new


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 8) -> DataFrame:
    """Event files as a stream; the time is cast, as watermarks need a time with zone."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events, and approximate users, by window and type; events later than ``late`` are dropped."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
            .agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
            .select(F.col("window.start").alias("start"), "event_type", "n", "users"))


def first_seen(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first event; state is kept as long as a repeat may arrive."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def apply_versions(store_path: Callable[[int], str], key: list[str], values: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: closes changed versions, adds new ones, and writes the next table.

    ``store_path(n)`` names the table after batch n; a repeated batch writes the same table again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*values), "ts").alias("v"), F.max("ts").alias("now")).select(*key, "v.*", "now")
        store = spark.read.parquet(store_path(number - 1))
        at = batch.agg(F.max("ts")).first()[0]
        if at is None:
            store.write.mode("overwrite").parquet(store_path(number))
            return
        moved = close_and_insert(store, latest, key, values, F.lit(at))
        added = latest.select(*key, *values, F.col("now").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
        insert_new(moved, added, key).write.mode("overwrite").parquet(store_path(number))

    return apply
