"""Writers of tables that are replaced by parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_by_source(rows: DataFrame, path: str, source: str = "source") -> None:
    """Each source in ``rows`` takes the place of all its former rows; other sources stay as they are.

    The table is laid out by source, and only partitions that ``rows`` has are overwritten, so the same
    write twice leaves one state. Rows without a source are one source of their own; no rows change nothing.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def record_crawls(log: DataFrame, path: str, observed: str) -> None:
    """Log rows of one day, by chain; a day's record of a chain that is written again takes its own place.

    Records of other days and chains stay. No catalog row is touched, so a held crawl leaves its record alone.
    """
    dated = log.withColumn("observed", F.lit(observed))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("observed", "chain").parquet(path)
