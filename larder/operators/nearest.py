"""Nearest-neighbour join on one coordinate with a tolerance, without a product of two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, tie: str, tolerance: float) -> DataFrame:
    """Left rows with ``near``: distance, right_at and tie of the nearest right row of equal keys, or null.

    Rows farther off than ``tolerance`` don't count; of equally near ones the smaller coordinate wins,
    then the smaller tie. The coordinate is cut into bands a little wider than the tolerance, so what is
    near lies in the own band or in a neighbour: of a neighbour only its end matters, which is one row a
    band, and inside a band one pass in each direction carries the last right row along. Only distinct
    coordinates are ordered, so many rows at one place don't make a large window. Null keys and
    coordinates that are null or NaN match nothing.
    """
    width = tolerance * (1 + 1e-9) + 1e-12

    def placed(df: DataFrame, column: str) -> DataFrame:
        place = F.col(column).cast("double")
        return df.select(*keys, place.alias("_at"), *([F.col(tie).alias("_tie")] if df is right else [])).where(place.isNotNull() & ~F.isnan(place)).dropna(subset=keys)

    points = placed(right, right_at).groupBy(*keys, "_at").agg(F.min("_tie").alias("_tie"))
    point = F.struct(F.col("_at").alias("at"), F.col("_tie").alias("tie"))
    points = points.withColumn("_band", F.floor(F.col("_at") / width)).withColumn("_point", point)
    ends = points.groupBy(*keys, "_band").agg(F.min("_point").alias("_low"), F.max("_point").alias("_high"))
    asked = placed(left, at).distinct().withColumn("_band", F.floor(F.col("_at") / width))
    lane = [*keys, "_band"]
    both = asked.withColumn("_point", F.lit(None).cast(points.schema["_point"].dataType)).unionByName(points.drop("_tie"))
    side = F.col("_point").isNull()
    up = Window.partitionBy(*lane).orderBy("_at", side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*lane).orderBy(F.desc("_at"), side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumns({"_before": F.last("_point", True).over(up), "_after": F.last("_point", True).over(down)}).where(side).drop("_point")
    below = ends.select(*keys, (F.col("_band") + 1).alias("_band"), F.col("_high").alias("_below"))
    above = ends.select(*keys, (F.col("_band") - 1).alias("_band"), F.col("_low").alias("_above"))
    near = own.join(below, lane, "left").join(above, lane, "left")
    options = [F.when(F.abs(F.col(c)["at"] - F.col("_at")) <= tolerance, F.struct(F.abs(F.col(c)["at"] - F.col("_at")).alias("distance"), F.col(c)["at"].alias("at"), F.col(c)["tie"].alias("tie")))
               for c in ("_before", "_after", "_below", "_above")]
    found = near.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_at", F.array_min(F.array_compact(F.array(*options))).alias("near"))
    match = F.col(at).cast("double") == F.col("_at")
    for i, k in enumerate(keys):
        match = match & (F.col(k) == F.col(f"_k{i}"))
    return left.join(found, match, "left").select(*left.columns, "near")
