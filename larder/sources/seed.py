"""The quoted seed file: scan, clean, first row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.text import clean, seed_number, slug

# Source columns of the values, and of the flags.
NUMBERS = {"kcal": "Calories", "protein": "Protein", "carbs": "Carbohydrates", "fat": "Total_Fat", "sat_fat": "Saturated_Fat", "trans_fat": "Trans_Fat",
           "cholesterol": "Cholesterol", "sodium": "Sodium", "sugar": "Sugar", "fiber": "Dietary_Fiber"}
FLAG_COLUMNS = {"kids": "Kids_Meal", "shareable": "Shareable", "regional": "Regional", "seasonal": "Limited_Time_Offer"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the rows' order."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.withColumn("source_row", F.monotonically_increasing_id())


def parse(raw: DataFrame) -> DataFrame:
    """Clean items: combination rows and rows without four macros go, the first of each key stays."""
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    unit = F.concat_ws(" ", clean(col("Serving_Size")), clean(col("Serving_Size_Unit")))
    serving = F.coalesce(clean(col("Serving_Size_household")), F.nullif(unit, F.lit("")))
    rows = raw.where(F.coalesce(F.trim(col("Combo_Meal")), F.lit("0")) != "1").select(
        clean(col("Restaurant")).alias("chain"), clean(col("Item_Name")).alias("name"), clean(col("Food_Category")).alias("category"), serving.alias("serving"),
        *[seed_number(col(c)).alias(f) for f, c in NUMBERS.items()],
        F.array_compact(F.array(*[F.when(F.trim(col(c)) == "1", F.lit(f)) for f, c in FLAG_COLUMNS.items()])).alias("flags"), "source_row")
    whole = rows.dropna(subset=["chain", "name", "kcal", "protein", "carbs", "fat"]).withColumn("ext_key", slug(F.col("name")))
    order = Window.partitionBy("chain", "ext_key").orderBy("source_row")
    return whole.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "source_row").orderBy("chain", "name")
