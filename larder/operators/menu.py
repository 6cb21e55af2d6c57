"""Filters, orders, sections and shelves of a menu."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import serving_grams
from larder.operators.classify import section_order

SHELF_SIZE = 12
LITTLE_SUGAR = 6.0
# Words and phrases of soft drinks.
SODA_WORDS = ("cola", "coke", "pepsi", "sprite", "soda", "fanta")
SODA_PHRASES = ("dr pepper", "root beer", "mountain dew")


def on_menu(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce("off_menu", F.lit(False)))


def goal_filter(items: DataFrame, most_kcal: float | None = None, least_protein: float | None = None) -> DataFrame:
    """Both bounds are optional and inclusive."""
    if most_kcal is not None:
        items = items.where(F.col("kcal") <= most_kcal)
    if least_protein is not None:
        items = items.where(F.col("protein") >= least_protein)
    return items


def fewest_calories() -> list[Column]:
    return [F.asc("kcal"), F.asc("name"), F.asc("item_id")]


def most_protein() -> list[Column]:
    """Names descend too in this order."""
    return [F.desc("protein"), F.desc("name"), F.desc("item_id")]


def is_soda(name: Column) -> Column:
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), F.lit(" "))
    found = F.lit(False)
    for phrase in (*SODA_WORDS, *SODA_PHRASES):
        found = found | F.contains(text, F.lit(f" {phrase} "))
    return found


def sections(items: DataFrame) -> DataFrame:
    """Items with the rank of their section: the fixed order, unknown ones by name, the archive last."""
    archived = F.coalesce("off_menu", F.lit(False))
    name = F.when(archived, "Archive").otherwise(F.coalesce("category", F.lit("Other")))
    placed = items.withColumn("section", name).withColumn("_key", F.struct(archived.alias("a"), section_order(name).alias("b"), name.alias("c")))
    return placed.withColumn("section_rank", F.dense_rank().over(Window.partitionBy("chain").orderBy("_key"))).drop("_key")


def shelves(items: DataFrame, size: int = SHELF_SIZE) -> DataFrame:
    """The first ``size`` items of each chain's three shelves, with shelf and rank."""
    live = on_menu(items)
    sugar = F.col("sugar") / serving_grams(F.col("serving")) * 100
    little = live.withColumn("_per", sugar).where(F.col("_per") < LITTLE_SUGAR)

    def shelf(rows: DataFrame, title: str, *order: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("chain").orderBy(*order, F.asc("name"), F.asc("item_id")))
        return rows.withColumn("rank", rank).where(F.col("rank") <= size).select("chain", F.lit(title).alias("shelf"), "rank", "item_id")

    return (shelf(live, "High Protein", F.desc("protein")).unionByName(shelf(little, "Less Sugar", F.asc("_per")))
            .unionByName(shelf(live.withColumn("_soda", is_soda(F.col("name"))), "Less Calories", F.asc("_soda"), F.asc("kcal"))))


def comparison(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """field, left, right and difference (null where equal) of two one-row frames."""
    a = left.select(*fields).unpivot([], fields, "field", "left_value")
    b = right.select(*fields).unpivot([], fields, "field", "right_value")
    return a.join(b, "field").withColumn("difference", F.when(F.col("left_value") != F.col("right_value"), F.col("right_value") - F.col("left_value")))


def order_totals(lines: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Sums of the fields times quantity (clamped to 1 to 20; less than 1 goes), count, and any stale line."""
    kept = lines.where("quantity >= 1").withColumn("quantity", F.least(F.col("quantity"), F.lit(20)))
    return kept.groupBy(*by).agg(F.sum("quantity").cast("bigint").alias("item_count"), *[F.sum(F.col(f) * F.col("quantity")).alias(f) for f in fields],
                                 F.bool_or("stale").alias("stale"))
