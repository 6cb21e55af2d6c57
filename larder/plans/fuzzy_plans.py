"""Queries of fuzzy matching; ratios of matching blocks have no SQL form, so tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import matching
from larder.plans.items import items
from larder.plans.registry import query


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog, and a fresh observation of two thirds of it with names written otherwise."""
    stored = items(spark, sf_dir).select("chain", F.col("item_id").cast("string").alias("ext_key"), "name")
    told = F.when(F.col("item_id") % 3 == 0, F.regexp_replace("name", "Chicken", "Chiken")).when(F.col("item_id") % 3 == 1, F.regexp_replace("name", "^([a-z]+) ([a-z]+) ", "$2 $1 ")).otherwise(F.col("name"))
    live = items(spark, sf_dir).where("item_id % 9 < 6").select("chain", F.concat(F.lit("x"), F.col("item_id").cast("string")).alias("ext_key"), told.alias("name"))
    return live, stored


@query()
def fuzzy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.assign(*_named(spark, sf_dir))


@query()
def photo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, stored = _named(spark, sf_dir)
    return matching.photo_pairs(stored, live.withColumnRenamed("ext_key", "shot_key"))


@query()
def menu_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, stored = _named(spark, sf_dir)
    return matching.present(stored, live)


@query()
def best_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_ratios(*_named(spark, sf_dir))
