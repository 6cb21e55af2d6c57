"""Pack documents: reading with a format gate, compact writing with digests, and raw DEFLATE."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1
ITEM = T.StructType([T.StructField(n, t) for n, t in (
    ("chain", T.StringType()), ("key", T.StringType()), ("name", T.StringType()), ("category", T.StringType()), ("serving", T.StringType()),
    ("kcal", T.DoubleType()), ("protein", T.DoubleType()), ("carbs", T.DoubleType()), ("fat", T.DoubleType()), ("sugar", T.DoubleType()),
    ("flags", T.ArrayType(T.StringType())), ("offMenu", T.BooleanType()), ("source", T.StringType()), ("observed", T.StringType()), ("stale", T.BooleanType()))])
PACK = T.StructType([T.StructField("format", T.IntegerType()), T.StructField("version", T.LongType()), T.StructField("source", T.StringType()),
                     T.StructField("observed", T.StringType()), T.StructField("stale", T.BooleanType()), T.StructField("items", T.ArrayType(ITEM))])


@F.pandas_udf(T.BinaryType())
def deflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Raw DEFLATE at the highest level, without a zlib header."""
    for batch in batches:
        out = []
        for data in batch:
            packer = zlib.compressobj(9, zlib.DEFLATED, -15)
            out.append(packer.compress(bytes(data)) + packer.flush())
        yield pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def inflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Undo raw DEFLATE; null for damaged or no data."""
    for batch in batches:
        out = []
        for data in batch:
            try:
                out.append(None if data is None else zlib.decompress(bytes(data), -15))
            except zlib.error:
                out.append(None)
        yield pd.Series(out, dtype=object)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of whole pack documents of the known format; empty packs and others are left out."""
    packs = spark.read.schema(PACK).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    items = packs.where((F.col("format") == FORMAT) & (F.size("items") > 0)).select("version", "source", "observed", "stale", F.explode("items").alias("i"))
    return items.select("version", *[F.coalesce(f"i.{c}", c).alias(c) if c in ("source", "observed", "stale") else F.col(f"i.{c}") for c in ITEM.names])


def best_pack(packs: DataFrame) -> DataFrame:
    """Items of the highest version."""
    top = packs.agg(F.max("version").alias("version"))
    return packs.join(F.broadcast(top), "version")  # one row


def best_of(artifacts: DataFrame) -> DataFrame:
    """chain, origin, version, items and damaged: the artifact to use of each chain's seed and download.

    ``artifacts`` has chain, origin ("seed" or another), sha256 and deflated bytes, a row each. An
    artifact is taken or left as a whole: one whose digest, bytes, document or format is wrong, or that
    has no items, is set apart and named in ``damaged``. The highest version wins, and the seed where a
    download isn't newer; a chain without a whole artifact has nulls.
    """
    opened = artifacts.withColumn("pack", F.from_json(inflate("deflated").cast("string"), PACK, {"mode": "PERMISSIVE"}))
    whole = F.coalesce((F.sha2("deflated", 256) == F.col("sha256")) & (F.col("pack.format") == FORMAT) & (F.size("pack.items") > 0) & F.col("pack.version").isNotNull(), F.lit(False))
    told = opened.withColumn("whole", whole)
    rank = F.struct(F.col("pack.version").alias("version"), (F.col("origin") == "seed").alias("is_seed"), "origin")
    best = told.groupBy("chain").agg(F.max(F.when(F.col("whole"), rank)).alias("best"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("origin")))).alias("damaged"))
    items = told.where("whole").select("chain", "origin", F.col("pack.version").alias("version"), F.col("pack.items").alias("items"))
    chosen = best.select("chain", "best.origin", "best.version", "damaged").join(items.dropDuplicates(["chain", "origin", "version"]), ["chain", "origin", "version"], "left")
    return chosen.select("chain", "origin", "version", "items", F.array_join("damaged", ",").alias("damaged"))


def build_packs(items: DataFrame, version: int) -> DataFrame:
    """One compact JSON document per chain, with its digest, size and DEFLATE bytes.

    Items are in a total order, so equal input gives equal bytes; a chain's items are one document
    by definition of the format.
    """
    item = F.struct(*[F.col(c) for c in items.columns if c != "chain"])
    grouped = items.groupBy("chain").agg(F.count("*").alias("item_count"), F.array_sort(F.collect_list(F.struct("name", "key", item.alias("item")))).alias("rows"))
    document = F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(version).alias("version"), F.transform("rows", lambda r: r["item"]).alias("items")))
    packed = grouped.select("chain", "item_count", document.alias("document")).withColumn("deflated", deflate(F.col("document").cast("binary")))
    return packed.withColumn("sha256", F.sha2("deflated", 256)).withColumn("bytes", F.octet_length("deflated"))


def manifest(packs: DataFrame, url: str) -> DataFrame:
    return packs.select("chain", F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.concat(F.lit(url), "sha256").alias("url"), "sha256", "bytes", "item_count")).alias("manifest"))


def installable(offered: DataFrame, installed_version: int, host: str) -> DataFrame:
    """Offers that are newer, from the same host, whole by digest, of the known format and not empty."""
    opened = offered.withColumn("document", inflate("deflated").cast("string"))
    parsed = opened.withColumn("pack", F.from_json("document", PACK))
    good = ((F.parse_url("url", F.lit("HOST")) == host) & (F.sha2("deflated", 256) == F.col("sha256")) & (F.col("pack.format") == FORMAT)
            & (F.col("pack.version") > installed_version) & (F.size("pack.items") > 0))
    return parsed.where(good).drop("document")
