"""Variants of one dish: size words learned from the catalog, groups, and their representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.checkpoints import cut
from larder.functions.text import slug

# The order of size words, and the thresholds of learning others.
SIZE_ORDER = {"kids": 0, "kid's": 0, "child": 0, "mini": 1, "snack": 1, "jr": 1, "extra small": 2, "short": 2, "small": 3, "tall": 4, "cup": 4,
              "regular": 5, "medium": 6, "grande": 6, "bowl": 6, "large": 7, "venti": 8, "extra large": 9}
MIN_SHARED_BASES, MAX_LEARNED_WORDS = 3, 2
# Patterns of labels that are sizes, of counts before a name, and of options after it.
VOLUME = r"(?i)^\d+(\.\d+)?\s*(fl\s*)?oz$"
SLICES = r"(?i)^\d*\s*slices?$"
MEASURE = r"(?i)^\d+(\.\d+)?\s*(\"|''|in|inch|liter|l|ml|g|oz|lb|pc|ct)?\.?$"
NOT_A_SIZE = r"(?i)(&|\bw/|\bwith\b|\bfor\b)"
COUNTED = r"(?i)^(\d+(?:\.\d+)?)\s*(oz|lb|pc|pcs|piece|pieces|ct|count)?\s+(\S.*)$"
WITH = r"(?i)\s+w(?:/|ith)\s+"
PLAIN, SIZE, OPTION = "Plain", "size", "option"


def _tail(name: Column) -> Column:
    """struct<base, label> around the last comma; null without one or with an empty side."""
    base = F.trim(F.regexp_extract(name, r"^(.*),([^,]*)$", 1))
    label = F.trim(F.regexp_extract(name, r"^(.*),([^,]*)$", 2))
    return F.when((base != "") & (label != ""), F.struct(base.alias("base"), label.alias("label")))


def learn_size_words(items: DataFrame) -> DataFrame:
    """chain and label (lower case): tails that follow at least three different names in the chain."""
    return _learned(items.select("chain", _tail(F.col("name")).alias("tail")))


def _learned(named: DataFrame) -> DataFrame:
    """The same of chain and tail."""
    tails = named.where("tail is not null").select("chain", "tail.*")
    short = tails.where((F.size(F.split(F.trim("label"), r"\s+")) <= MAX_LEARNED_WORDS) & ~F.regexp_like("label", F.lit(NOT_A_SIZE)))
    return (short.groupBy("chain", F.lower("label").alias("label")).agg(F.countDistinct(F.lower("base")).alias("bases"))
            .where(F.col("bases") >= MIN_SHARED_BASES).select("chain", "label"))


def _parsed(tail: Column) -> Column:
    """struct<base, label, kind> of the first rule that holds without learned words: size tail, count, option."""
    name = F.col("name")
    is_size = (F.lower(tail["label"]).isin(*SIZE_ORDER) | F.regexp_like(tail["label"], F.lit(VOLUME))
               | F.regexp_like(tail["label"], F.lit(SLICES)) | F.regexp_like(tail["label"], F.lit(MEASURE)))
    number, unit, counted = (F.regexp_extract(name, COUNTED, i) for i in (1, 2, 3))
    parts = F.split(name, WITH, 2)
    base, option = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))

    def found(b: Column, label: Column, kind: str) -> Column:
        return F.struct(b.alias("base"), label.alias("label"), F.lit(kind).alias("kind"))

    return (F.when(tail.isNotNull() & is_size, found(tail["base"], tail["label"], SIZE))
            .when(F.regexp_like(name, F.lit(COUNTED)), found(F.trim(counted), F.when(unit != "", F.concat_ws(" ", number, unit)).otherwise(number), SIZE))
            .when((F.size(parts) == 2) & (base != "") & (option != ""), found(base, option, OPTION)))


def group_key(base: Column) -> Column:
    """Slug of the name with its last word in the singular."""
    text = F.trim(F.regexp_replace(base, r"\s+", " "))
    return slug(F.when(F.regexp_like(text, F.lit(r"(?i)(^| )\S{3,}s$")), F.regexp_replace(text, r"(?i)s$", "")).otherwise(text))


def label_rank(label: Column) -> Column:
    """struct that orders labels: known size words, then leading numbers, then Plain, then others."""
    known = F.try_element_at(F.create_map(*[x for word, place in SIZE_ORDER.items() for x in (F.lit(word), F.lit(float(place)))]), F.lower(label))
    number = F.regexp_extract(label, r"^(\d+(?:\.\d+)?)", 1)
    tier = F.when(known.isNotNull(), 0).when(number != "", 1).otherwise(2)
    value = F.when(known.isNotNull(), known).when(number != "", number.try_cast("double")).when(label == PLAIN, F.lit(-1.0)).otherwise(F.lit(0.0))
    return F.struct(tier.alias("tier"), value.alias("value"), label.alias("label"))


def assign_groups(items: DataFrame) -> DataFrame:
    """chain, item_id, group, label, position, kind and base of every item that has variants.

    Items are read in the order of item_id. An item whose own name is the base of an option group
    joins it as Plain, and that assignment wins over its own; groups of one are left out.
    """
    # Names are read once: what is learned only lets a tail win that no rule of sizes knows.
    named = items.select("chain", "item_id", "name").withColumn("tail", _tail(F.col("name"))).withColumn("v", _parsed(F.col("tail")))
    rows = cut(named.select("chain", "item_id", "name", "tail", "v", group_key(F.col("name")).alias("own_key"), group_key(F.col("v.base")).alias("key"), group_key(F.col("tail.base")).alias("tail_key")))
    learned = _learned(rows).select("chain", F.col("label").alias("_label"), F.lit(True).alias("_known"))
    tailed = rows.where("tail is not null").withColumn("_label", F.lower(F.col("tail.label"))).join(learned, ["chain", "_label"], "left")
    sized = F.struct(F.col("tail.base").alias("base"), F.col("tail.label").alias("label"), F.lit(SIZE).alias("kind"))
    read = (tailed.select("chain", "item_id", F.when(F.col("_known"), sized).otherwise(F.col("v")).alias("v"), F.when(F.col("_known"), F.col("tail_key")).otherwise(F.col("key")).alias("group"))
            .unionByName(rows.where("tail is null").select("chain", "item_id", "v", F.col("key").alias("group"))))
    own = read.where("v is not null").select("chain", "item_id", "v.*", "group", F.lit(0).alias("later"))
    option_groups = own.where(F.col("kind") == OPTION).select("chain", "group").distinct()
    plain = (rows.select("chain", "item_id", F.col("name").alias("base"), F.lit(PLAIN).alias("label"), F.lit(OPTION).alias("kind"),
                         F.col("own_key").alias("group"), F.lit(1).alias("later")).join(option_groups, ["chain", "group"], "left_semi"))
    members = own.unionByName(plain)
    bucket = Window.partitionBy("chain", "group")
    ranked = members.withColumns({
        "n": F.count("*").over(bucket), "group_kind": F.when(F.bool_or(F.col("kind") == SIZE).over(bucket), SIZE).otherwise(OPTION),
        "group_base": F.max_by("base", F.struct("later", "item_id")).over(bucket),
        "position": F.row_number().over(bucket.orderBy(label_rank(F.col("label")), "later", "item_id")) - 1}).where("n > 1")
    last = Window.partitionBy("chain", "item_id").orderBy(F.desc("later"), F.desc("position"))
    return (ranked.withColumn("rn", F.row_number().over(last)).where("rn = 1")
            .select("chain", "item_id", "group", "label", "position", F.col("group_kind").alias("kind"), F.col("group_base").alias("base")))


def representatives(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The middle row of each group, of those with a photo if any has one; the lower of two middles."""
    bucket = Window.partitionBy(*group)
    photo = F.coalesce("has_photo", F.lit(False))
    some = rows.withColumn("_any", F.bool_or(photo).over(bucket)).where(photo | ~F.col("_any"))
    placed = some.withColumn("_rn", F.row_number().over(bucket.orderBy(order, "item_id"))).withColumn("_n", F.count("*").over(bucket))
    return placed.where(F.expr("_rn - 1 = (_n - 1) div 2")).drop("_any", "_rn", "_n")


def collapse(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows without a group, and one representative of each group; a filter belongs before this."""
    rows = cut(rows)
    alone = rows.where(F.col(group[-1]).isNull())
    return alone.unionByName(representatives(rows.where(F.col(group[-1]).isNotNull()), group, order))


def range_text(low: Column, high: Column, unit: str) -> Column:
    """'100–290 kcal', or one number where both round alike."""
    a, b = F.round(low).cast("bigint").cast("string"), F.round(high).cast("bigint").cast("string")
    return F.when(a == b, F.concat(a, F.lit(f" {unit}"))).otherwise(F.concat(a, F.lit("–"), b, F.lit(f" {unit}")))
