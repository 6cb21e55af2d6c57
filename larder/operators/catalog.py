"""The export view, queue states, presence and readiness of a versioned catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least share of fresh rows for a chain to be ready, and flag names in their order.
FRESH_SHARE = 0.90
FLAGS = ("kids", "shareable", "regional", "seasonal")


def current(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("valid_to").isNull())


def patched(base: dict[str, Column], patch: Column) -> Column:
    """JSON of the base fields overlaid by a JSON patch, without nulls; a null in the patch takes a field away.

    Only the named fields are patched; the patch is read once by a schema of strings.
    """
    fields = ", ".join(f"{name} STRING" for name in base)
    given, keys = F.from_json(patch, fields), F.coalesce(F.json_object_keys(patch), F.array().cast("array<string>"))
    return F.to_json(F.struct(*[F.when(F.array_contains(keys, F.lit(n)), given[n]).otherwise(v.cast("string")).alias(n) for n, v in base.items()]))


def ordered_flags(flags: Column) -> Column:
    """Known flags in their fixed order; unknown ones are dropped."""
    return F.filter(F.array(*[F.lit(f) for f in FLAGS]), lambda f: F.array_contains(flags, f))


def unknown_flags(flags: Column) -> Column:
    return F.array_except(flags, F.array(*[F.lit(f) for f in FLAGS]))


def queue_state(paused: Column, last: Column, every_days: Column, as_of: Column) -> Column:
    """paused, never, due or fresh, in this priority."""
    due = last + F.make_dt_interval(every_days) < as_of
    return F.when(paused, "paused").when(last.isNull(), "never").when(due, "due").otherwise("fresh")


def mode_first_seen(df: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """The commonest value of each group; of equally common ones the one seen first. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(F.col(value), F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def readiness(rows: DataFrame) -> DataFrame:
    """Per chain: cards, items, share of dishes with a photo, share of fresh cards, and whether it is ready.

    ``rows`` has chain, card, has_photo, fresh, off_menu and wants_photo. Archived rows don't count;
    a card has a photo if any row has, is fresh if all rows are, and is a dish if any row wants one.
    """
    cards = rows.where(~F.coalesce("off_menu", F.lit(False))).groupBy("chain", "card").agg(
        F.count("*").alias("n"), F.bool_or("has_photo").alias("photo"), F.bool_and("fresh").alias("fresh"), F.bool_or("wants_photo").alias("dish"))
    share = lambda c, of: F.count_if(c & of) / F.count_if(of)
    chains = cards.groupBy("chain").agg(
        F.count("*").alias("cards"), F.sum("n").alias("items"), F.coalesce(share(F.col("photo"), F.col("dish")), F.lit(1.0)).alias("photo_share"),
        share(F.col("fresh"), F.lit(True)).alias("fresh_share"))
    return chains.withColumn("ready", F.col("fresh_share") >= FRESH_SHARE)


def ready_rows(rows: DataFrame) -> DataFrame:
    """Rows of ready chains, archived ones too, as they go into a pack; ``rows`` as for ``readiness``."""
    return rows.join(readiness(rows).where("ready").select("chain"), "chain", "left_semi")


def with_pack_defaults(items: DataFrame, column: str, default: Column) -> DataFrame:
    """Null out values equal to the pack's default; a reader coalesces them again."""
    return items.withColumn(column, F.when(~F.col(column).eqNullSafe(default), F.col(column)))


def page(df: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """The ``number``-th page (from 0) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)
