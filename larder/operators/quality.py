"""Consistency rules of nutrition rows, changes between observations, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and tolerances.
CEILINGS = {"kcal": 5000.0, "protein": 250.0, "carbs": 500.0, "fat": 400.0}
FRACTIONS = (("sat_fat", "fat"), ("trans_fat", "fat"), ("sugar", "carbs"), ("fiber", "carbs"))
FRACTION_SLACK = 1.0
LABEL_CEILINGS = {"cholesterol": 5000.0, "sodium": 30000.0}
LARGE_PORTION = 2000.0
ENERGY_FLOOR, OVER, UNDER, UNDER_ERROR, SUGAR_ALCOHOL_OVER = 50.0, 0.25, 0.30, 0.75, 0.60
SUGAR_ALCOHOL_HINTS = ("no sugar added", "sugar free", "sugar-free", "diet ", "light ice cream")
NOISE = {"kcal": 5.0, "sodium": 1.0, "cholesterol": 1.0}
GRAM_NOISE = 1.0
RELATIVE_NOISE_FIELDS, RELATIVE_NOISE = ("sodium", "cholesterol"), 0.02
SUSPICIOUS_SHARE = 0.30
SUSPICIOUS_FLOOR = {"kcal": 50.0, "sodium": 100.0, "cholesterol": 100.0}
GRAM_FLOOR = 5.0
MAX_CHANGED, MAX_DROPPED = 0.30, 0.20


def energy(protein: Column, carbs: Column, fat: Column) -> Column:
    """Kilocalories that the macros explain: 4, 4 and 9 a gram."""
    return protein * 4.0 + carbs * 4.0 + fat * 9.0


def _problem(condition: Column, kind: str, field: str, severity: str | Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(condition, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), level.alias("severity")))


def broken(field: str) -> Column:
    """Whether a label field can't be right: negative, over its ceiling, or a part over its whole."""
    value = F.col(field)
    if field in LABEL_CEILINGS:
        return F.coalesce((value < 0) | (value > LABEL_CEILINGS[field]), F.lit(False))
    whole = F.col(dict(FRACTIONS)[field])
    return F.coalesce((whole.isNotNull() & (value < 0)) | (value > whole + FRACTION_SLACK), F.lit(False))


def problems() -> Column:
    """array<struct<kind, field, severity>> of a row; errors block a release, warnings are reported."""
    expected = energy(F.col("protein"), F.col("carbs"), F.col("fat"))
    drift = (expected - F.col("kcal")) / F.col("kcal")
    told = F.lower(F.concat_ws(" ", "name", "category"))
    sweet = F.lit(False)
    for hint in SUGAR_ALCOHOL_HINTS:
        sweet = sweet | F.contains(told, F.lit(hint))
    checked = (F.col("kcal") >= ENERGY_FLOOR) & (expected > 0) & ~(sweet & (drift <= SUGAR_ALCOHOL_OVER))
    found = [_problem((F.col(f) < 0) | (F.col(f) > top), "range", f, "error") for f, top in CEILINGS.items()]
    found += [_problem(broken(f), "label", f, "warning") for f in (*dict(FRACTIONS), *LABEL_CEILINGS)]
    found.append(_problem(F.col("kcal") > LARGE_PORTION, "portion", "kcal", "warning"))
    found.append(_problem(checked & (drift > OVER), "atwater", "kcal", "error"))
    found.append(_problem(checked & ~(drift > OVER) & (-drift > UNDER), "atwater", "kcal", F.when(-drift > UNDER_ERROR, "error").otherwise("warning")))
    return F.array_compact(F.array(*found))


def check_items(items: DataFrame) -> DataFrame:
    """One row per problem: the item's columns chain, item_id, name, and kind, field, severity."""
    return items.select("chain", "item_id", "name", F.explode(problems()).alias("p")).select("chain", "item_id", "name", "p.*")


def strip_broken_labels(items: DataFrame) -> DataFrame:
    """Broken label fields become null; rows stay."""
    return items.withColumns({f: F.when(~broken(f), F.col(f)) for f in (*dict(FRACTIONS), *LABEL_CEILINGS)})


def releasable(items: DataFrame) -> DataFrame:
    """Rows whose (chain, name) has no error anywhere in the catalog."""
    bad = check_items(items).where("severity = 'error'").select("chain", "name").distinct()
    return items.join(bad, ["chain", "name"], "left_anti")


def plausible(field: str) -> Column:
    """The value if it lies between zero and its ceiling, else null."""
    top = (CEILINGS | LABEL_CEILINGS)[field]
    return F.when(F.col(field).between(0.0, top), F.col(field))


def _noise(field: str, was: Column) -> Column:
    base = F.lit(NOISE.get(field, GRAM_NOISE))
    return F.greatest(base, F.abs(was) * RELATIVE_NOISE) if field in RELATIVE_NOISE_FIELDS else base


def changes(fields: list[str], was: str = "was", now: str = "now") -> Column:
    """array<struct<field, was, now>>, by field name, of what differs beyond the field's noise."""
    found = []
    for f in sorted(fields):
        a, b = F.col(f"{was}.{f}"), F.col(f"{now}.{f}")
        found.append(F.when(F.abs(b - a) > _noise(f, a), F.struct(F.lit(f).alias("field"), a.alias("was"), b.alias("now"))))
    return F.array_compact(F.array(*found))


def suspicious(found: Column) -> Column:
    """Whether any change is both over a share of the old value and over the field's floor."""
    def large(c: Column) -> Column:
        floor = F.lit(GRAM_FLOOR)
        for field, value in SUSPICIOUS_FLOOR.items():
            floor = F.when(c["field"] == field, F.lit(value)).otherwise(floor)
        gap = F.abs(c["now"] - c["was"])
        return (c["was"] > 0) & (gap / c["was"] > SUSPICIOUS_SHARE) & (gap > floor)

    return F.exists(found, large)


def change_summary(found: Column) -> Column:
    whole = lambda x: F.round(x).cast("bigint").cast("string")
    return F.array_join(F.transform(found, lambda c: F.concat(c["field"], F.lit(": "), whole(c["was"]), F.lit("→"), whole(c["now"]))), ", ")


def diff_gate(previous: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: rows before, dropped and changed ones, and whether the release is held.

    Both shares are of the previous rows; an empty previous set is never held.
    """
    old = previous.select(F.col(key).alias("k"), F.struct(*fields).alias("was"))
    new = current.select(F.col(key).alias("k"), F.struct(*fields).alias("now"))
    joined = old.join(new, "k", "left")
    counts = joined.agg(F.count("*").alias("before"), F.count_if(F.col("now").isNull()).alias("dropped"),
                        F.count_if(F.col("now").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))).alias("changed"))
    held = (F.col("dropped") > F.col("before") * MAX_DROPPED) | (F.col("changed") > F.col("before") * MAX_CHANGED)
    return counts.withColumn("held", F.coalesce(held & (F.col("before") > 0), F.lit(False)))


def loss_guard(previous: DataFrame, current: DataFrame, fields: list[str], most: float = 0.05) -> DataFrame:
    """field, before, now and lost: filled values of each field, and of all rows, that went missing."""
    def filled(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(F.count("*").alias("rows"), *[F.count(f).alias(f) for f in fields])
        return counts.unpivot([], ["rows", *fields], "field", name)

    both = filled(previous, "before").join(filled(current, "now"), "field")
    return both.withColumn("lost", F.col("now") < F.col("before") * (1 - most))


def drift_gate(items: DataFrame, by: str, most: float = 0.10) -> DataFrame:
    """Median relative distance of kcal from what macros explain, and whether a source passes."""
    gap = F.abs(energy(F.col("protein"), F.col("carbs"), F.col("fat")) - F.col("kcal")) / F.col("kcal")
    rows = items.where(F.col("kcal") >= ENERGY_FLOOR).groupBy(by).agg(F.round(F.median(gap), 6).alias("median_drift"), F.median("sodium").alias("median_sodium"))
    return rows.withColumn("passes", (F.col("median_drift") <= most) & (F.col("median_sodium") >= 50))
