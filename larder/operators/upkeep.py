"""Upkeep of a catalog: merged tables, gates on releases and readiness, choices that screens make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``target`` with ``changes`` put in place of rows of equal ``keys``, or added.

    Of several changes of one key the last by ``order`` wins, ties by the greatest values. Null keys equal nothing,
    so such rows are added.
    """
    values = [c for c in target.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("_new"))
    rows = target.select(*keys, F.struct(*values).alias("_old")).join(last, keys, "full")
    return rows.select(*keys, *[F.coalesce("_new", "_old")[v].alias(v) for v in values])


def update_from(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the other columns of ``changes`` (one row a key) set where keys are equal, nulls too."""
    columns = [c for c in changes.columns if c not in keys]
    rows = target.join(changes.select(*keys, F.struct(*columns).alias("_new")), keys, "left")
    new = F.col("_new")
    return rows.select(*[F.when(new.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def overlay(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both (one a key in each); of equal keys the right one stays, null keys among themselves too."""
    values = [c for c in left.columns if c not in keys]
    rows = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_side").alias("_row")).select(*keys, *[F.col("_row")[v].alias(v) for v in values])


def with_child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Every parent with the number of children of its key, 0 if none."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])


def next_versions(parents: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """Every key with the version after its greatest one; 1 if it has none."""
    last = versions.groupBy(key).agg(F.max(version).alias("_last"))
    return parents.join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).alias("next_version"))


def release_outcomes(released: DataFrame, offered: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Each offered artifact as new, same (equal digest) or conflict: a release never changes its bytes.

    A released row without a digest counts as none; an offered one without a digest is a conflict.
    """
    rows = offered.join(released.select(*keys, F.col(digest).alias("_kept")), keys, "left")
    outcome = F.when(F.col("_kept").isNull(), "new").when(F.col("_kept") == F.col(digest), "same").otherwise("conflict")
    return rows.select(*keys, outcome.alias("outcome"))


def regressions(runs: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """The latest two runs of each key: whether the last one is ok, and whether it fell from ok to not ok."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    rows = runs.withColumn("_n", F.row_number().over(latest)).where("_n <= 2")
    now, was = F.max(F.when(F.col("_n") == 1, F.col(ok))), F.max(F.when(F.col("_n") == 2, F.col(ok)))
    return rows.groupBy(key).agg(now.alias("ok"), F.coalesce(was & ~now, F.lit(False)).alias("regressed"))


def clashes(adopted: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several adopted rows share or that the catalog has already; null keys are left out."""
    known = catalog.select(*keys).distinct().withColumn("in_catalog", F.lit(True))
    counted = adopted.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.join(known, keys, "left").fillna(False, ["in_catalog"]).where("n > 1 or in_catalog")


def holds(adopted: DataFrame, catalog: DataFrame, by: str, key: str, shown: int = 6) -> DataFrame:
    """Per ``by`` whose adopted rows clash: ``twins`` and ``known``, the first keys that clash among themselves or with the catalog.

    Only ``shown`` keys of each kind are told (the clash itself counts all); a kind without clashes is null.
    """
    found = clashes(adopted, catalog, [by, key])
    kinds = found.select(by, key, F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "twins"), F.when(F.col("in_catalog"), "known")))).alias("kind"))
    few = kinds.withColumn("_n", F.row_number().over(Window.partitionBy(by, "kind").orderBy(key))).where(F.col("_n") <= shown)
    told = lambda kind: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col(key)))), ", "), F.lit(""))
    return few.groupBy(by).agg(told("twins").alias("twins"), told("known").alias("known"))


def crawl_log(crawls: DataFrame, adopted: DataFrame, catalog: DataFrame, key: str = "ext_key") -> tuple[DataFrame, DataFrame]:
    """A log row for each crawl, and the adopted rows that may be stored: none of a chain that is held.

    ``crawls`` has chain, found, changed and dropped; a chain is held if its adopted rows clash by key, since one
    would take another's place unseen. Rows of a null chain are logged as ok and clash with nothing.
    """
    held = holds(adopted, catalog, "chain", key)
    stored = adopted.join(held.select("chain"), "chain", "left_anti")
    counts = stored.groupBy("chain").agg(F.count("*").alias("adopted"))
    why = F.concat_ws("; ", F.concat(F.lit("each other: "), "twins"), F.concat(F.lit("catalog: "), "known"))
    log = crawls.select("chain", "found", "changed", "dropped").join(held, "chain", "left").join(counts, "chain", "left")
    return log.select("chain", "found", "changed", "dropped", F.coalesce("adopted", F.lit(0)).alias("adopted"), F.when(why == "", "ok").otherwise("held").alias("status"), why.alias("notes")), stored


def first_copies(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row for each set of equal ``columns`` (nulls equal), with the least ``order``."""
    return rows.groupBy(*columns).agg(F.min(order).alias(order))


def wanted(column: str, values: list[str] | None) -> Column:
    """Whether the column is one of ``values``; None takes all rows."""
    return F.lit(True) if values is None else F.col(column).isin(values)


def macro_share(grams: Column, factor: int, protein: Column, carbs: Column, fat: Column) -> Column:
    """Share of energy that ``grams`` give, 0 where the total is 0 or unknown."""
    total = protein * 4 + carbs * 4 + fat * 9
    return F.when(total > 0, grams * factor / total).otherwise(F.lit(0.0))


def variant_photo(rows: DataFrame, group: list[str], item: str, photo: str) -> DataFrame:
    """``photo`` of each item: its own, else that of the first variant of its group with one, else null."""
    first = rows.where(F.col(photo).isNotNull()).groupBy(*group).agg(F.min_by(photo, item).alias("_first"))
    return rows.join(first, group, "left").withColumn(photo, F.coalesce(photo, "_first")).drop("_first")


def section_order(rows: DataFrame, group: str, section: str, position: str, first: str) -> DataFrame:
    """Sections of each group by first appearance, with section ``first`` before all; null sections are left out."""
    seen = rows.where(F.col(section).isNotNull()).groupBy(group, section).agg(F.min(position).alias("_at"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(section) != first, "_at", section))
    return seen.select(group, section, place.alias("place"))


def first_of_each(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; the limit is applied before the shuffle too."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def answer_outcomes(answers: DataFrame, asked: str, matched: str, venue: str) -> DataFrame:
    """Counters of each asked key: answers, those matching it, their venues, and repeats of venues."""
    same = F.col(asked).eqNullSafe(F.col(matched)) & F.col(asked).isNotNull()
    counted = answers.groupBy(asked).agg(F.count("*").alias("answers"), F.count_if(same).alias("verified"), F.count_distinct(F.when(same, F.col(venue))).alias("venues"))
    return counted.withColumn("repeats", F.col("verified") - F.col("venues"))


def covers(words: Column, others: Column) -> Column:
    """Whether all of ``others`` stand in ``words``; an empty list is covered."""
    return F.size(F.array_except(others, words)) == 0
