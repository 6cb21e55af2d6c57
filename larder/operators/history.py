"""Slowly changing versions and upserts as pure DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(observed: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """valid_from and valid_to of successive observations; the last one of a key is open."""
    order = Window.partitionBy(*key).orderBy(*at)
    return observed.withColumn("valid_from", F.col(at[0])).withColumn("valid_to", F.lead(at[0]).over(order))


def close_and_insert(store: DataFrame, changed: DataFrame, key: list[str], values: list[str], now: Column) -> DataFrame:
    """``store`` with the current versions of changed keys closed and their new versions added.

    ``changed`` has the key and the new values; other columns are carried over. Keys that have no
    current version are left out here (see ``insert_new``), as are rows that change nothing.
    """
    fresh = changed.select(*key, F.struct(*values).alias("_new"))
    joined = store.join(fresh, key, "left")
    differs = F.col("valid_to").isNull() & F.col("_new").isNotNull() & ~F.struct(*values).eqNullSafe(F.col("_new"))
    marked = joined.withColumn("_rows", F.when(differs, F.array(F.lit("old"), F.lit("new"))).otherwise(F.array(F.lit("same"))))
    spread = marked.withColumn("_row", F.explode("_rows"))
    columns = []
    for c in store.columns:
        if c in values:
            columns.append(F.when(F.col("_row") == "new", F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c))
        elif c == "valid_from":
            columns.append(F.when(F.col("_row") == "new", now).otherwise(F.col(c)).alias(c))
        elif c == "valid_to":
            columns.append(F.when(F.col("_row") == "old", now).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return spread.select(*columns)


def insert_new(store: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``store`` and those rows whose key it doesn't have."""
    return store.unionByName(rows.join(store.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def confirm(store: DataFrame, seen: DataFrame, key: list[str], provenance: list[str]) -> DataFrame:
    """Provenance of current versions with a confirmed key is renewed in place."""
    marks = seen.select(*key, F.struct(*provenance).alias("_seen"))
    joined = store.join(marks, key, "left")
    now = F.col("valid_to").isNull() & F.col("_seen").isNotNull()
    return joined.select(*[F.when(now, F.col(f"_seen.{c}")).otherwise(F.col(c)).alias(c) if c in provenance else F.col(c) for c in store.columns])


def fill_nulls(store: DataFrame, given: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Only null fields take the given values."""
    values = given.select(*key, F.struct(*fields).alias("_given"))
    return store.join(values, key, "left").select(*[F.coalesce(F.col(c), F.col(f"_given.{c}")).alias(c) if c in fields else F.col(c) for c in store.columns])


def upsert_latest(rows: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """The last row of each key by ``at`` (a total order)."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_last"))
    return last.select(*key, "_last.*")


def recent(rows: DataFrame, owner: list[str], reference: list[str], at: list[str], limit: int = 50) -> DataFrame:
    """A bounded history: each reference once, by its last view, the newest ``limit`` of each owner."""
    last = upsert_latest(rows, [*owner, *reference], at)
    order = Window.partitionBy(*owner).orderBy(*[F.desc(c) for c in at])
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def forward_filled(rows: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(window))


def crawl_actions(live: DataFrame, stored: DataFrame, previous: DataFrame, key: list[str], fields: list[str], changed: Column, is_suspicious: Column,
                  valid: Column, complete: Column, structured: bool = False, adopt: bool = False) -> DataFrame:
    """live rows with their stored and previous values and one action each.

    unmatched (or adopt, if allowed, complete and valid), partial, invalid, agreed, suspicious, update. A first
    pass of a structured source that may adopt applies suspicious changes too.
    """
    now = live.select(*key, F.struct(*fields).alias("now"))
    joined = now.join(stored.select(*key, F.struct(*fields).alias("was")), key, "left")
    first_pass = F.lit(structured and adopt)
    if structured and adopt:
        seen = previous.agg((F.count("*") == 0).alias("_first"))
        joined = joined.crossJoin(F.broadcast(seen))  # one row
        first_pass = F.col("_first")
    gone = F.col("was").isNull()
    action = (F.when(gone & F.lit(adopt) & complete & valid, "adopt").when(gone, "unmatched").when(~complete, "partial").when(~valid, "invalid")
              .when(F.size(changed) == 0, "agreed").when(is_suspicious & ~first_pass, "suspicious").otherwise("update"))
    return joined.withColumn("changes", F.when(gone, None).otherwise(changed)).withColumn("action", action)
