"""Queries of consistency rules, changes and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.io import table
from larder.operators import quality as q
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query


def _sql_broken(field: str) -> str:
    if field in q.LABEL_CEILINGS:
        return f"({field} < 0 OR {field} > {q.LABEL_CEILINGS[field]})"
    whole = dict(q.FRACTIONS)[field]
    return f"(({whole} IS NOT NULL AND {field} < 0) OR {field} > {whole} + 1.0)"


_EXPECTED = "(protein * 4.0 + carbs * 4.0 + fat * 9.0)"
_DRIFT = f"(({_EXPECTED} - kcal) / kcal)"
_SWEET = "(" + " OR ".join(f"contains(lower(concat_ws(' ', name, category)), '{h}')" for h in q.SUGAR_ALCOHOL_HINTS) + ")"
_CHECKED = f"(kcal >= 50 AND {_EXPECTED} > 0 AND NOT ({_SWEET} AND {_DRIFT} <= 0.6))"
_PROBLEMS = " UNION ALL ".join(
    [f"SELECT chain, item_id, name, 'range' AS kind, '{f}' AS field, 'error' AS severity FROM items WHERE {f} < 0 OR {f} > {top}" for f, top in q.CEILINGS.items()]
    + [f"SELECT chain, item_id, name, 'label', '{f}', 'warning' FROM items WHERE {_sql_broken(f)}" for f in (*dict(q.FRACTIONS), *q.LABEL_CEILINGS)]
    + ["SELECT chain, item_id, name, 'portion', 'kcal', 'warning' FROM items WHERE kcal > 2000",
       f"SELECT chain, item_id, name, 'atwater', 'kcal', 'error' FROM items WHERE {_CHECKED} AND {_DRIFT} > 0.25",
       f"SELECT chain, item_id, name, 'atwater', 'kcal', CASE WHEN -{_DRIFT} > 0.75 THEN 'error' ELSE 'warning' END FROM items WHERE {_CHECKED} AND NOT {_DRIFT} > 0.25 AND -{_DRIFT} > 0.3"])
_FOUND = f"WITH {SQL_ITEMS}, problems AS ({_PROBLEMS})"


@query(f"{_FOUND} SELECT * FROM problems")
def quality_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.check_items(items(spark, sf_dir))


@query(f"{_FOUND} SELECT severity, kind, count(*) AS n FROM problems GROUP BY severity, kind")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.check_items(items(spark, sf_dir)).groupBy("severity", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_ITEMS} SELECT item_id, " + ", ".join(f"CASE WHEN NOT coalesce({_sql_broken(f)}, false) THEN {f} END AS {f}" for f in (*dict(q.FRACTIONS), *q.LABEL_CEILINGS)) + " FROM items")
def stripped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.strip_broken_labels(items(spark, sf_dir)).select("item_id", *dict(q.FRACTIONS), *q.LABEL_CEILINGS)


@query(f"{_FOUND} SELECT i.chain, i.name, i.item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM problems p WHERE p.severity = 'error' AND p.chain = i.chain AND p.name = i.name)")
def releasable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.releasable(items(spark, sf_dir)).select("chain", "name", "item_id")


@query(f"WITH {SQL_ITEMS} SELECT item_id, CASE WHEN kcal BETWEEN 0 AND 5000 THEN kcal END AS kcal, CASE WHEN sodium BETWEEN 0 AND 30000 THEN sodium END AS sodium FROM items")
def plausible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", q.plausible("kcal").alias("kcal"), q.plausible("sodium").alias("sodium"))


_SEEN = ("seen AS (SELECT o_custkey AS k, o_orderkey AS seen_at, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS kcal, CAST(o_orderkey % 40 AS DOUBLE) AS fat, CAST(floor(o_totalprice / 100) AS DOUBLE) AS sodium FROM orders), "
         "pairs AS (SELECT k, seen_at, kcal, fat, sodium, lag(kcal) OVER w AS kcal0, lag(fat) OVER w AS fat0, lag(sodium) OVER w AS sodium0, lag(seen_at) OVER w AS at0 FROM seen WINDOW w AS (PARTITION BY k ORDER BY seen_at))")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's consecutive orders stand for consecutive observations of one item."""
    seen = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seen_at"), F.struct(
            F.floor(F.col("o_totalprice") / 1000).cast("double").alias("kcal"), (F.col("o_orderkey") % 40).cast("double").alias("fat"),
            F.floor(F.col("o_totalprice") / 100).cast("double").alias("sodium")).alias("now"))
    return seen.withColumn("was", F.lag("now").over(Window.partitionBy("k").orderBy("seen_at"))).where("was is not null")


@query(f"""WITH {_SEEN} SELECT k, seen_at, CAST(CAST(abs(kcal - kcal0) > 5 AS INT) + CAST(abs(fat - fat0) > 1 AS INT) + CAST(abs(sodium - sodium0) > greatest(1.0, 0.02 * abs(sodium0)) AS INT) AS INTEGER) AS n_changes,
       concat_ws(', ', CASE WHEN abs(fat - fat0) > 1 THEN concat('fat: ', CAST(CAST(fat0 AS BIGINT) AS VARCHAR), '→', CAST(CAST(fat AS BIGINT) AS VARCHAR)) END,
         CASE WHEN abs(kcal - kcal0) > 5 THEN concat('kcal: ', CAST(CAST(kcal0 AS BIGINT) AS VARCHAR), '→', CAST(CAST(kcal AS BIGINT) AS VARCHAR)) END,
         CASE WHEN abs(sodium - sodium0) > greatest(1.0, 0.02 * abs(sodium0)) THEN concat('sodium: ', CAST(CAST(sodium0 AS BIGINT) AS VARCHAR), '→', CAST(CAST(sodium AS BIGINT) AS VARCHAR)) END) AS summary
       FROM pairs WHERE at0 IS NOT NULL""")
def noise_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).withColumn("changes", q.changes(["kcal", "fat", "sodium"]))
    return rows.select("k", "seen_at", F.size("changes").alias("n_changes"), q.change_summary(F.col("changes")).alias("summary"))


def _sql_large(field: str, noise: str, floor: str) -> str:
    gap = f"abs({field} - {field}0)"
    return f"({gap} > {noise} AND {field}0 > 0 AND {gap} / {field}0 > 0.3 AND {gap} > {floor})"


@query(f"WITH {_SEEN} SELECT k, seen_at, {_sql_large('kcal', '5', '50')} OR {_sql_large('fat', '1', '5')} OR {_sql_large('sodium', 'greatest(1.0, 0.02 * abs(sodium0))', '100')} AS suspicious FROM pairs WHERE at0 IS NOT NULL")
def suspicious_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).withColumn("changes", q.changes(["kcal", "fat", "sodium"]))
    return rows.select("k", "seen_at", q.suspicious(F.col("changes")).alias("suspicious"))


_HALVES = ("a AS (SELECT user_id, count(*) AS n, max(event_type) AS last_type FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id), "
           "b AS (SELECT user_id, count(*) AS n, max(event_type) AS last_type FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    summed = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_type").alias("last_type"))
    return summed(events.where("ts < timestamp_ntz'2024-01-16'")), summed(events.where("ts >= timestamp_ntz'2024-01-16'"))


@query(f"""WITH {_HALVES}, c AS (SELECT count(*) AS before, count(*) FILTER (WHERE b.user_id IS NULL) AS dropped,
       count(*) FILTER (WHERE b.user_id IS NOT NULL AND (a.n IS DISTINCT FROM b.n OR a.last_type IS DISTINCT FROM b.last_type)) AS changed FROM a LEFT JOIN b USING (user_id))
SELECT *, coalesce((dropped > before * 0.2 OR changed > before * 0.3) AND before > 0, false) AS held FROM c""")
def diff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _halves(spark, sf_dir)
    return q.diff_gate(before, now, "user_id", ["n", "last_type"])


@query(f"""WITH {_HALVES} SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'dropped' WHEN a.n = b.n AND a.last_type = b.last_type THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (user_id)""")
def diff_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _halves(spark, sf_dir)
    both = before.select("user_id", F.struct("n", "last_type").alias("was")).join(now.select("user_id", F.struct("n", "last_type").alias("now")), "user_id", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "dropped").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return both.select("user_id", state.alias("state"))


@query(f"""WITH {SQL_ITEMS}, cur AS (SELECT * FROM items WHERE item_id % 40 <> 3),
c AS (SELECT 'rows' AS field, (SELECT count(*) FROM items) AS before, (SELECT count(*) FROM cur) AS now
      UNION ALL SELECT 'sugar', (SELECT count(sugar) FROM items), (SELECT count(CASE WHEN item_id % 4 <> 0 THEN sugar END) FROM cur)
      UNION ALL SELECT 'category', (SELECT count(category) FROM items), (SELECT count(category) FROM cur))
SELECT *, now < before * 0.95 AS lost FROM c""")
def loss_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = items(spark, sf_dir)
    now = before.where("item_id % 40 <> 3").withColumn("sugar", F.when(F.col("item_id") % 4 != 0, F.col("sugar")))
    return q.loss_guard(before, now, ["sugar", "category"])


@query(f"""WITH {SQL_ITEMS}, m AS (SELECT chain, round(median(abs({_EXPECTED} - kcal) / kcal), 6) AS median_drift, median(sodium) AS median_sodium FROM items WHERE kcal >= 50 GROUP BY chain)
SELECT *, median_drift <= 0.1 AND median_sodium >= 50 AS passes FROM m""")
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.drift_gate(items(spark, sf_dir), "chain")
