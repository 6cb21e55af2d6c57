"""Queries of versions, upserts and bounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.io import table
from larder.operators import catalog, history
from larder.operators import quality as q
from larder.plans.registry import query

_VERSIONS = ("v AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return history.versions(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"WITH {_VERSIONS} SELECT * FROM v")
def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)


@query(f"WITH {_VERSIONS} SELECT o_custkey, o_orderkey FROM v WHERE valid_to IS NULL")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.current(_store(spark, sf_dir)).select("o_custkey", "o_orderkey")


@query(f"""WITH {_VERSIONS}, n AS (SELECT c_custkey AS o_custkey, CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'O' END AS o_orderstatus, '2-HIGH' AS o_orderpriority FROM customer WHERE c_custkey % 3 = 0),
j AS (SELECT v.*, n.o_orderstatus AS ns, n.o_orderpriority AS np, v.valid_to IS NULL AND n.o_custkey IS NOT NULL AND (v.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR v.o_orderpriority IS DISTINCT FROM n.o_orderpriority) AS d FROM v LEFT JOIN n USING (o_custkey))
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, valid_from, CASE WHEN d THEN TIMESTAMP '2002-01-01' ELSE valid_to END AS valid_to FROM j
UNION ALL SELECT o_custkey, o_orderkey, ns, np, TIMESTAMP '2002-01-01', NULL FROM j WHERE d""")
def scd2_apply_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"), F.lit("2-HIGH").alias("o_orderpriority"))
    return history.close_and_insert(_store(spark, sf_dir), given, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], F.expr("timestamp_ntz'2002-01-01'"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders) SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name FROM customer c WHERE c_custkey % 5 = 0 AND NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey % 2 = 0 AND x.c_custkey = c.c_custkey)""")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return history.insert_new(customer.where("c_custkey % 2 = 0"), customer.where("c_custkey % 5 = 0"), ["c_custkey"])


@query(f"""WITH {_VERSIONS} SELECT o_custkey, o_orderkey, CASE WHEN valid_to IS NULL AND o_custkey % 4 = 0 THEN 'confirmed' ELSE o_orderpriority END AS o_orderpriority FROM v""")
def confirm_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("confirmed").alias("o_orderpriority"))
    return history.confirm(_store(spark, sf_dir), seen, ["o_custkey"], ["o_orderpriority"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT d.doc_id, coalesce(l.quality, CAST(d.doc_id % 2 AS INTEGER)) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_null_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    store = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return history.fill_nulls(store, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")), ["doc_id"], ["quality", "toxic"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return history.upsert_latest(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH l AS (SELECT user_id, event_id % 97 AS item, max((ts, event_id)) AS last FROM events GROUP BY user_id, event_id % 97),
r AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rank FROM l) SELECT user_id, item, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""")
def recent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 97).alias("item"), "ts", "event_id")
    return history.recent(views, ["user_id"], ["item"], ["ts", "event_id"]).select("user_id", "item", "rank")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup FROM events")
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("signup", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return history.forward_filled(events, ["user_id"], ["ts", "event_id"], "signup", "last_signup").select("event_id", "last_signup")


@query("""WITH live AS (SELECT c_custkey AS k, CAST(floor(c_acctbal / 10) AS DOUBLE) AS kcal, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS fat FROM customer WHERE c_custkey % 5 <> 0),
stored AS (SELECT c_custkey AS k, CAST(floor(c_acctbal / 10) AS DOUBLE) + (c_custkey % 4) * 60 AS kcal, CAST(c_custkey % 50 AS DOUBLE) AS fat FROM customer WHERE c_custkey % 7 <> 0)
SELECT l.k, CASE WHEN s.k IS NULL THEN 'unmatched' WHEN l.fat IS NULL THEN 'partial' WHEN l.kcal < 0 THEN 'invalid' WHEN abs(l.kcal - s.kcal) <= 5 THEN 'agreed'
  WHEN s.kcal > 0 AND abs(l.kcal - s.kcal) / s.kcal > 0.3 AND abs(l.kcal - s.kcal) > 50 THEN 'suspicious' ELSE 'update' END AS action FROM live l LEFT JOIN stored s USING (k)""")
def crawl_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kcal, fat = F.col("c_custkey"), F.floor(F.col("c_acctbal") / 10).cast("double"), (F.col("c_custkey") % 50).cast("double")
    customer = table(spark, sf_dir, "customer")
    live = customer.where("c_custkey % 5 <> 0").select(k.alias("k"), kcal.alias("kcal"), F.when(k % 9 != 0, fat).alias("fat"))
    stored = customer.where("c_custkey % 7 <> 0").select(k.alias("k"), (kcal + (k % 4) * 60).alias("kcal"), fat.alias("fat"))
    changed = q.changes(["kcal", "fat"])
    return history.crawl_actions(live, stored, stored, ["k"], ["kcal", "fat"], changed, q.suspicious(changed), F.col("now.kcal") >= 0,
                                 F.col("now.kcal").isNotNull() & F.col("now.fat").isNotNull()).select("k", "action")
