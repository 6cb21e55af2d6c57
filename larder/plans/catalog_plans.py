"""Queries of the export view, joins, states and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.io import table
from larder.operators import catalog as c
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query


@query("""SELECT d.doc_id, d.lang, n_chars, l.quality, CASE WHEN l.toxic = 1 THEN true END AS toxic, s.s_name, n.n_name, r.r_name
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN supplier s ON s.s_suppkey = d.doc_id % 50 JOIN nation n ON n.n_nationkey = d.doc_id % 25 JOIN region r ON r.r_regionkey = n.n_regionkey""")
def export_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
            .join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("doc_id") % 50, "left")
            .join(nation, F.col("n_nationkey") == F.col("doc_id") % 25)
            .select("doc_id", "lang", "n_chars", "quality", F.when(F.col("toxic") == 1, True).alias("toxic"), "s_name", "n_name", "r_name"))


_PATCH = "CASE event_id % 4 WHEN 0 THEN '{\"value\": \"0\"}' WHEN 1 THEN '{\"event_type\": null}' WHEN 2 THEN '{\"event_type\": \"patched\", \"value\": \"1\"}' END"


@query(f"""WITH p AS (SELECT *, {_PATCH} AS patch, event_id % 4 AS m FROM events),
v AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CASE m WHEN 1 THEN NULL WHEN 2 THEN 'patched' ELSE event_type END AS event_type, CASE m WHEN 0 THEN '0' WHEN 2 THEN '1' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value FROM p)
SELECT event_id, concat('{{"user_id":"', user_id, '"', CASE WHEN event_type IS NOT NULL THEN concat(',"event_type":"', event_type, '"') ELSE '' END, ',"value":"', value, '"}}') AS document FROM v""")
def json_patch_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("patch", F.expr(_PATCH))
    base = {"user_id": F.col("user_id"), "event_type": F.col("event_type"), "value": F.floor("value").cast("bigint")}
    return events.select("event_id", c.patched(base, F.col("patch")).alias("document"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent FROM customer")
def existence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("has_urgent"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def scalar_subquery_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders"))


@query("""WITH last AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-01' GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'paused' WHEN last IS NULL THEN 'never' WHEN last + to_days(CAST(90 + c_custkey % 60 AS INTEGER)) < TIMESTAMP '2001-06-01' THEN 'due' ELSE 'fresh' END AS state FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def work_queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.expr("timestamp_ntz'2001-06-01'")
    last = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < as_of).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    state = c.queue_state(F.col("c_acctbal") < 0, F.col("last"), (90 + F.col("c_custkey") % 60).cast("int"), as_of)
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", state.alias("state"))


@query("""WITH w(segment, weight) AS (VALUES ('BUILDING', 3), ('MACHINERY', 2), ('HOUSEHOLD', 1))
SELECT c_custkey, c_mktsegment, weight, coalesce(weight, 0) IS DISTINCT FROM 2 AS other FROM customer LEFT JOIN w ON segment = c_mktsegment""")
def values_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.broadcast(spark.createDataFrame([("BUILDING", 3), ("MACHINERY", 2), ("HOUSEHOLD", 1)], "c_mktsegment string, weight int"))
    return table(spark, sf_dir, "customer").join(weights, "c_mktsegment", "left").select(
        "c_custkey", "c_mktsegment", "weight", (~F.coalesce("weight", F.lit(0)).eqNullSafe(F.lit(2))).alias("other"))


@query(f"WITH {SQL_ITEMS} SELECT chain, name, item_id FROM items ORDER BY chain, name, item_id LIMIT 100 OFFSET 300")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.page(items(spark, sf_dir).select("chain", "name", "item_id"), ["chain", "name", "item_id"], 100, 3)


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS rn FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_custkey, o_orderpriority)) WHERE rn = 1")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mode_first_seen(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query(f"""WITH {SQL_ITEMS}, cards AS (SELECT chain, category AS card, count(*) AS n, bool_or(has_photo) AS photo, bool_and(fresh) AS fresh, bool_or(category <> 'Toppings & Ingredients') AS dish
  FROM items WHERE NOT off_menu AND category IS NOT NULL GROUP BY chain, category)
SELECT chain, count(*) AS cards, CAST(sum(n) AS BIGINT) AS items, round(coalesce(count(*) FILTER (WHERE photo AND dish) / nullif(count(*) FILTER (WHERE dish), 0), 1.0), 6) AS photo_share,
       round(count(*) FILTER (WHERE fresh) / count(*), 6) AS fresh_share, count(*) FILTER (WHERE fresh) / count(*) >= 0.9 AS ready FROM cards GROUP BY chain""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).where("category is not null").select("chain", F.col("category").alias("card"), "has_photo", "fresh", "off_menu", (F.col("category") != "Toppings & Ingredients").alias("wants_photo"))
    found = c.readiness(rows)
    return found.select("chain", "cards", "items", F.round("photo_share", 6).alias("photo_share"), F.round("fresh_share", 6).alias("fresh_share"), "ready")


@query(f"""WITH {SQL_ITEMS}, cards AS (SELECT chain, category AS card, count(*) FILTER (WHERE fresh OR item_id % 3 > 0) = count(*) AS fresh FROM items WHERE NOT off_menu GROUP BY chain, category)
SELECT item_id, chain FROM items WHERE chain IN (SELECT chain FROM cards GROUP BY chain HAVING count(*) FILTER (WHERE fresh) >= 0.9 * count(*))""")
def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the chains that pass the gate of a pack."""
    rows = items(spark, sf_dir).select("item_id", "chain", F.col("category").alias("card"), "has_photo", F.expr("fresh OR item_id % 3 > 0").alias("fresh"), "off_menu", F.lit(True).alias("wants_photo"))
    return c.ready_rows(rows).select("item_id", "chain")


@query(f"""WITH {SQL_ITEMS}, f AS (SELECT item_id, list_filter([CASE WHEN item_id % 2 = 0 THEN 'seasonal' END, CASE WHEN item_id % 3 = 0 THEN 'kids' END, CASE WHEN item_id % 5 = 0 THEN 'vegan' END], lambda x: x IS NOT NULL) AS flags FROM items)
SELECT item_id, array_to_string(list_filter(['kids', 'shareable', 'regional', 'seasonal'], lambda x: list_contains(flags, x)), ',') AS flags, array_to_string(list_filter(flags, lambda x: x NOT IN ('kids', 'shareable', 'regional', 'seasonal')), ',') AS unknown FROM f""")
def flag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    flags = F.array_compact(F.array(F.when(i % 2 == 0, "seasonal"), F.when(i % 3 == 0, "kids"), F.when(i % 5 == 0, "vegan")))
    return items(spark, sf_dir).select("item_id", F.array_join(c.ordered_flags(flags), ",").alias("flags"), F.array_join(c.unknown_flags(flags), ",").alias("unknown"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value < 5 GROUP BY event_type ORDER BY n DESC, event_type""")
def unmatched_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events").where("value < 5").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
            .orderBy(F.desc("n"), "event_type"))


@query("""WITH RECURSIVE edges AS (SELECT CONCAT('r', r_regionkey) AS p, CONCAT('n', n_nationkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT CONCAT('n', s_nationkey), CONCAT('s', s_suppkey) FROM supplier),
reach AS (SELECT k, 1 AS depth FROM edges WHERE p = 'r1' UNION ALL SELECT e.k, depth + 1 FROM reach JOIN edges e ON e.p = reach.k) SELECT k, CAST(depth AS INTEGER) AS depth FROM reach""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "region").createOrReplaceTempView("larder_region")
    table(spark, sf_dir, "nation").createOrReplaceTempView("larder_nation")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("larder_supplier")
    return spark.sql("""WITH RECURSIVE edges AS (
        SELECT concat('r', r_regionkey) AS p, concat('n', n_nationkey) AS k FROM larder_region JOIN larder_nation ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM larder_supplier),
        reach(k, depth) AS (SELECT k, 1 FROM edges WHERE p = 'r1' UNION ALL SELECT e.k, depth + 1 FROM reach JOIN edges e ON e.p = reach.k) SELECT k, depth FROM reach""")


@query(f"""WITH {SQL_ITEMS}, base AS (SELECT chain, category, count(*) AS n, min(item_id) AS first FROM items WHERE category IS NOT NULL GROUP BY chain, category),
m AS (SELECT chain, category AS usual FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY n DESC, first) AS rn FROM base) WHERE rn = 1)
SELECT item_id, CASE WHEN category IS DISTINCT FROM usual THEN category END AS own, coalesce(CASE WHEN category IS DISTINCT FROM usual THEN category END, usual) AS shown FROM items JOIN m USING (chain)""")
def provenance_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    usual = c.mode_first_seen(rows, ["chain"], "category", "item_id").select("chain", F.col("category").alias("usual"))
    own = c.with_pack_defaults(rows.join(usual, "chain"), "category", F.col("usual"))
    return own.select("item_id", F.col("category").alias("own"), F.coalesce("category", "usual").alias("shown"))


@query(f"""WITH {SQL_ITEMS} SELECT chain, count(*) AS item_count, sha256(string_agg(concat(name, '|', CAST(item_id AS VARCHAR), '|', CAST(CAST(kcal AS BIGINT) AS VARCHAR)), ';' ORDER BY name, item_id)) AS pack_sha256 FROM items GROUP BY chain""")
def pack_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-stable packs: each chain's items in a total order, and their digest."""
    row = F.concat_ws("|", "name", F.col("item_id").cast("string"), F.col("kcal").cast("bigint").cast("string"))
    grouped = items(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("item_count"), F.array_sort(F.collect_list(F.struct("name", "item_id", row.alias("row")))).alias("rows"))
    return grouped.select("chain", "item_count", F.sha2(F.array_join(F.transform("rows", lambda r: r["row"]), ";").cast("binary"), 256).alias("pack_sha256"))
