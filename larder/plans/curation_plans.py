"""Queries of curation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.io import table
from larder.operators import curation as c
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query

_S = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""WITH {SQL_ITEMS}, a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY chain, {_S.format('name')}) > 1 AND category IS NOT NULL THEN concat(name, ', ', category) ELSE name END AS n1 FROM items),
b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY chain, {_S.format('n1')}) > 1 AND serving IS NOT NULL THEN concat(n1, ' (', serving, ')') ELSE n1 END AS qualified FROM a)
SELECT item_id, qualified, row_number() OVER (PARTITION BY chain, {_S.format('qualified')} ORDER BY item_id) > 1 AS ambiguous FROM b""")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.qualified_names(items(spark, sf_dir)).select("item_id", "qualified", "ambiguous")


_KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN 'site' WHEN 'MACHINERY' THEN 'guide' WHEN 'HOUSEHOLD' THEN 'snapshot' ELSE 'api' END"


@query(f"""WITH k AS (SELECT c_custkey, {_KIND} AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'feed' END AS photos FROM customer)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN kind IN ('site', 'api', 'table', 'guide') THEN 'numbers' END, CASE WHEN kind IN ('site', 'api') THEN 'presence' END, CASE WHEN photos IS NOT NULL THEN 'photos' END], lambda x: x IS NOT NULL), '+') AS steps FROM k""")
def refresh_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = F.when(F.col("c_custkey") % 3 == 0, "feed")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(c.route(F.expr(_KIND), photos), "+").alias("steps"))


@query("""WITH r AS (SELECT c_mktsegment, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS rn FROM customer)
SELECT c_mktsegment, count(*) AS n, string_agg(c_name, ', ' ORDER BY c_name) FILTER (WHERE rn <= 6) AS names, greatest(count(*) - 6, 0) AS more FROM r GROUP BY c_mktsegment""")
def state_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.buckets(table(spark, sf_dir, "customer").select("c_mktsegment", "c_name"), "c_mktsegment", "c_name")


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS DOUBLE) AS a1, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS b1, CAST(lag(o_orderkey % 7) OVER w AS DOUBLE) AS a0, CAST(lag(floor(o_totalprice / 1000)) OVER w AS DOUBLE) AS b0
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, concat_ws(',', CASE WHEN a0 <> a1 THEN CASE WHEN a0 = 0 OR abs(a1 - a0) / a0 > 0.3 THEN 'a!' ELSE 'a' END END, CASE WHEN b0 <> b1 THEN CASE WHEN b0 = 0 OR abs(b1 - b0) / b0 > 0.3 THEN 'b!' ELSE 'b' END END) AS audit FROM p WHERE a0 IS NOT NULL""")
def audit_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.struct((F.col("o_orderkey") % 7).cast("double").alias("a"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", now.alias("now"))
    rows = rows.withColumn("was", F.lag("now").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("was is not null")
    told = F.transform(c.audit_fields(["a", "b"]), lambda x: F.concat(x["field"], F.when(x["large"], "!").otherwise("")))
    return rows.select("o_orderkey", F.array_join(told, ",").alias("audit"))


@query(f"""WITH {SQL_ITEMS}, t AS (SELECT DISTINCT name AS title FROM items WHERE NOT off_menu), l AS (SELECT item_id AS key, name AS title, concat(CAST(item_id % 10 AS VARCHAR), '.jpg') AS file FROM items),
n AS (SELECT item_id AS key, concat(CAST((item_id + (item_id % 4) // 3) % 10 AS VARCHAR), '.jpg') AS now FROM items) SELECT key, title, file, now FROM l JOIN t USING (title) JOIN n USING (key) WHERE file IS DISTINCT FROM now""")
def stale_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    file = lambda e: F.concat(F.expr(e).cast("string"), F.lit(".jpg"))
    links = rows.select(F.col("item_id").alias("key"), F.col("name").alias("title"), file("item_id % 10").alias("file"))
    titles = rows.where("not off_menu").select(F.col("name").alias("title"))
    chosen = rows.select(F.col("item_id").alias("key"), file("(item_id + (item_id % 4) div 3) % 10").alias("file"))
    return c.stale_links(links, titles, chosen).select("key", "title", "file", "now")


@query(f"""WITH {SQL_ITEMS} SELECT item_id, CASE WHEN greatest(item_id % 700, item_id * 3 % 900) = 0 THEN 'plain.jpg' WHEN item_id % 700 >= item_id * 3 % 900 THEN concat('a.jpg?w=', CAST(item_id % 700 AS VARCHAR)) ELSE concat('Z.jpg?w=', CAST(item_id * 3 % 900 AS VARCHAR)) END AS url FROM items""")
def largest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = F.array(F.concat(F.lit("a.jpg?w="), (F.col("item_id") % 700).cast("string")), F.lit("plain.jpg"), F.concat(F.lit("Z.jpg?w="), (F.col("item_id") * 3 % 900).cast("string")))
    return items(spark, sf_dir).select("item_id", c.largest_image(urls).alias("url"))


@query("""WITH w AS (SELECT p_partkey, p_name, string_split(concat(CASE WHEN p_partkey % 2 = 0 THEN 'the ' ELSE '' END, p_name), ' ') AS ws FROM part), b AS (SELECT *, CASE WHEN ws[1] = 'the' THEN ws[2:] ELSE ws END AS bare FROM w)
SELECT p_partkey, CASE WHEN ws[1] = 'the' THEN concat(array_to_string(ws, ''), '.com,', array_to_string(ws, '-'), '.com,', array_to_string(bare, ''), '.com,', array_to_string(bare, '-'), '.com,', bare[1], '.com')
  ELSE concat(array_to_string(ws, ''), '.com,', array_to_string(ws, '-'), '.com,', ws[1], '.com') END AS hosts FROM b""")
def domain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "The ").otherwise(""), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(c.domain_candidates(name), ",").alias("hosts"))


@query(f"""WITH {SQL_ITEMS}, l AS (SELECT chain AS guide, item_id * 2 + 1 AS line_no, concat(name, ' ', CAST(CAST(kcal AS BIGINT) AS VARCHAR), ' <', CAST(CAST(protein AS BIGINT) AS VARCHAR), ' 1,0', CAST(item_id % 90 + 10 AS VARCHAR)) AS line FROM items
  UNION ALL SELECT chain, item_id * 2, upper(category) FROM items WHERE item_id % 3 = 0 AND category IS NOT NULL),
f AS (SELECT *, last_value(CASE WHEN NOT regexp_matches(line, '[0-9]') THEN line END IGNORE NULLS) OVER (PARTITION BY guide ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
SELECT guide, line_no, section, regexp_extract(line, '^(.*\\S)((\\s+<?[0-9][0-9.,]*){{3}})\\s*$', 1) AS name, array_to_string(string_split_regex(trim(regexp_extract(line, '^(.*\\S)((\\s+<?[0-9][0-9.,]*){{3}})\\s*$', 2)), '\\s+'), '|') AS cells
FROM f WHERE regexp_matches(line, '^(.*\\S)((\\s+<?[0-9][0-9.,]*){{3}})\\s*$')""")
def guide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    whole = lambda x: F.col(x).cast("bigint").cast("string")
    body = rows.select(F.col("chain").alias("guide"), (F.col("item_id") * 2 + 1).alias("line_no"), F.concat("name", F.lit(" "), whole("kcal"), F.lit(" <"), whole("protein"), F.lit(" 1,0"), (F.col("item_id") % 90 + 10).cast("string")).alias("line"))
    heads = rows.where("item_id % 3 = 0 and category is not null").select(F.col("chain").alias("guide"), (F.col("item_id") * 2).alias("line_no"), F.upper("category").alias("line"))
    return c.guide_rows(body.unionByName(heads), 3).withColumn("cells", F.array_join("cells", "|"))


@query(f"""WITH {SQL_ITEMS}, s AS (SELECT chain, item_id, (CASE WHEN item_id % 3 = 0 THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(name), 'taco') THEN 1 ELSE 0 END) + (CASE WHEN item_id % 2000 >= 1000 THEN 1 ELSE 0 END)
  - (CASE WHEN contains(lower(name), 'box') OR contains(lower(name), 'cola') THEN 6 ELSE 0 END) AS score FROM items)
SELECT chain, CAST(max(score) AS INTEGER) AS score, arg_max(item_id, (score, -item_id)) AS item_id FROM s GROUP BY chain""")
def picture_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("taco"))).otherwise(F.array(F.lit("food")))
    score = c.picture_score(tags, F.col("name"), F.col("item_id") % 2000, F.lit("taco"), ["box", "cola"])
    rows = items(spark, sf_dir).withColumn("score", score)
    return rows.groupBy("chain").agg(F.max("score").alias("score"), F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("item_id"))


@query("""WITH l AS (SELECT event_id, ts, event_type, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(epoch_us(ts) - epoch_us(before) < 3600000000 AND kind = event_type, false) AS reusable FROM l""")
def answer_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(order)).withColumn("kind", F.lag("event_type").over(order))
    return rows.select("event_id", c.reusable(F.col("before"), F.col("ts"), F.col("kind") == F.col("event_type"), 3600).alias("reusable"))
