"""Queries of catalog upkeep: merges, gates, counters and what screens choose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.io import table
from larder.operators import upkeep as u
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query


@query(f"WITH {SQL_ITEMS} SELECT chain, category, serving, min(item_id) AS item_id FROM items GROUP BY chain, category, serving")
def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.first_copies(items(spark, sf_dir), ["chain", "category", "serving"], "item_id")


@query(f"""WITH {SQL_ITEMS}, a AS (SELECT chain, category, count(*) AS n FROM items WHERE item_id % 3 = 0 AND category IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT chain, category FROM items WHERE item_id % 7 = 1) SELECT a.*, k.chain IS NOT NULL AS in_catalog FROM a LEFT JOIN k USING (chain, category) WHERE n > 1 OR k.chain IS NOT NULL""")
def adopted_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", "chain", "category")
    return u.clashes(rows.where("item_id % 3 = 0"), rows.where("item_id % 7 = 1"), ["chain", "category"])


# Names of every second chain are told apart by their numbers, as a guide's reader does, and don't clash.
_KEY = "CASE WHEN ascii(right(chain, 1)) % 2 = 0 THEN concat(name, ' ', CAST(item_id AS {0})) ELSE name END"
_ADOPTED = f"""a AS (SELECT chain, {_KEY.format('VARCHAR')} AS ext_key, count(*) AS n FROM items WHERE item_id % 3 = 0 GROUP BY ALL), k AS (SELECT DISTINCT chain, {_KEY.format('VARCHAR')} AS ext_key FROM items WHERE item_id % 5 = 1 AND (item_id % 3 > 0 OR ascii(right(chain, 1)) % 2 = 1)),
c AS (SELECT a.*, k.chain IS NOT NULL AS known FROM a LEFT JOIN k USING (chain, ext_key)),
h AS (SELECT chain, count(*) FILTER (WHERE n > 1) AS t, count(*) FILTER (WHERE known) AS u, array_to_string(list_sort(list(ext_key) FILTER (WHERE n > 1))[:6], ', ') AS twins, array_to_string(list_sort(list(ext_key) FILTER (WHERE known))[:6], ', ') AS old, sum(n) AS n FROM c GROUP BY chain)"""


@query(f"""WITH {SQL_ITEMS}, {_ADOPTED}, r AS (SELECT chain, count(*) AS found, count(*) FILTER (WHERE fresh) AS changed, count(*) FILTER (WHERE off_menu) AS dropped FROM items GROUP BY chain)
SELECT r.*, CASE WHEN coalesce(t + u, 0) > 0 THEN 0 ELSE coalesce(CAST(n AS BIGINT), 0) END AS adopted, CASE WHEN coalesce(t + u, 0) > 0 THEN 'held' ELSE 'ok' END AS status,
concat_ws('; ', CASE WHEN t > 0 THEN concat('each other: ', twins) END, CASE WHEN u > 0 THEN concat('catalog: ', old) END) AS notes FROM r LEFT JOIN h USING (chain)""")
def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row a chain; chains whose new names clash are held."""
    rows = items(spark, sf_dir)
    crawls = rows.groupBy("chain").agg(F.count("*").alias("found"), F.count_if("fresh").alias("changed"), F.count_if("off_menu").alias("dropped"))
    keyed = rows.select("item_id", "chain", F.expr(_KEY.format("STRING")).alias("ext_key"))
    return u.crawl_log(crawls, keyed.where("item_id % 3 = 0"), keyed.where("item_id % 5 = 1 AND (item_id % 3 > 0 OR ascii(right(chain, 1)) % 2 = 1)"))[0]


@query("""WITH r AS (SELECT o_custkey, o_totalprice > 100000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, bool_or(ok) FILTER (WHERE n = 1) AS ok, coalesce(bool_or(ok) FILTER (WHERE n = 2) AND NOT bool_or(ok) FILTER (WHERE n = 1), false) AS regressed FROM r WHERE n <= 2 GROUP BY o_custkey""")
def readiness_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 100000).alias("ok"))
    return u.regressions(runs, "o_custkey", "o_orderkey", "ok")


@query("SELECT c_custkey, coalesce(max(o_orderkey % 9), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 9).alias("version"))
    return u.next_versions(table(spark, sf_dir, "customer").select("c_custkey"), versions, "c_custkey", "version")


_PATCH = "concat('{{\"kcal\":', CAST(CAST({0} AS BIGINT) AS {1}), '}}')"


@query(f"""WITH {SQL_ITEMS} SELECT item_id, CASE WHEN item_id % 6 = 0 THEN {_PATCH.format('kcal + 5', 'VARCHAR')} ELSE {_PATCH.format('kcal', 'VARCHAR')} END AS patch,
CASE WHEN item_id % 6 = 0 THEN 'audit' ELSE 'typed' END AS reason FROM items WHERE item_id % 4 = 0 OR item_id % 6 = 0""")
def override_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    def patches(rows, kcal, reason):
        return rows.select("item_id", F.expr(_PATCH.format(kcal, "STRING")).alias("patch"), F.lit(reason).alias("reason"))

    rows = items(spark, sf_dir)
    changes = patches(rows.where("item_id % 6 = 0"), "kcal + 5", "audit")
    return u.upsert(patches(rows.where("item_id % 4 = 0"), "kcal", "typed"), changes, ["item_id"], "reason")


@query(f"""WITH {SQL_ITEMS} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN concat('feed/', CAST(item_id % 50 + 1 AS VARCHAR)) ELSE concat('old/', CAST(item_id AS VARCHAR)) END AS url,
CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS seen FROM items WHERE has_photo OR item_id % 2 = 0""")
def photo_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    kept = rows.where("has_photo").selectExpr("item_id", "concat('old/', CAST(item_id AS STRING)) AS url", "0 AS seen")
    feed = rows.where("item_id % 2 = 0").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seen"))
    feed = feed.selectExpr("item_id", "concat('feed/', CAST(item_id % 50 + seen - 1 AS STRING)) AS url", "seen")
    return u.upsert(kept, feed, ["item_id"], "seen")


@query(f"WITH {SQL_ITEMS} SELECT item_id, name, CASE WHEN item_id % 10 = 0 THEN NULL WHEN item_id % 5 = 0 THEN 'Specials' ELSE category END AS category FROM items")
def materialized_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", "name", "category")
    changes = rows.where("item_id % 5 = 0").selectExpr("item_id", "CASE WHEN item_id % 10 <> 0 THEN 'Specials' END AS category")
    return u.update_from(rows, changes, ["item_id"])


@query(f"""WITH {SQL_ITEMS} SELECT chain, concat('{{"items":', CAST(count(*) AS VARCHAR), ',"photos":', CAST(count(*) FILTER (WHERE has_photo) AS VARCHAR), ',"fresh":', CAST(count(*) FILTER (WHERE fresh) AS VARCHAR), '}}') AS snapshot FROM items GROUP BY chain""")
def readiness_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON value a chain, so that no row holds all chains."""
    counts = items(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("items"), F.count_if("has_photo").alias("photos"), F.count_if("fresh").alias("fresh"))
    return counts.select("chain", F.to_json(F.struct("items", "photos", "fresh")).alias("snapshot"))


@query(f"""WITH {SQL_ITEMS} SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'new' WHEN item_id % 10 = 0 THEN 'conflict' ELSE 'same' END AS outcome FROM items""")
def release_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    released = rows.where("item_id % 3 <> 0").select("item_id", F.sha2("name", 256).alias("digest"))
    offered = rows.select("item_id", F.sha2(F.expr("CASE WHEN item_id % 10 = 0 THEN concat(name, '!') ELSE name END"), 256).alias("digest"))
    return u.release_outcomes(released, offered, ["item_id"], "digest")


@query("SELECT c_custkey, count(o_orderkey) AS item_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def refreshed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return u.with_child_counts(table(spark, sf_dir, "customer").select("c_custkey"), children, "c_custkey", "item_count")


@query(f"""WITH {SQL_ITEMS} SELECT 'some' AS asked, chain, count(*) AS n FROM items WHERE chain IN ('Brand#11', 'Brand#23') GROUP BY chain UNION ALL SELECT 'all', chain, count(*) FROM items GROUP BY chain""")
def chain_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(asked, values):
        return items(spark, sf_dir).where(u.wanted("chain", values)).groupBy("chain").agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), "chain", "n")

    return counted("some", ["Brand#11", "Brand#23"]).unionByName(counted("all", None))


def _share(grams: str, factor: int) -> str:
    total = "(protein * 4 + carbs * 4 + fat * 9)"
    return f"CASE WHEN {total} > 0 THEN {grams} * {factor} / {total} ELSE 0.0 END"


@query(f"WITH {SQL_ITEMS} SELECT item_id, {_share('protein', 4)} AS protein_share, {_share('carbs', 4)} AS carbs_share, {_share('fat', 9)} AS fat_share FROM items")
def macro_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, f = F.col("protein"), F.col("carbs"), F.col("fat")
    shares = [u.macro_share(g, k, p, c, f).alias(f"{n}_share") for g, k, n in ((p, 4, "protein"), (c, 4, "carbs"), (f, 9, "fat"))]
    return items(spark, sf_dir).select("item_id", *shares)


@query(f"""WITH {SQL_ITEMS} SELECT l.item_id, r.item_id AS other_id, CASE WHEN l.item_id % 4 > 0 THEN r.protein >= 30 AND r.kcal <= 600 END AS fits, NOT l.fresh OR NOT r.fresh AS stale
FROM items l JOIN items r ON r.chain = l.chain AND r.kcal = l.kcal AND r.item_id <> l.item_id""")
def compared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of equal energy beside each item, itself left out; no fit where it has no goals."""
    rows = items(spark, sf_dir).select("chain", "kcal", "item_id", "protein", "fresh")
    other = rows.select("chain", "kcal", F.col("item_id").alias("other_id"), "protein", F.col("fresh").alias("other_fresh"))
    fits = F.when(F.col("item_id") % 4 > 0, (F.col("protein") >= 30) & (F.col("kcal") <= 600))
    pairs = rows.drop("protein").join(other, ["chain", "kcal"]).where("item_id <> other_id")
    return pairs.select("item_id", "other_id", fits.alias("fits"), (~F.col("fresh") | ~F.col("other_fresh")).alias("stale"))


@query(f"""WITH {SQL_ITEMS}, p AS (SELECT item_id, chain, category, CASE WHEN has_photo THEN concat(CAST(item_id AS VARCHAR), '.jpg') END AS photo FROM items),
f AS (SELECT chain, category, arg_min(photo, item_id) AS first FROM p WHERE photo IS NOT NULL GROUP BY ALL) SELECT item_id, chain, category, coalesce(photo, first) AS photo FROM p LEFT JOIN f USING (chain, category)""")
def variant_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).selectExpr("item_id", "chain", "category", "CASE WHEN has_photo THEN concat(CAST(item_id AS STRING), '.jpg') END AS photo")
    return u.variant_photo(rows, ["chain", "category"], "item_id", "photo")


@query(f"WITH {SQL_ITEMS} SELECT item_id, name, kcal FROM items WHERE chain IN (SELECT chain FROM items WHERE item_id % 500 = 7) AND protein >= 30 AND kcal <= 600 ORDER BY item_id LIMIT 30")
def nearby_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 30 items that meet the goals, of chains that have a venue near by: a top-k report."""
    rows = items(spark, sf_dir)
    near = rows.where("item_id % 500 = 7").select("chain")
    return rows.join(near, "chain", "left_semi").where("protein >= 30 and kcal <= 600").select("item_id", "name", "kcal").orderBy("item_id").limit(30)


@query(f"WITH {SQL_ITEMS} SELECT chain, item_id, name, serving FROM items WHERE chain = 'Brand#11' AND item_id BETWEEN 1 AND 400")
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("chain = 'Brand#11' and item_id between 1 and 400").select("chain", "item_id", "name", "serving")


@query("""SELECT n_name, item_count FROM nation JOIN (SELECT c_nationkey, count(*) AS item_count FROM customer WHERE c_custkey % 4 > 0 GROUP BY c_nationkey) ON c_nationkey = n_nationkey ORDER BY item_count DESC, n_name LIMIT 10""")
def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest chains of the queue: a top-k report."""
    queued = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").groupBy("c_nationkey").agg(F.count("*").alias("item_count"))
    chains = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return chains.join(queued, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "item_count").orderBy(F.desc("item_count"), "n_name").limit(10)


@query(f"WITH {SQL_ITEMS}, s AS (SELECT chain, category, min(item_id) AS seen_at FROM items WHERE category IS NOT NULL GROUP BY ALL) SELECT chain, category, row_number() OVER (PARTITION BY chain ORDER BY category <> 'Toppings & Ingredients', seen_at, category) AS place FROM s")
def section_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.section_order(items(spark, sf_dir), "chain", "category", "item_id", "Toppings & Ingredients")


@query(f"WITH {SQL_ITEMS} SELECT item_id, unnest(range(len(string_split(name, ' ')))) AS place, unnest(string_split(name, ' ')) AS entry FROM items")
def saved_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.posexplode(F.split("name", " ")).alias("place", "entry"))


@query("""SELECT c_nationkey, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5""")
def first_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return u.first_of_each(rows, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 5).drop("c_acctbal")


@query(f"WITH {SQL_ITEMS} SELECT item_id, CASE WHEN item_id % 3 = 0 THEN kcal + 1 ELSE kcal END AS kcal FROM items WHERE item_id % 2 = 0 OR item_id % 3 = 0")
def seen_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", "kcal")
    return u.overlay(rows.where("item_id % 2 = 0"), rows.where("item_id % 3 = 0").withColumn("kcal", F.col("kcal") + 1), ["item_id"])


@query("""SELECT asked, count(*) AS answers, count(*) FILTER (WHERE asked = matched) AS verified, count(DISTINCT o_custkey) FILTER (WHERE asked = matched) AS venues,
count(*) FILTER (WHERE asked = matched) - count(DISTINCT o_custkey) FILTER (WHERE asked = matched) AS repeats FROM (SELECT o_custkey % 5 AS asked, o_orderkey % 5 AS matched, o_custkey FROM orders) GROUP BY asked""")
def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "orders").selectExpr("o_custkey % 5 AS asked", "o_orderkey % 5 AS matched", "o_custkey")
    return u.answer_outcomes(answers, "asked", "matched", "o_custkey")


@query(f"WITH {SQL_ITEMS} SELECT item_id, list_has_all(string_split(lower(name), ' '), string_split(lower(category), ' ')) AS covered FROM items")
def covered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.split(F.lower(F.col(c)), " ")
    return items(spark, sf_dir).select("item_id", u.covers(words("name"), words("category")).alias("covered"))


@query(f"""WITH {SQL_ITEMS} SELECT chain, count(*) FILTER (WHERE has_photo) AS photos, count(*) FILTER (WHERE fresh) AS fresh, bool_and(fresh OR NOT off_menu) AS ok FROM items GROUP BY chain ORDER BY NOT ok, photos DESC, fresh DESC, chain""")
def readiness_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = items(spark, sf_dir).groupBy("chain").agg(F.count_if("has_photo").alias("photos"), F.count_if("fresh").alias("fresh"), F.bool_and(F.expr("fresh or not off_menu")).alias("ok"))
    return counts.orderBy(~F.col("ok"), F.desc("photos"), F.desc("fresh"), "chain")
