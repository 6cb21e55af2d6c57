"""Queries of variants, classes, sections, shelves, places and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import geo
from larder.io import table
from larder.operators import classify, menu, variants
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query

_TAIL = "CASE WHEN regexp_matches(name, '^(.*),([^,]*)$') THEN trim(regexp_extract(name, '^(.*),([^,]*)$', {0})) END"
_LEARNED = (f"tails AS (SELECT chain, lower({_TAIL.format(1)}) AS base, lower({_TAIL.format(2)}) AS label FROM items), "
            "learned AS (SELECT chain, label FROM tails WHERE base <> '' AND label <> '' AND len(string_split_regex(label, '\\s+')) <= 2 "
            "AND NOT regexp_matches(label, '&|\\bw/|\\bwith\\b|\\bfor\\b') GROUP BY chain, label HAVING count(DISTINCT base) >= 3)")


@query(f"WITH {SQL_ITEMS}, {_LEARNED} SELECT chain, label FROM learned")
def learned_size_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.learn_size_words(items(spark, sf_dir))


_SIZES = ", ".join("'" + k.replace("'", "''") + "'" for k in variants.SIZE_ORDER)
_PLACE = "CASE lower(label) " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN {v}" for k, v in variants.SIZE_ORDER.items()) + " END"
_KEY = "regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches({0}, '(?i)(^| )\\S{{3,}}s$') THEN regexp_replace({0}, '(?i)s$', '') ELSE {0} END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_COUNTED = "(?i)^(\\d+(\\.\\d+)?)\\s*(oz|lb|pc|pcs|piece|pieces|ct|count)?\\s+(\\S.*)$"
_GROUPS = f"""{_LEARNED},
p AS (SELECT i.chain, item_id, name, {_TAIL.format(1)} AS tb, {_TAIL.format(2)} AS tl, l.label IS NOT NULL AS known, string_split_regex(name, '(?i)\\s+w(/|ith)\\s+') AS ws
      FROM items i LEFT JOIN learned l ON l.chain = i.chain AND l.label = lower({_TAIL.format(2)})),
v AS (SELECT *, CASE WHEN tb <> '' AND tl <> '' AND (lower(tl) IN ({_SIZES}) OR known OR regexp_matches(tl, '(?i)^\\d+(\\.\\d+)?\\s*(fl\\s*)?oz$') OR regexp_matches(tl, '(?i)^\\d*\\s*slices?$')
        OR regexp_matches(tl, '(?i)^\\d+(\\.\\d+)?\\s*("|''''|in|inch|liter|l|ml|g|oz|lb|pc|ct)?\\.?$')) THEN 1 WHEN regexp_matches(name, '{_COUNTED}') THEN 2 WHEN len(ws) >= 2 AND trim(ws[1]) <> '' THEN 3 END AS rule FROM p),
w AS (SELECT chain, item_id, name, CASE rule WHEN 1 THEN tb WHEN 2 THEN trim(regexp_extract(name, '{_COUNTED}', 4)) ELSE trim(ws[1]) END AS base,
        CASE rule WHEN 1 THEN tl WHEN 2 THEN CASE WHEN regexp_extract(name, '{_COUNTED}', 3) <> '' THEN concat_ws(' ', regexp_extract(name, '{_COUNTED}', 1), regexp_extract(name, '{_COUNTED}', 3)) ELSE regexp_extract(name, '{_COUNTED}', 1) END ELSE trim(ws[2]) END AS label,
        CASE WHEN rule <= 2 THEN 'size' ELSE 'option' END AS kind, 0 AS later FROM v WHERE rule IS NOT NULL),
own AS (SELECT chain, item_id, base, label, kind, later, {_KEY.format('base')} AS grp FROM w),
pl AS (SELECT chain, item_id, name AS base, 'Plain' AS label, 'option' AS kind, 1 AS later, {_KEY.format('name')} AS grp FROM items),
m AS (SELECT * FROM own UNION ALL SELECT * FROM pl WHERE (chain, grp) IN (SELECT (chain, grp) FROM own WHERE kind = 'option')),
r AS (SELECT *, count(*) OVER b AS n, CASE WHEN bool_or(kind = 'size') OVER b THEN 'size' ELSE 'option' END AS gk, first_value(base) OVER (PARTITION BY chain, grp ORDER BY later DESC, item_id DESC) AS gb,
        CAST(row_number() OVER (PARTITION BY chain, grp ORDER BY CASE WHEN {_PLACE} IS NOT NULL THEN 0 WHEN regexp_matches(label, '^\\d') THEN 1 ELSE 2 END,
          CASE WHEN {_PLACE} IS NOT NULL THEN {_PLACE} WHEN regexp_matches(label, '^\\d') THEN CAST(regexp_extract(label, '^(\\d+(\\.\\d+)?)', 1) AS DOUBLE) WHEN label = 'Plain' THEN -1.0 ELSE 0.0 END, label, later, item_id) - 1 AS INTEGER) AS position
      FROM m WINDOW b AS (PARTITION BY chain, grp)),
g AS (SELECT chain, item_id, grp, label, position, gk AS kind, gb AS base FROM (SELECT *, row_number() OVER (PARTITION BY chain, item_id ORDER BY later DESC, position DESC) AS rn FROM r WHERE n > 1) WHERE rn = 1)"""


@query(f"WITH {SQL_ITEMS}, {_GROUPS} SELECT chain, item_id, grp AS \"group\", label, position, kind, base FROM g")
def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.assign_groups(items(spark, sf_dir))


_ROWS = f"""{_GROUPS}, rows AS (SELECT i.*, g.grp, g.position FROM items i LEFT JOIN g USING (chain, item_id)),
ph AS (SELECT *, bool_or(has_photo) OVER (PARTITION BY chain, grp) AS anyp FROM rows WHERE grp IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY chain, grp ORDER BY position, item_id) AS rn, count(*) OVER (PARTITION BY chain, grp) AS n FROM ph WHERE has_photo OR NOT anyp),
rep AS (SELECT * FROM c WHERE rn - 1 = (n - 1) // 2)"""


def _with_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    groups = variants.assign_groups(rows).select("chain", "item_id", "group", "position")
    return rows.join(groups, ["chain", "item_id"], "left")


@query(f"WITH {SQL_ITEMS}, {_ROWS} SELECT chain, grp AS \"group\", item_id FROM rep")
def variant_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_groups(spark, sf_dir).where(F.col("group").isNotNull())
    return variants.representatives(rows, ["chain", "group"], "position").select("chain", "group", "item_id")


@query(f"""WITH {SQL_ITEMS.replace('FROM part)', 'FROM part)')}, {_GROUPS}, rows AS (SELECT i.*, g.grp, g.position FROM items i LEFT JOIN g USING (chain, item_id) WHERE kcal <= 400),
ph AS (SELECT *, bool_or(has_photo) OVER (PARTITION BY chain, grp) AS anyp FROM rows WHERE grp IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY chain, grp ORDER BY position, item_id) AS rn, count(*) OVER (PARTITION BY chain, grp) AS n FROM ph WHERE has_photo OR NOT anyp)
SELECT item_id FROM rows WHERE grp IS NULL UNION ALL SELECT item_id FROM c WHERE rn - 1 = (n - 1) // 2""")
def collapsed_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The goal filter comes before the collapse, so that it sees every size."""
    return variants.collapse(menu.goal_filter(_with_groups(spark, sf_dir), most_kcal=400), ["chain", "group"], "position").select("item_id")


@query(f"""WITH {SQL_ITEMS}, {_GROUPS}, e AS (SELECT g.chain, g.grp, CAST(CAST(round(min(kcal)) AS BIGINT) AS VARCHAR) AS a, CAST(CAST(round(max(kcal)) AS BIGINT) AS VARCHAR) AS b FROM g JOIN items USING (item_id) GROUP BY g.chain, g.grp)
SELECT chain, grp AS "group", CASE WHEN a = b THEN concat(a, ' kcal') ELSE concat(a, '–', b, ' kcal') END AS range FROM e""")
def calorie_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_groups(spark, sf_dir).where(F.col("group").isNotNull())
    return rows.groupBy("chain", "group").agg(variants.range_text(F.min("kcal"), F.max("kcal"), "kcal").alias("range"))


def _sql_rules(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in rules) + " END"


_RULES = [(n, p.replace(r"\bmilk\b(?! ?shake)", r"\bmilk\b")) for n, p in classify.ARCHETYPES]  # no name here has milk before shake
_BY_CATEGORY = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.BY_CATEGORY.items()) + f" ELSE '{classify.DEFAULT}' END"


@query(f"WITH {SQL_ITEMS} SELECT item_id, coalesce({_sql_rules('lower(name)', _RULES)}, {_BY_CATEGORY}) AS archetype FROM items")
def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", classify.archetype(F.col("name"), F.col("category")).alias("archetype"))


@query()
def own_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", classify.needs_own_photo(F.col("name")).alias("needs_own_photo"))


_BREAKFAST_IF = (f"category IN ({', '.join(repr(c) for c in classify.BREAKFAST_FROM)}) AND NOT regexp_matches(name, '{classify.NO_BREAKFAST}') AND (regexp_matches(name, '{classify.BREAKFAST_NAMES}') "
                 f"OR (regexp_matches(name, '{classify.BREAKFAST_CARRIERS}') AND regexp_matches(name, '{classify.FILLINGS}')) OR (regexp_matches(name, '{classify.OTHER_CARRIERS}') AND regexp_matches(name, '{classify.EGGS}')))")


@query(f"WITH {SQL_ITEMS} SELECT item_id, CASE WHEN coalesce({_BREAKFAST_IF}, false) THEN 'Breakfast' ELSE category END AS section FROM items")
def taxonomy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", classify.section(F.col("name"), F.col("category")).alias("section"))


_PLACES = "CASE sec " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(classify.SECTIONS)) + f" ELSE {len(classify.SECTIONS)} END"


@query(f"""WITH {SQL_ITEMS}, s AS (SELECT *, CASE WHEN off_menu THEN 'Archive' ELSE coalesce(category, 'Other') END AS sec FROM items)
SELECT item_id, sec AS section, CAST(dense_rank() OVER (PARTITION BY chain ORDER BY off_menu, {_PLACES}, sec) AS INTEGER) AS section_rank FROM s""")
def menu_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menu.sections(items(spark, sf_dir)).select("item_id", "section", "section_rank")


@query(f"WITH {SQL_ITEMS} SELECT item_id, kcal, protein FROM items WHERE kcal <= 500 AND protein >= 20")
def goal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menu.goal_filter(items(spark, sf_dir), 500, 20).select("item_id", "kcal", "protein")


@query(f"WITH {SQL_ITEMS} SELECT item_id, kcal, name FROM items WHERE NOT off_menu ORDER BY kcal, name, item_id LIMIT 40")
def fewest_calories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menu.on_menu(items(spark, sf_dir)).orderBy(*menu.fewest_calories()).limit(40).select("item_id", "kcal", "name")


@query(f"WITH {SQL_ITEMS} SELECT item_id, protein, name FROM items WHERE NOT off_menu ORDER BY protein DESC, name DESC, item_id DESC LIMIT 40")
def most_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menu.on_menu(items(spark, sf_dir)).orderBy(*menu.most_protein()).limit(40).select("item_id", "protein", "name")


_GRAMS = "(CAST(regexp_extract(serving, '^([0-9]+)', 1) AS DOUBLE) * CASE WHEN regexp_matches(serving, ' oz$') THEN CAST(28.35 AS DOUBLE) ELSE 1.0 END)"


@query(f"""WITH {SQL_ITEMS}, live AS (SELECT *, CASE WHEN regexp_matches(serving, '^[0-9]+ (oz|g)$') THEN sugar / {_GRAMS} * 100 END AS per, regexp_matches(lower(name), '(^|[^a-z0-9])(cola|coke|pepsi|sprite|soda|fanta)([^a-z0-9]|$)') AS soda FROM items WHERE NOT off_menu),
a AS (SELECT chain, 'High Protein' AS shelf, row_number() OVER (PARTITION BY chain ORDER BY protein DESC, name, item_id) AS rank, item_id FROM live
  UNION ALL SELECT chain, 'Less Sugar', row_number() OVER (PARTITION BY chain ORDER BY per, name, item_id), item_id FROM live WHERE per < 6
  UNION ALL SELECT chain, 'Less Calories', row_number() OVER (PARTITION BY chain ORDER BY soda, kcal, name, item_id), item_id FROM live)
SELECT chain, shelf, CAST(rank AS INTEGER) AS rank, item_id FROM a WHERE rank <= 12""")
def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menu.shelves(items(spark, sf_dir))


@query(f"""WITH {SQL_ITEMS}, a AS (SELECT * FROM items WHERE item_id = 7), b AS (SELECT * FROM items WHERE item_id = 12)
SELECT * FROM (SELECT 'kcal' AS field, a.kcal AS left_value, b.kcal AS right_value, nullif(b.kcal - a.kcal, 0) AS difference FROM a, b UNION ALL SELECT 'protein', a.protein, b.protein, nullif(b.protein - a.protein, 0) FROM a, b
UNION ALL SELECT 'carbs', a.carbs, b.carbs, nullif(b.carbs - a.carbs, 0) FROM a, b UNION ALL SELECT 'fat', a.fat, b.fat, nullif(b.fat - a.fat, 0) FROM a, b)""")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return menu.comparison(rows.where("item_id = 7"), rows.where("item_id = 12"), ["kcal", "protein", "carbs", "fat"])


_LINES = "SELECT l_orderkey, l_partkey, CAST(l_quantity AS INTEGER) - 2 AS quantity, l_returnflag = 'R' AS stale FROM lineitem"


@query(f"""WITH {SQL_ITEMS}, l AS ({_LINES}) SELECT l_orderkey, CAST(sum(least(quantity, 20)) AS BIGINT) AS item_count, sum(kcal * least(quantity, 20)) AS kcal, sum(protein * least(quantity, 20)) AS protein, bool_or(stale) AS stale
FROM l JOIN items ON item_id = l_partkey WHERE quantity >= 1 GROUP BY l_orderkey""")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), (F.col("l_quantity").cast("int") - 2).alias("quantity"), (F.col("l_returnflag") == "R").alias("stale"))
    joined = lines.join(items(spark, sf_dir).select("item_id", "kcal", "protein"), "item_id")
    return menu.order_totals(joined, ["l_orderkey"], ["kcal", "protein"])


@query(f"""WITH {SQL_ITEMS} SELECT l_orderkey, count(i.item_id) AS found, count(*) - count(i.item_id) AS missing FROM lineitem LEFT JOIN (SELECT * FROM items WHERE NOT off_menu) i ON i.item_id = l_partkey GROUP BY l_orderkey""")
def saved_order_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = menu.on_menu(items(spark, sf_dir)).select(F.col("item_id").alias("l_partkey"), F.lit(True).alias("hit"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(live, "l_partkey", "left")
    return lines.groupBy("l_orderkey").agg(F.count("hit").alias("found"), (F.count("*") - F.count("hit")).alias("missing"))


_LAT, _LNG = "(51.4 + (c_custkey * 37 % 2000) / CAST(10000 AS DOUBLE))", "(-0.2 + (c_custkey * 91 % 3000) / CAST(10000 AS DOUBLE))"
_FAR = "6371000.0 * 2 * asin(sqrt(pow(sin(radians(lat - 51.5) / 2), 2) + cos(radians(51.5)) * cos(radians(lat)) * pow(sin(radians(lng - -0.05) / 2), 2)))"


def _venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = (F.expr(e) for e in (_LAT, _LNG))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("venue_id"), "c_mktsegment", lat.alias("lat"), lng.alias("lng"))


@query(f"WITH v AS (SELECT c_custkey AS venue_id, {_LAT} AS lat, {_LNG} AS lng FROM customer), d AS (SELECT venue_id, {_FAR} AS m FROM v) SELECT venue_id, round(m, 3) AS meters FROM d WHERE m <= 5000 ORDER BY m, venue_id LIMIT 25")
def venues_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.within(_venues(spark, sf_dir), 51.5, -0.05, 5000, 25).select("venue_id", F.round("distance", 3).alias("meters"))


@query(f"""WITH v AS (SELECT c_custkey AS venue_id, c_mktsegment, {_LAT} AS lat, {_LNG} AS lng FROM customer), d AS (SELECT *, round({_FAR}, 3) AS m FROM v)
SELECT c_mktsegment, arg_min(venue_id, (m, venue_id)) AS venue_id, min(m) AS meters, count(*) AS venues FROM d GROUP BY c_mktsegment""")
def nearest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.round(geo.haversine(F.lit(51.5), F.lit(-0.05), F.col("lat"), F.col("lng")), 3)
    return geo.nearest_per_group(_venues(spark, sf_dir).withColumn("distance", far), "c_mktsegment").withColumnRenamed("distance", "meters")


@query(f"""WITH {SQL_ITEMS}, c(chain) AS (VALUES ('small'), ('small ring'), ('red'), ('red bolt Apple'), ('blue')),
h AS (SELECT item_id AS place_id, chain, row_number() OVER (PARTITION BY item_id ORDER BY length(c.chain) DESC) AS rn FROM (SELECT item_id, name FROM items) JOIN c ON name = c.chain OR starts_with(name, concat(c.chain, ' ')))
SELECT place_id, chain FROM h WHERE rn = 1""")
def longest_prefix_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = spark.createDataFrame([(c,) for c in ("small", "small ring", "red", "red bolt Apple", "blue")], "chain string")
    return geo.longest_prefix(items(spark, sf_dir).select(F.col("item_id").alias("place_id"), F.col("name").alias("place")), chains)
