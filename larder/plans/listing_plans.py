"""Queries of the listing readers: what stores, snapshots, product lists and pages tell is written from the
catalog's rows, and the SQL says which items must be read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query
from larder.plans.search_plans import _SLUG, _WORDS
from larder.sources import listings

_FORM = "array_to_string({0}, ' ')".format(_WORDS.format("name"))


def _json(columns: dict[str, str]):
    return F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in columns.items()]))


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a content store, and a menu tree a chain of two levels whose live items are those not off the menu."""
    rows = items(spark, sf_dir)
    record = _json({"_id": "cast(item_id AS string)", "name": "CASE WHEN item_id % 23 = 0 THEN concat('Test ', name) ELSE concat(' ', upper(name), '  ') END", "dummy": "item_id % 19 = 0", "L2": "upper(category)",
                    "region": "CASE WHEN item_id % 17 = 0 THEN 'CA' WHEN item_id % 2 = 0 THEN 'US' END", "image": "concat('image-', lower(hex(item_id)), '-10x20-', CASE WHEN item_id % 3 = 0 THEN 'PNG' ELSE 'png' END)",
                    "nutrition": "named_struct('calories', kcal, 'fat', cast(fat AS string), 'sodium', sodium)", "allergens": "named_struct('wheat', item_id % 2 = 0, 'milk', item_id % 3, 'dust', true)"})
    docs = rows.select("chain", F.lit("shop.example").alias("domain"), F.lit("p").alias("project"), F.lit("d").alias("dataset"), F.col("item_id").alias("pos"), record.alias("record"))
    part = F.to_json(F.struct(F.lit("section").alias("_type"), F.array(F.struct(F.lit("picker").alias("t"), F.array(F.struct(F.lit("item").alias("t"), F.col("item_id").cast("string").alias("id"))).alias("opts"))).alias("opts")))
    menus = rows.where("NOT off_menu").select("chain", F.concat(F.lit('{"sections":['), part, F.lit("]}")).alias("tree"))
    return docs, menus


@query(f"""WITH {SQL_ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY chain, {_FORM} ORDER BY item_id) AS rn FROM items WHERE NOT off_menu AND item_id % 23 <> 0 AND item_id % 19 <> 0 AND item_id % 17 <> 0)
SELECT chain, {_SLUG.format('name')} AS ext_key, upper(name) AS name, category, kcal, fat, sodium,
       CASE WHEN item_id % 3 <> 0 THEN concat('https://cdn.sanity.io/images/p/d/', lower(printf('%X', item_id)), '-10x20.png?w=1000&h=1000&fit=max&fm=webp&q=85') END AS image_url,
       concat_ws(',', CASE WHEN item_id % 3 <> 0 THEN 'milk' END, CASE WHEN item_id % 2 = 0 THEN 'wheat' END) AS allergens FROM k WHERE rn = 1""")
def content_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live items of content stores, one a name."""
    docs, menus = store(spark, sf_dir)
    found = listings.content_items(docs, listings.live_ids(menus))
    return found.select("chain", "ext_key", "name", "category", "kcal", "fat", "sodium", "image_url", F.array_join("allergens", ",").alias("allergens"))


TITLES = (("Buns", "Burgers"), ("Drinks", "Beverages"), ("Sides", "Appetizers & Sides"))


@query(f"""WITH {SQL_ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY chain, {_SLUG.format('name')} ORDER BY item_id) AS rn FROM items WHERE item_id % 7 <> 0)
SELECT chain, {_SLUG.format('name')} AS ext_key, CASE WHEN item_id % 2 = 0 THEN 'Burgers' WHEN item_id % 3 = 0 THEN 'Beverages' WHEN item_id % 5 = 0 THEN 'Appetizers & Sides' WHEN category <> 'Specials' THEN category END AS category,
       CASE WHEN item_id % 4 > 0 THEN concat(CAST(item_id % 4 AS VARCHAR), ' g') END AS serving, concat('https://img.example/', CAST(item_id AS VARCHAR), '%20%281%29.png?wid=1000&fmt=png-alpha') AS image_url,
       CASE WHEN item_id % 2 = 0 THEN 'fish,eggs' ELSE 'eggs,fish' END AS allergens, kcal, fiber FROM k WHERE rn = 1""")
def snapshot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with sections by priority; showcases tell no category."""
    rows = items(spark, sf_dir)
    record = _json({"id": "cast(item_id AS string)", "n": "name", "kcal": "CASE WHEN item_id % 7 <> 0 THEN kcal END", "g": "item_id % 4", "cat": "category", "img": "concat('https://img.example/', item_id, ' (1).png')", "fiber": "fiber",
                    "alg": "CASE WHEN item_id % 2 = 0 THEN array(' Fish (Pollock)', 'egg', 'dust', 'fish') ELSE array('EGGS', 'Egg', 'fish') END"})
    records = rows.select("chain", F.lit("s").alias("source"), F.lit("u").alias("source_url"), F.col("item_id").alias("pos"), record.alias("record"))
    titles = F.array_compact(F.array(F.lit("Deals"), F.expr("CASE WHEN item_id % 5 = 0 THEN 'Sides' END"), F.expr("CASE WHEN item_id % 3 = 0 THEN 'Drinks' END"), F.expr("CASE WHEN item_id % 2 = 0 THEN 'Buns' END")))
    sections = rows.select("chain", F.explode(titles).alias("title"), F.col("item_id").cast("string").alias("id"))
    found = listings.snapshot_items(records, sections, TITLES, ["Specials"])
    return found.select("chain", "ext_key", "category", "serving", "image_url", F.array_join("allergens", ",").alias("allergens"), "kcal", "fiber")


@query(f"""WITH {SQL_ITEMS}, p AS (SELECT *, concat('lab/', CAST(item_id // 2 AS VARCHAR)) AS seo, item_id // 40 AS page FROM items), a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY chain, page, seo ORDER BY item_id) = 1)
SELECT concat(chain, '/', CAST(page AS VARCHAR)) AS chain, {_SLUG.format('name')} AS ext_key, category, concat('https://www.shop.example/menu/', CAST(item_id // 2 AS VARCHAR)) AS source_url,
       CASE WHEN item_id % 3 = 0 THEN 'hero' ELSE 'small' END AS image_url, kcal FROM a QUALIFY row_number() OVER (PARTITION BY chain, page, {_SLUG.format('name')} ORDER BY item_id) = 1""")
def product_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products out of pages that push forty items' objects in two chunks."""
    rows = items(spark, sf_dir).withColumn("page", F.expr("item_id div 40"))
    record = _json({"seoUrl": "concat('lab/', item_id div 2)", "name": "name", "category": "named_struct('name', category)", "nutrition": "named_struct('calories', kcal)",
                    "images": "array(named_struct('type', 'thumbnail', 'url', 'small'), named_struct('type', CASE WHEN item_id % 3 = 0 THEN 'hero' ELSE 'other' END, 'url', 'hero'))"})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", record.alias("record")))), lambda x: x["record"]), ",")
    pages = rows.groupBy(F.concat("chain", F.lit("/"), "page").alias("chain")).agg(text.alias("text"))
    chunk = lambda c: F.concat(F.lit("<script>self.__next_f.push([1,"), F.substring(F.to_json(F.array(c)), 2, 1 << 30), F.lit(")</script>"))
    html = F.concat(chunk(F.concat(F.lit("1:["), F.substring("text", 1, 101))), chunk(F.concat(F.substring("text", 102, 1 << 30), F.lit("]"))))
    found = listings.product_items(pages.select("chain", F.lit("shop.example").alias("domain"), html.alias("html")))
    return found.select("chain", "ext_key", "category", "source_url", "image_url", "kcal")


@query(f"""WITH {SQL_ITEMS} SELECT chain, {_SLUG.format('name')} AS ext_key, name, concat('u', lpad(CAST(item_id AS VARCHAR), 12, '0')) AS source_url, kcal, fat FROM items WHERE item_id % 6 <> 0
QUALIFY row_number() OVER (PARTITION BY chain, {_SLUG.format('name')} ORDER BY item_id) = 1""")
def keyed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of pages that carry keys and values; a page without calories is none."""
    facts = F.expr("to_json(array(named_struct('key', CASE WHEN item_id % 6 <> 0 THEN 'calories' ELSE 'energy' END, 'value', concat(cast(cast(kcal AS bigint) AS string), ' kcal')), named_struct('key', 'fat', 'value', cast(fat AS string))))")
    html = F.concat(F.lit('<meta property="og:title" content="'), "name", F.lit(' | Shop &amp; Co"><script>{"nutrition":'), facts, F.lit("}</script>"))
    pages = items(spark, sf_dir).select("chain", F.lit("s").alias("source"), F.concat(F.lit("u"), F.lpad(F.col("item_id").cast("string"), 12, "0")).alias("source_url"), html.alias("html"))
    return listings.keyed_items(pages).select("chain", "ext_key", "name", "source_url", "kcal", "fat")
