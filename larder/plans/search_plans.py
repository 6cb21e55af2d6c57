"""Queries of search and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.io import table
from larder.operators import search
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query

_FORM = "trim(regexp_replace(lower(strip_accents(replace(replace({0}, '''', ''), '’', ''))), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"


def _level(token: str, text: str) -> str:
    return f"CASE WHEN starts_with({text}, '{token}') THEN 3 WHEN contains({text}, ' {token}') THEN 2 WHEN contains({text}, '{token}') THEN 1 ELSE 0 END"


def _search_sql(tokens: list[str], chain: str | None) -> str:
    names = [f"({_level(x, 'f')})" for x in tokens]
    chains = [f"({_level(x, 'c')})" if chain is None else "0" for x in tokens]
    score = " + ".join(f"2 * {n} + {c}" for n, c in zip(names, chains))
    hits = " AND ".join(f"({n} > 0 OR {c} > 0)" for n, c in zip(names, chains))
    scope = f"WHERE chain = '{chain}'" if chain else ""
    return (f"WITH {SQL_ITEMS}, formed AS (SELECT *, {_FORM.format('name')} AS f, {_FORM.format('chain')} AS c FROM items {scope}) "
            f"SELECT item_id, name, CAST({score} AS INTEGER) AS score FROM formed WHERE {hits} ORDER BY coalesce(off_menu, false), score DESC, strlen(f), item_id LIMIT 50")


@query(_search_sql(["red", "ch"], None))
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(items(spark, sf_dir), "Réd, ch").select("item_id", "name", "score")


@query(_search_sql(["small", "taco"], "Brand#7"))
def ranked_search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(items(spark, sf_dir), "small taco", chain="Brand#7").select("item_id", "name", "score")


@query(f"WITH {SQL_ITEMS} SELECT item_id, {_level('ch', _FORM.format('name'))} AS ch, {_level('red', _FORM.format('name'))} AS red, {_level('ring', _FORM.format('name'))} AS ring FROM items")
def match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = t.search_form(F.col("name"))
    return items(spark, sf_dir).select("item_id", *[t.match_level(F.lit(x), form).alias(x) for x in ("ch", "red", "ring")])


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"WITH {SQL_ITEMS} SELECT item_id, {_SLUG.format('name')} AS ext_key, {_SLUG.format('chain')} AS chain_slug FROM items")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", t.slug(F.col("name")).alias("ext_key"), t.slug(F.col("chain")).alias("chain_slug"))


@query(f"SELECT doc_id, md5({_FORM.format('text')}) AS form_md5 FROM documents")
def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.search_form(F.col("text"))).alias("form_md5"))


_WORDS = ("list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower({0}), '''s\\b', 's', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' '), "
          "lambda w: CASE WHEN w IN ('kid', 'childs', 'child') THEN 'kids' ELSE w END), lambda w: w <> '' AND w NOT IN ('ct', 'count', 'pc', 'pcs', 'piece', 'pieces'))")
_PORTION = "(regexp_full_match(w, '[0-9]+') OR w IN ('small', 'medium', 'large', 'kids', 'jr', 'giant', 'mini', 'short', 'tall', 'grande', 'venti', 'trenta'))"


@query(f"""WITH {SQL_ITEMS} SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({_WORDS.format('name')}, lambda w: {_PORTION}))), ' ') AS portion,
       array_to_string(list_sort(list_filter({_WORDS.format('name')}, lambda w: NOT {_PORTION})), ' ') AS comparable FROM items""")
def comparable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.array_join(t.portion(F.col("name")), " ").alias("portion"), t.comparable(F.col("name")).alias("comparable"))


@query()
def shortened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.posexplode(t.shortenings(F.col("name"))).alias("rank", "dish"))


@query(f"""WITH {SQL_ITEMS}, raw AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN concat(CAST(item_id AS VARCHAR), '.25') WHEN 1 THEN 'NA' WHEN 2 THEN concat('<', CAST(item_id % 9 AS VARCHAR), 'mg') WHEN 3 THEN concat('1,', CAST(100 + item_id % 800 AS VARCHAR), 'mg') ELSE ' 7.5 ' END AS cell FROM items)
SELECT item_id, round(CASE WHEN regexp_full_match(trim(cell), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') THEN CAST(trim(cell) AS DOUBLE) END, 1) AS seed_number,
       TRY_CAST(regexp_extract(replace(cell, ',', ''), '<?\\s*([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS label_number,
       CASE WHEN NOT contains(cell, '<') THEN TRY_CAST(regexp_extract(replace(cell, ',', ''), '<?\\s*([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) END AS guide_number FROM raw""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr("CASE item_id % 5 WHEN 0 THEN concat(CAST(item_id AS STRING), '.25') WHEN 1 THEN 'NA' WHEN 2 THEN concat('<', CAST(item_id % 9 AS STRING), 'mg') "
                  "WHEN 3 THEN concat('1,', CAST(100 + item_id % 800 AS STRING), 'mg') ELSE ' 7.5 ' END")
    raw = items(spark, sf_dir).select("item_id", cell.alias("cell"))
    return raw.select("item_id", t.seed_number(F.col("cell")).alias("seed_number"), t.bounded_number(F.col("cell")).alias("label_number"), t.guide_number(F.col("cell")).alias("guide_number"))


@query(f"""WITH {SQL_ITEMS}, u AS (SELECT *, TRY_CAST(regexp_extract(serving, '^\\s*([0-9]+(\\.[0-9]+)?)\\s*[A-Za-z]', 1) AS DOUBLE) AS amount,
       lower(regexp_extract(serving, '^\\s*[0-9.]+\\s*([A-Za-z]+(\\s+oz)?)\\s*$', 1)) AS unit FROM items),
w AS (SELECT *, amount * CASE unit WHEN 'g' THEN 1.0 WHEN 'ml' THEN 1.0 WHEN 'oz' THEN CAST(28.35 AS DOUBLE) WHEN 'fl oz' THEN CAST(29.57 AS DOUBLE) WHEN 'lb' THEN CAST(453.6 AS DOUBLE) WHEN 'kg' THEN 1000.0 WHEN 'l' THEN 1000.0 END AS grams FROM u)
SELECT item_id, round(CAST(grams AS DOUBLE), 2) AS grams, round(CAST(sugar / grams * 100 AS DOUBLE), 2) AS sugar_per_100g FROM w""")
def serving_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = t.serving_grams(F.col("serving"))
    return items(spark, sf_dir).select("item_id", F.round(grams, 2).alias("grams"), F.round(F.col("sugar") / grams * 100, 2).alias("sugar_per_100g"))


@query(f"""WITH {SQL_ITEMS} SELECT item_id, concat(CAST(CAST(round(kcal) AS BIGINT) AS VARCHAR), ' kcal') AS kcal_text, concat(CAST(CAST(round(protein) AS BIGINT) AS VARCHAR), ' g') AS protein_text,
       CASE WHEN sodium IS NOT NULL THEN concat(CAST(CAST(round(sodium) AS BIGINT) AS VARCHAR), ' mg') END AS sodium_text,
       CASE WHEN item_id % 6 BETWEEN 1 AND 4 THEN repeat('$', CAST(item_id % 6 AS BIGINT)) END AS price_band,
       concat(substr(chain, 1, 1), '') AS monogram FROM items""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.round(F.col(c)).cast("bigint").cast("string")
    return items(spark, sf_dir).select(
        "item_id", F.concat(whole("kcal"), F.lit(" kcal")).alias("kcal_text"), F.concat(whole("protein"), F.lit(" g")).alias("protein_text"),
        F.concat(whole("sodium"), F.lit(" mg")).alias("sodium_text"), t.price_band((F.col("item_id") % 6).cast("int")).alias("price_band"), t.monogram(F.col("chain")).alias("monogram"))
