"""Queries over places, sites and texts of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import labels
from larder.io import table
from larder.operators import places
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query
from larder.sources import probe

_CHAINS = ("small", "small ring", "red", "red bolt", "blue", "green widget", "green")
_PLACES = "p_partkey AS place_id, p_name AS place, 40 + p_size / CAST(4 AS DOUBLE) AS lat, -100 + CAST(length(p_type) AS DOUBLE) / 8 AS lng, p_type AS address"
_SITE = "nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', ''), '')"
_NAMED = f"""p AS (SELECT {_PLACES}, split_part(p_name, ' ', 1) AS asked FROM part),
c(chain) AS (VALUES {", ".join(f"('{c}')" for c in _CHAINS)}),
n AS (SELECT * FROM p JOIN c ON place = chain OR starts_with(place, concat(chain, ' ')) QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY length(chain) DESC) = 1),
k AS (SELECT *, concat('map:', lat, ',', lng) AS venue_key FROM n)"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = table(spark, sf_dir, "part").selectExpr(*_PLACES.split(", "), "split_part(p_name, ' ', 1) AS asked")
    return found, spark.createDataFrame([(c,) for c in _CHAINS], "chain string")


@query(f"WITH {_NAMED} SELECT place_id, chain, venue_key, address FROM k")
def place_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.place_venues(*_places(spark, sf_dir)).select("place_id", "chain", "venue_key", "address")


@query(f"""WITH {_NAMED}, f AS (SELECT chain, venue_key, min(place_id) AS place_id, arg_min(address, place_id) AS address FROM k WHERE chain = asked GROUP BY chain, venue_key)
SELECT *, row_number() OVER (PARTITION BY chain ORDER BY address, venue_key) AS place_no FROM f""")
def verified_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of answers of the chain that was asked for, numbered by address."""
    own = places.verified_venues(*_places(spark, sf_dir), "asked").select("chain", "venue_key", "place_id", "address")
    return places.by_address(own)


@query(f"""WITH p AS (SELECT page_id, url, {_SITE} AS site, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS origin, list_distinct(list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda h: regexp_matches(h, 'tion|ment'))) AS hs FROM pages),
f AS (SELECT *, regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/(?:[^?#]*/)?)', 1) AS folder FROM p WHERE len(hs) > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1), e AS (SELECT *, unnest(hs) AS h FROM f)
SELECT site, page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN concat(origin, h) ELSE concat(origin, CASE folder WHEN '' THEN '/' ELSE folder END, h) END AS guide FROM e""")
def guide_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each site's first page that has any about the asked words; the pages hold no guides, so any ending is taken."""
    return probe.guide_links(table(spark, sf_dir, "pages"), "page_id", "", "tion|ment").drop("place")


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, coalesce(html, '') AS h FROM pages),
k AS (SELECT *, CASE WHEN trim(h) = '' THEN 'unknown' WHEN regexp_matches(lower(substr(h, 1, 4000)), 'just a moment|access denied|are you a robot|verify you are human|captcha|enable javascript and cookies') THEN 'blocked'
  WHEN len(list_filter(regexp_extract_all(h, '(?i)href=["'']([^"'']+)["'']', 1), lambda x: regexp_matches(x, '(?i)\\.pdf($|[?#])') AND regexp_matches(x, '(?i)nutrition|allerg'))) > 0 THEN 'guide'
  WHEN regexp_matches(h, 'NutritionInformation|"(calories|kcal)"') THEN 'label' WHEN regexp_matches(h, '(?i)graphql|/api/(menu|products|nutrition)') THEN 'api'
  WHEN regexp_matches(h, 'href="/[^"/?#][^"]*"') THEN 'linked' ELSE 'rendered' END AS kind,
  len(list_distinct(list_filter(regexp_extract_all(h, '(?i)https://[^"''\\\\ )]+?\\.(jpg|jpeg|png|webp)'), lambda x: NOT regexp_matches(x, '(?i)logo|icon|sprite|favicon|placeholder|banner|hero|badge|social')))) AS images FROM p)
SELECT site, page_id, kind, CAST(images AS INTEGER) AS images, length(h) < 15360 AS in_shell FROM k WHERE site IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY site ORDER BY CASE kind WHEN 'unknown' THEN 2 WHEN 'blocked' THEN 1 ELSE 0 END, page_id) = 1""")
def site_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.site_routes(table(spark, sf_dir, "pages"), "page_id")


@query(f"""WITH {SQL_ITEMS}, n AS (SELECT *, trim(split_part(name, ',', 2)) AS tail FROM items)
SELECT item_id, CASE lower(tail) WHEN 'small' THEN 'S' WHEN 'medium' THEN 'M' WHEN 'large' THEN 'L' WHEN '12 oz' THEN '12' ELSE tail END AS short_label,
format('{{:,}} mg', CAST(round_even(sodium, 0) AS BIGINT)) AS sodium_text, regexp_replace(CAST(round_even(trans_fat, 1) AS VARCHAR), '\\.0$', '') || ' g' AS trans_text,
concat(CASE WHEN protein < fat THEN '-' ELSE '+' END, CAST(CAST(abs(protein - fat) AS BIGINT) AS VARCHAR), ' g') AS difference_text FROM n""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.trim(F.coalesce(F.get(F.split("name", ","), F.lit(1)), F.lit("")))
    return items(spark, sf_dir).select(
        "item_id", labels.short_size(tail).alias("short_label"), labels.amount(F.col("sodium"), "mg").alias("sodium_text"),
        labels.fine_grams(F.col("trans_fat")).alias("trans_text"), labels.difference(F.col("protein") - F.col("fat"), "g").alias("difference_text"))
