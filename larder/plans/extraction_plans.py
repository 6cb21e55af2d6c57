"""Queries over stored pages and document lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.io import table
from larder.plans.items import items
from larder.plans.registry import query
from larder.sources import html, packs


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"#?]+)"', 1) AS hs, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
e AS (SELECT page_id, host, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS place FROM h),
p AS (SELECT page_id, place, CASE WHEN starts_with(href, '/') THEN href WHEN regexp_extract(href, '^https?://([^/]+)', 1) = host THEN regexp_replace(href, '^https?://[^/]+', '') END AS path FROM e)
SELECT page_id, path, CAST(min(place) AS INTEGER) AS place FROM p WHERE path IS NOT NULL AND starts_with(path, '/') AND path <> '/' GROUP BY page_id, path""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages"))


_SIGNAL_LIST = ", ".join("CASE WHEN regexp_matches(html, '" + p.replace("'", "''") + f"') THEN '{n}' END" for n, p in html.SIGNALS.items())


@query(f"SELECT page_id, array_to_string(list_filter([{_SIGNAL_LIST}], lambda x: x IS NOT NULL), ',') AS signals FROM pages")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html.signals(F.col("html")), ",").alias("signals"))


@query("SELECT page_id, " + " OR ".join(f"contains(lower(substr(html, 1, 4000)), '{m}')" for m in html.WALL_MARKERS) + " AS is_wall FROM pages")
def bot_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.is_wall(F.col("html")).alias("is_wall"))


@query()
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.structured_facts(table(spark, sf_dir, "pages"))


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source HAVING count(DISTINCT doc_id) >= 8),
c AS (SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM l GROUP BY source, line) SELECT source, line, on_pages FROM c JOIN p USING (source) WHERE on_pages >= greatest(2, CAST(floor(pages * CAST(0.02 AS DOUBLE)) AS BIGINT))""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    return html.repeated_lines(lines, "source", share=0.02)


@query()
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("chain", F.col("item_id").cast("string").alias("key"), "name", "category", "serving", "kcal", "protein", "carbs", "fat", "sugar")
    return packs.build_packs(rows, 1).select("chain", "item_count", "sha256", "bytes")
