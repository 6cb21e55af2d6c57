"""Facts, links and signals from stored pages by patterns; pages that need a tree are walked in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What tells platforms and bot walls.
SIGNALS = {"json_ld": "application/ld\\+json", "open_graph": "property=[\"']og:", "table": "<table", "next_data": "__NEXT_DATA__", "script": "<script", "navigation": "<nav", "article": "<article", "advert": "class=\"ad\"", "form": "<form", "image": "<img"}
WALL_MARKERS = ("just a moment", "access denied", "are you a robot", "verify you are human", "captcha", "enable javascript and cookies")
NUTRIENTS = {"calories": "kcal", "proteincontent": "protein", "carbohydratecontent": "carbs", "fatcontent": "fat", "saturatedfatcontent": "sat_fat", "transfatcontent": "trans_fat",
             "cholesterolcontent": "cholesterol", "sodiumcontent": "sodium", "sugarcontent": "sugar", "fibercontent": "fiber"}
ITEM_TYPES = ("Product", "MenuItem", "Recipe", "FoodItem")
FACTS = T.StructType([T.StructField("name", T.StringType()), T.StructField("image", T.StringType()), *[T.StructField(v, T.DoubleType()) for v in NUTRIENTS.values()]])


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def open_graph(html: Column, key: str) -> Column:
    """An og: value; a title loses what follows a spaced bar or hyphen."""
    value = F.regexp_extract(html, rf"(?is)<meta[^>]*property=[\"']og:{key}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+[|-]\s+.*$", "") if key == "title" else value), F.lit(""))


def signals(html: Column) -> Column:
    """Names of the signals in a page, in their order."""
    return F.array_compact(F.array(*[F.when(F.regexp_like(html, F.lit(p)), F.lit(n)) for n, p in SIGNALS.items()]))


def is_wall(html: Column, within: int = 4000) -> Column:
    """Whether the page's beginning says that it is a wall against bots."""
    head = F.lower(F.substring(html, 1, within))
    found = F.lit(False)
    for marker in WALL_MARKERS:
        found = found | F.contains(head, F.lit(marker))
    return found


def links(pages: DataFrame, prefix: str = "/") -> DataFrame:
    """page_id, place and path of each page's links on its own host under ``prefix``, once each, in order."""
    host = F.parse_url("url", F.lit("HOST"))
    found = F.regexp_extract_all(F.col("html"), F.lit(r'href="([^"#?]+)"'), F.lit(1))
    rows = pages.select("page_id", host.alias("host"), F.posexplode(found).alias("place", "href"))
    own = F.when(F.startswith("href", F.lit("/")), F.col("href")).when(F.regexp_extract("href", r"^https?://([^/]+)", 1) == F.col("host"), F.regexp_replace("href", r"^https?://[^/]+", ""))
    paths = rows.withColumn("path", own).where(F.col("path").isNotNull() & F.startswith("path", F.lit(prefix)) & (F.col("path") != prefix))
    return paths.groupBy("page_id", "path").agg(F.min("place").alias("place"))


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, row, section, column and cell of tables that describe their columns by headers=.

    A row of class subCategory opens a section, which is carried forward over the rows after it.
    """
    heads = F.regexp_extract_all("html", F.lit(r'(?is)<th[^>]*id="([^"]+)"[^>]*>.*?</th>'), F.lit(1))
    names = F.transform(F.regexp_extract_all("html", F.lit(r'(?is)<th[^>]*id="[^"]+"[^>]*>(.*?)</th>'), F.lit(1)), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"(?is)<[^>]*>", " "), r"(?i)\s*sort by.*$", "")))
    rows = pages.select("page_id", F.map_from_arrays(heads, names).alias("names"), F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))).alias("row", "tr"))
    label = F.when(F.regexp_like("tr", F.lit(r'(?i)^<tr[^>]*class="[^"]*subCategory')), F.trim(F.regexp_replace("tr", r"(?is)<[^>]*>", " ")))
    order = Window.partitionBy("page_id").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("section", F.last(label, ignorenulls=True).over(order)).where(~F.regexp_like("tr", F.lit(r'(?i)^<tr[^>]*class="[^"]*subCategory')))
    cells = told.select("page_id", "row", "section", "names", F.explode(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>.*?</td>"), F.lit(0))).alias("td"))
    column = F.try_element_at("names", F.regexp_extract("td", r'headers="([^"]+)"', 1))
    value = F.coalesce(F.nullif(F.regexp_extract("td", r'title="([^"]*)"', 1), F.lit("")), F.trim(F.regexp_replace("td", r"(?is)<[^>]*>", " ")))
    return cells.select("page_id", "row", "section", column.alias("column"), value.alias("cell"))


def _walk(node) -> Iterator[dict]:
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, dict):
            yield top
            stack.extend(reversed(list(top.values())))
        elif isinstance(top, list):
            stack.extend(reversed(top))


def _number(value) -> float | None:
    digits = "".join(c for c in str(value) if c.isdigit() or c == ".")
    try:
        return float(digits)
    except ValueError:
        return None


def _facts(texts: list[str]) -> dict:
    found: dict = {}
    for text in texts:
        try:
            tree = json.loads(text)
        except ValueError:
            continue
        for node in _walk(tree):
            kinds = node.get("@type")
            if not set(ITEM_TYPES) & set(kinds if isinstance(kinds, list) else [kinds]):
                continue
            image = node.get("image")
            image = image[0] if isinstance(image, list) and image else image
            found.setdefault("name", node.get("name"))
            found.setdefault("image", image.get("url") if isinstance(image, dict) else image)
            for key, value in (node.get("nutrition") or {}).items():
                field = NUTRIENTS.get(key.replace("_", "").lower())
                if field and (number := _number(value)) is not None:
                    found.setdefault(field, number)
    return found


@F.pandas_udf(FACTS)
def _json_facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for scripts in batches:
        rows = [_facts(list(s)) for s in scripts]
        yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object if n in ("name", "image") else "float64") for n in FACTS.names})


def structured_facts(pages: DataFrame) -> DataFrame:
    """Facts of item-like JSON-LD anywhere in the page, then Open Graph where it has none."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.withColumn("facts", _json_facts(scripts))
    name = F.coalesce("facts.name", open_graph(F.col("html"), "title"))
    image = F.coalesce("facts.image", open_graph(F.col("html"), "image"))
    return rows.select("page_id", name.alias("name"), image.alias("image"), *[F.col(f"facts.{v}").alias(v) for v in NUTRIENTS.values()])


def repeated_lines(lines: DataFrame, by: str, share: float = 0.30, least_pages: int = 8) -> DataFrame:
    """Lines that stand on many of a group's pages (page furniture): at least 2 and ``share`` of them.

    ``lines`` has the group, page and line; groups under ``least_pages`` pages have none.
    """
    pages = lines.groupBy(by).agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    counts = lines.select(by, "page", "line").distinct().groupBy(by, "line").agg(F.count("*").alias("on_pages"))
    return counts.join(pages, by).where(F.col("on_pages") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select(by, "line", "on_pages")
