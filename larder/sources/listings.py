"""Readers of product listings: four shapes of what chains publish, one schema of items.

``content_items`` reads documents of a content store and keeps what the live menu reaches, ``snapshot_items``
reads stored snapshots with sections of the menu, ``product_items`` reads product objects out of pushed page
chunks, ``keyed_items`` reads pages that carry a list of keys and values. All return the columns of ITEM.

Records are JSON texts. They are parsed once, as VARIANT, and values are taken by path; a record that can't be
parsed, or has no name, is no item. Of items of one chain with one key the first by ``pos`` stays (ties: the
smallest record), found by an aggregate that combines before the shuffle, so a hot chain is no hot task. Other
columns of the input are not read. Nulls and empty tables give no items.
"""

from __future__ import annotations

import html as entities
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.checkpoints import cut, spread
from larder.functions import text as t
from larder.sources import embedded

# Nutrients of an item, and the names that content stores give them.
NUTRIENTS = ("kcal", "protein", "carbs", "fat", "sat_fat", "trans_fat", "cholesterol", "sodium", "sugar", "fiber")
STORE_NUTRIENTS = {"kcal": "calories", "protein": "proteins", "carbs": "carbohydrates", "fat": "fat", "sat_fat": "saturatedFat", "trans_fat": "transFat", "cholesterol": "cholesterol", "sodium": "sodium", "sugar": "sugar", "fiber": "fiber"}
KEYED_NUTRIENTS = {"kcal": "calories", "protein": "protein", "carbs": "carbs", "fat": "fat"}

# Allergens in their order; the first nine are also those of product lists.
ALLERGENS = ("milk", "eggs", "fish", "shellfish", "treeNuts", "peanuts", "wheat", "soy", "sesame", "gluten", "celery", "mustard", "lupin", "sulphurDioxide")
# Other names of allergens, in snapshots and in product lists.
SNAPSHOT_ALLERGENS = {"milk": "milk", "egg": "eggs", "eggs": "eggs", "wheat": "wheat", "soy": "soy", "sesame": "sesame", "peanut": "peanuts", "peanuts": "peanuts", "tree nuts": "treeNuts", "fish": "fish",
                      "fish (pollock)": "fish", "shellfish": "shellfish"}
LIST_ALLERGENS = {"milk": "milk", "eggs": "eggs", "fish": "fish", "shellfish": "shellfish", "peanuts": "peanuts", "wheat": "wheat", "soy": "soy", "sesame": "sesame",
                  "egg": "eggs", "tree nuts": "treeNuts", "treenuts": "treeNuts", "peanut": "peanuts", "gluten": "wheat"}

# What is kept out by name, how an asset's reference is built, and how images are asked for.
PLACEHOLDER = r"(?i)\b(test|dummy|placeholder)\b"
ASSET = r"^image-([a-f0-9]+)-([0-9]+x[0-9]+)-([a-z0-9]+)$"
ASSET_URL = "https://cdn.sanity.io/images/"
ASSET_SIZE = "?w=1000&h=1000&fit=max&fm=webp&q=85"
SNAPSHOT_SIZE = "?wid=1000&fmt=png-alpha"
PATH_SAFE = r"A-Za-z0-9_.~:/-"
URL_SAFE = r"A-Za-z0-9_.~:/?#\[\]@!$&'()*+,;=%-"

ITEM = ("chain", "ext_key", "name", "category", "serving", "source", "source_url", "image_url", "allergens", *NUTRIENTS)


def percent_encoded(url: Column, safe: str = URL_SAFE) -> Column:
    """``url`` with everything outside ``safe`` (signs of a character class) as UTF-8 percent codes."""
    run = F.regexp_extract_all(url, F.lit(f"[{safe}]+|[^{safe}]+"), F.lit(0))
    coded = F.transform(run, lambda r: F.when(F.regexp_like(r, F.lit(f"^[{safe}]")), r).otherwise(F.replace(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))))
    return F.array_join(coded, "")


def clean_url(url: Column) -> Column:
    """A URL that can be asked for: without format characters, other signs as percent codes."""
    return percent_encoded(F.regexp_replace(url, r"\p{Cf}", ""))


def asset_url(project: Column, dataset: Column, ref: Column) -> Column:
    """The address of a content store's image; null for other references."""
    name = F.concat(*[F.regexp_extract(ref, ASSET, 1), F.lit("-"), F.regexp_extract(ref, ASSET, 2), F.lit("."), F.regexp_extract(ref, ASSET, 3)])
    return F.when(F.regexp_like(ref, F.lit(ASSET)), F.concat(F.lit(ASSET_URL), project, F.lit("/"), dataset, F.lit("/"), name, F.lit(ASSET_SIZE)))


def titled(text: Column) -> Column:
    """Every run of letters with a capital first and small letters after; empty becomes null."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.nullif(F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), ""), F.lit(""))


def known_allergens(names: Column, known: Mapping[str, str]) -> Column:
    """Our names for the given ones, distinct, in the order given; unknown ones are dropped."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ours = F.transform(names, lambda n: F.try_element_at(table, F.lower(F.trim(n))))
    return F.coalesce(F.array_distinct(F.array_compact(ours)), F.array().cast("array<string>"))


def flagged_allergens(flags: Column) -> Column:
    """Names of ALLERGENS that an object of flags holds as true, or as another number or text than 0 and ''."""
    given = [F.when(_truth(F.try_variant_get(flags, f"$.{a}", "string")), F.lit(a)) for a in ALLERGENS]
    return F.array_compact(F.array(*given))


def _truth(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False))


def _at(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def _number(record: Column, path: str) -> Column:
    """A finite number with one decimal, or null; true and false are no numbers."""
    value = _at(record, path, "double")
    told = F.coalesce(F.schema_of_variant(_at(record, path, "variant")) != "BOOLEAN", F.lit(True))
    return F.when(told & (F.abs(value) < float("inf")), F.bround(value, 1))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("r", F.try_parse_json("record")).where("r IS NOT NULL")


def _first(items: DataFrame, key: Column, counts: Column | None = None) -> DataFrame:
    """The first item of each chain and key, by pos; ``items`` has the columns of ITEM, pos and tie. Rows that don't count are none."""
    row, order = F.struct(*ITEM), F.struct("pos", "tie")
    first = F.min_by("item", order if counts is None else F.when(counts, order))
    return items.withColumn("item", row).groupBy("chain", key.alias("first_key")).agg(first.alias("item")).where("item IS NOT NULL").select("item.*")


def live_ids(menus: DataFrame) -> DataFrame:
    """chain and id of every item that a chain's menu tree reaches.

    ``menus`` has chain and tree (JSON). Items are objects of type "item" under ``sections``; ``opts`` leads
    deeper. One round goes one level down, for all chains at once; the rounds end with the deepest tree.
    """
    nodes = menus.select("chain", F.try_variant_get(F.try_parse_json("tree"), "$.sections", "variant").alias("node"))
    found = None
    while True:
        nodes = cut(nodes.where(F.schema_of_variant("node").rlike("^(ARRAY|OBJECT)")))
        if found is not None and nodes.isEmpty():
            return found.distinct()
        a_list = F.schema_of_variant("node").startswith("ARRAY")
        name, kind = (F.coalesce(F.nullif(_at(F.col("node"), f"$.{a}"), F.lit("")), _at(F.col("node"), f"$.{b}")) for a, b in (("_id", "id"), ("_type", "t")))
        ids = nodes.where(~a_list & (kind == "item") & (F.coalesce(name, F.lit("")) != "")).select("chain", name.alias("id"))
        found = ids if found is None else found.unionByName(ids)
        # One explode for lists and objects: a union of the two would double the partitions with every level.
        below = F.when(a_list, F.try_variant_get("node", "$", "array<variant>")).otherwise(F.array(F.try_variant_get("node", "$.opts", "variant")))
        nodes = nodes.select("chain", F.explode(below).alias("node"))


def content_items(docs: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Items of content stores: named, not a dummy, of the home region, no placeholder, and on the live menu.

    ``docs`` has chain, domain, project, dataset, pos and record; ``live`` chain and id, or None for all. Names
    that are one name by ``text.plain_words`` are one item, though their keys differ.
    """
    r = F.col("r")
    rows = _parsed(docs).withColumn("name", t.clean(_at(r, "$.name"))).where("name IS NOT NULL")
    rows = rows.where(~_truth(_at(r, "$.dummy")) & F.coalesce(_at(r, "$.region") == "US", F.lit(True)) & ~F.regexp_like("name", F.lit(PLACEHOLDER)))
    if live is not None:
        rows = rows.withColumn("id", _at(r, "$._id")).join(live, ["chain", "id"], "left_semi")
    items = rows.select("chain", t.slug(F.col("name")).alias("ext_key"), "name", titled(_at(r, "$.L2")).alias("category"), F.lit(None).cast("string").alias("serving"),
                        F.col("domain").alias("source"), F.concat(F.lit("https://www."), "domain", F.lit("/menu")).alias("source_url"),
                        asset_url(F.col("project"), F.col("dataset"), _at(r, "$.image")).alias("image_url"), flagged_allergens(_at(r, "$.allergens", "variant")).alias("allergens"),
                        *[_number(r, f"$.nutrition.{theirs}").alias(ours) for ours, theirs in STORE_NUTRIENTS.items()], "pos", F.col("record").alias("tie"))
    return _first(items, F.array_join(t.plain_words(F.col("name")), " "))


def snapshot_items(records: DataFrame, sections: DataFrame, titles: Sequence[tuple[str, str]], showcases: Sequence[str]) -> DataFrame:
    """Items of stored snapshots: named and with calories; the category is the first of ``titles`` that lists the item.

    ``records`` has chain, source, source_url, pos and record; ``sections`` chain, title and id; ``titles`` are pairs
    of a section's title and our category, first ones first. An item in none of them keeps its own category
    unless that is one of ``showcases``, which sell and don't tell what the food is.
    """
    r = F.col("r")
    ours, rank = (F.create_map(*[x for title, v in pairs for x in (F.lit(title), F.lit(v))]) for pairs in (dict(reversed(titles)).items(), {n: k for k, (n, _) in reversed(list(enumerate(titles)))}.items()))
    listed = (sections.select("chain", "id", F.try_element_at(ours, "title").alias("ours"), F.try_element_at(rank, "title").alias("rank")).where("rank IS NOT NULL AND id IS NOT NULL")
              .groupBy("chain", "id").agg(F.min_by("ours", "rank").alias("listed")))
    # Rows that are no items lose at the end, and rows lie in as many partitions as there are, each read and told apart in one.
    grams, image = _at(r, "$.g"), F.nullif(_at(r, "$.img"), F.lit(""))
    told = records.withColumn("r", F.try_parse_json("record")).select(
        "chain", _at(r, "$.id").alias("id"), t.clean(_at(r, "$.n")).alias("name"), F.when(~_at(r, "$.cat").isin(*showcases), _at(r, "$.cat")).alias("own"), F.when(_truth(grams), F.concat(grams, F.lit(" g"))).alias("serving"),
        "source", "source_url", F.concat(percent_encoded(image, PATH_SAFE), F.lit(SNAPSHOT_SIZE)).alias("image_url"),
        known_allergens(_at(r, "$.alg", "array<string>"), SNAPSHOT_ALLERGENS).alias("allergens"), *[_at(r, f"$.{n}", "double").alias(n) for n in NUTRIENTS], "pos", F.col("record").alias("tie"))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spread(told, "chain", "id", parts=parts).join(listed, ["chain", "id"], "left")
    items = rows.withColumn("ext_key", t.slug(F.col("name"))).withColumn("category", F.coalesce("listed", "own"))
    return _first(items, F.col("ext_key"), F.col("name").isNotNull() & F.col("kcal").isNotNull())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _products(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([[json.dumps(o) for o in embedded.marked_objects(embedded.stream(h), '"seoUrl":')] if h is not None else [] for h in batch])


def product_items(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Items of menu pages that push their products as objects, first by address, then by key.

    ``pages`` has chain, domain and html (one a chain; of several, products keep the order of their pages by
    html). ``details`` has source_url and html of the items' own pages: their label gives the nutrients, and the
    list's calories stand in where it gives none. Without ``details`` the list gives calories alone.
    """
    r = F.col("r")
    told = pages.select("chain", "domain", F.md5("html").alias("page"), F.posexplode(_products("html")).alias("k", "record"))
    rows = _parsed(told.withColumn("pos", F.struct("page", "k"))).withColumn("name", t.clean(_at(r, "$.name"))).withColumn("seo", F.nullif(_at(r, "$.seoUrl"), F.lit("")))
    rows = rows.where("name IS NOT NULL AND seo IS NOT NULL")
    images = _at(r, "$.images", "array<struct<type string, url string>>")
    hero, thumbnail = (F.nullif(F.try_element_at(f, F.lit(-1))["url"], F.lit("")) for f in (F.filter(images, lambda i: i["type"] == "hero"), F.filter(images, lambda i: i["type"] == "thumbnail")))
    tail = F.when(F.contains("seo", F.lit("/")), F.regexp_replace("seo", "^[^/]*/", "")).otherwise(F.col("seo"))
    items = rows.select("chain", "seo", t.slug(F.col("name")).alias("ext_key"), "name", F.nullif(_at(r, "$.category.name"), F.lit("")).alias("category"), F.lit(None).cast("string").alias("serving"),
                        F.col("domain").alias("source"), F.concat(F.lit("https://www."), "domain", F.lit("/menu/"), tail).alias("source_url"), F.coalesce(hero, thumbnail).alias("image_url"),
                        known_allergens(_at(r, "$.allergens", "array<string>"), LIST_ALLERGENS).alias("allergens"), _number(r, "$.nutrition.calories").alias("kcal"),
                        *[F.lit(None).cast("double").alias(n) for n in NUTRIENTS[1:]], "pos", F.col("record").alias("tie"))
    by_address = items.withColumn("row", F.struct(*[c for c in items.columns if c not in ("chain", "seo")])).groupBy("chain", "seo").agg(F.min_by("row", F.struct("pos", "tie")).alias("row"))
    kept = _first(by_address.select("chain", "row.*"), F.col("ext_key"))
    if details is None:
        return kept
    own = details.groupBy("source_url").agg(F.min("html").alias("html"))
    labelled = kept.join(own, "source_url", "left").withColumn("label", embedded.stream_label("html", "name"))
    given = {"kcal": F.coalesce("label.kcal", "kcal"), **{n: F.col(f"label.{n}") for n in NUTRIENTS[1:]}}
    return labelled.select(*[given.get(c, F.col(c)).alias(c) for c in ITEM])


@F.pandas_udf(T.StringType())
def _unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(entities.unescape, na_action="ignore")


def keyed_items(pages: DataFrame) -> DataFrame:
    """Items of pages that carry ``"nutrition":[{"key":..,"value":..},..]``, named by their Open Graph title up to a bar.

    ``pages`` has chain, source, source_url and html. Pages without a name or without calories are no items; of a
    repeated key the last value counts; of pages with one key the first by address stays.
    """
    listed = F.from_json(F.regexp_extract("html", r'(?s)"nutrition":(\[.*?\])', 1), "array<struct<key string, value string>>")
    value = lambda k: F.try_element_at(F.filter(listed, lambda e: e["key"] == k), F.lit(-1))["value"]
    amount = {ours: F.regexp_replace(value(theirs), "[^0-9.]", "").try_cast("double") for ours, theirs in KEYED_NUTRIENTS.items()}
    rows = pages.withColumn("name", t.clean(F.split_part(_unescaped(F.regexp_extract("html", 'property="og:title" content="([^"]*)"', 1)), F.lit("|"), F.lit(1))))
    items = rows.select("chain", t.slug(F.col("name")).alias("ext_key"), "name", *[F.lit(None).cast("string").alias(c) for c in ("category", "serving")], "source", "source_url",
                        F.lit(None).cast("string").alias("image_url"), F.array().cast("array<string>").alias("allergens"), *[amount.get(n, F.lit(None).cast("double")).alias(n) for n in NUTRIENTS],
                        F.col("source_url").alias("pos"), F.col("html").alias("tie"))
    return _first(items.where("name IS NOT NULL AND kcal IS NOT NULL"), F.col("ext_key"))
