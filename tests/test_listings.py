"""Listing readers against plain readings of the rules."""

import json
import random
import re
import unicodedata
import urllib.parse

import pytest
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.sources import listings

DOCS = "chain string, domain string, project string, dataset string, pos int, record string, name string"
RECORDS = "chain string, source string, source_url string, pos int, record string"
NAMES = ["Cola", "cola ", "Barq's", "Barqs", "Café Latte", "Cafe Latte", "  Big   Bun ", "Test Bun", "Contest", "a dummy", "", None, "Pie ®", "Tee (2 pc)", "!!!"]


def docs_of(chance, n):
    out = []
    for i in range(n):
        record = {"_id": f"i{chance.randrange(30)}", "name": chance.choice(NAMES), "L2": chance.choice([None, "", "kid's meals", "HOT drinks", "été 2x3y"]), "dummy": chance.choice([None, False, False, True]),
                  "region": chance.choice([None, "US", "US", "CA"]), "image": chance.choice([None, "image-ab12-10x20-png", "image-XY-10x20-png", "file-ab-1x1-png"]),
                  "nutrition": chance.choice([None, {"calories": chance.choice([100, 12.34, "55", "x", None, True]), "transFat": 0}]),
                  "allergens": chance.choice([None, {}, {"wheat": True, "milk": 1, "soy": 0, "eggs": False, "other": True}])}
        text = json.dumps(record) if chance.random() > 0.05 else chance.choice(["{cut", "", None, "[]", "3"])
        out.append((chance.choice(["A", "B"]), "a.example", "pr", "ds", i, text, "clash"))
    return out


def number(value):
    if value is None or isinstance(value, bool):
        return None
    try:
        return round(float(value), 1)
    except ValueError:
        return None


def plain_content(rows, form, live=None):
    out, seen = [], set()
    for chain, domain, project, dataset, _, text, _ in sorted(rows, key=lambda r: r[4]):
        try:
            r = json.loads(text or "")
        except json.JSONDecodeError:
            continue
        if not isinstance(r, dict):
            continue
        name = " ".join((r.get("name") or "").split())
        if not name or r.get("dummy") or r.get("region") not in (None, "US") or re.search(r"\b(test|dummy|placeholder)\b", name, re.I):
            continue
        if live is not None and (chain, r["_id"]) not in live or (chain, form[name]) in seen:
            continue
        seen.add((chain, form[name]))
        m = re.match(r"^image-([a-f0-9]+)-([0-9]+x[0-9]+)-([a-z0-9]+)$", r.get("image") or "")
        image = m and f"https://cdn.sanity.io/images/{project}/{dataset}/{m[1]}-{m[2]}.{m[3]}?w=1000&h=1000&fit=max&fm=webp&q=85"
        key = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")
        allergens = [a for a in listings.ALLERGENS if (r.get("allergens") or {}).get(a)]
        out.append((chain, key, name, (r.get("L2") or "").title() or None, image, allergens, *[number((r.get("nutrition") or {}).get(f)) for f in ("calories", "transFat")]))
    return sorted(out, key=str)


@pytest.mark.parametrize("with_menu", [False, True])
def test_content_items_equal_plain_reading(spark, with_menu):
    rows = docs_of(random.Random(7 + with_menu), 150)
    names = sorted({" ".join(n.split()) for n in NAMES if n})
    form = dict(spark.createDataFrame([(n,) for n in names], "n string").select("n", F.array_join(t.plain_words(F.col("n")), " ")).collect())
    live = {("A", f"i{k}") for k in range(0, 30, 2)} if with_menu else None
    menu = spark.createDataFrame(sorted(live), "chain string, id string") if with_menu else None
    got = listings.content_items(spark.createDataFrame(rows, DOCS), menu)
    assert got.columns == list(listings.ITEM)
    found = sorted((tuple(r) for r in got.select("chain", "ext_key", "name", "category", "image_url", "allergens", "kcal", "trans_fat").collect()), key=str)
    assert found == plain_content(rows, form, live) and found


def test_live_ids_reach_every_level_and_no_further(spark):
    deep = {"_type": "item", "_id": "deep"}
    for k in range(6):
        deep = {"t": "picker", "id": f"p{k}", "opts": [deep]}
    tree = {"sections": [{"name": "x", "opts": [{"_type": "item", "_id": "a", "opts": [{"t": "item", "id": "b"}]}, [[{"t": "item", "id": "c"}]], deep, None, 5, "text"]}], "other": [{"_type": "item", "_id": "no"}]}
    menus = [("A", json.dumps(tree)), ("A", json.dumps(tree)), ("B", None), ("B", "{cut"), ("C", '{"sections":{"t":"item","id":"one"}}'), ("D", '{"sections":[{"t":"item"},{"t":"item","_id":"","id":"late"}]}')]
    found = listings.live_ids(spark.createDataFrame(menus, "chain string, tree string"))
    assert sorted(tuple(r) for r in found.collect()) == [("A", "a"), ("A", "b"), ("A", "c"), ("A", "deep"), ("C", "one"), ("D", "late")]
    assert listings.live_ids(spark.createDataFrame([], "chain string, tree string")).collect() == []


def test_snapshot_categories_follow_priority_and_no_showcase(spark):
    records = [{"id": "1", "n": "Big  Bun", "kcal": 580, "g": 217, "cat": "Deals", "img": "https://x.example/a b (1)*~é.png", "alg": ["Wheat", " fish (Pollock)", "fish", "dust"]}, {"id": "2", "n": "Fries", "kcal": 0, "g": 0, "cat": "Deals"},
               {"id": "3", "n": "Tea", "kcal": 5, "cat": "Own"}, {"id": "4", "n": "No label"}, {"id": "5", "n": "big bun!", "kcal": 1}, {"id": "6", "kcal": 1}]
    rows = [("A", "s", "u", k, json.dumps(r)) for k, r in enumerate(records)] + [("B", "s", "u", 0, json.dumps(records[0])), ("B", "s", "u", 0, None)]
    sections = [("A", "Deals", "1"), ("A", "Late", "1"), ("A", "Early", "1"), ("A", "Unknown", "3"), ("B", "Late", "1"), ("B", None, None)]
    found = listings.snapshot_items(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(sections, "chain string, title string, id string"), [("Early", "Burgers"), ("Late", "Sides")], ["Deals"])
    image = urllib.parse.quote("https://x.example/a b (1)*~é.png", safe=":/") + "?wid=1000&fmt=png-alpha"
    got = sorted((tuple(r) for r in found.select("chain", "ext_key", "category", "serving", "image_url", "allergens", "kcal").collect()), key=str)
    assert got == [("A", "big-bun", "Burgers", "217 g", image, ["wheat", "fish"], 580.0), ("A", "fries", None, None, None, [], 0.0), ("A", "tea", "Own", None, None, [], 5.0),
                   ("B", "big-bun", "Sides", "217 g", image, ["wheat", "fish"], 580.0)]


def pushed(*texts):
    return "".join(f"<script>self.__next_f.push([1,{json.dumps(x)}])</script>" for x in texts)


def test_snapshots_are_told_apart_in_all_partitions(spark):
    records = spark.range(40).select(F.lit("a").alias("chain"), F.lit("s").alias("source"), F.lit("u").alias("source_url"), F.col("id").alias("pos"),
                                     F.format_string('{"id":"%d","n":"Dish %d","kcal":%s}', F.col("id"), F.col("id") % 5, F.when(F.col("id") < 5, "null").otherwise("7")).alias("record"))
    found = listings.snapshot_items(records.coalesce(1), spark.createDataFrame([("a", "Early", "6")], "chain string, title string, id string"), [("Early", "Burgers")], [])
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()  # partitions were put together before
    assert {(r.name, r.kcal, r.category) for r in found.collect()} == {(f"Dish {i}", 7.0, "Burgers" if i == 1 else None) for i in range(5)}


def test_product_list_keeps_first_address_and_key(spark):
    products = [{"seoUrl": "lab/pretzels/plain", "name": "Plain {one}", "category": {"name": "Pretzels"}, "images": [{"type": "thumbnail", "url": "t"}, {"type": "hero", "url": "h"}], "allergens": ["Egg", "Gluten", "wheat"], "nutrition": {"calories": 310}},
                {"seoUrl": "lab/pretzels/plain", "name": "Second address"}, {"seoUrl": "solo", "name": "plain one", "nutrition": {"calories": 1}}, {"seoUrl": "solo2", "name": "Dip", "images": [{"type": "thumbnail", "url": "t2"}], "nutrition": {"calories": 55}},
                {"seoUrl": "", "name": "None"}, {"seoUrl": "x"}]
    text = "1:" + json.dumps(products)
    pages = [("A", "a.example", pushed(text[:90], text[90:])), ("B", "b.example", None), ("C", "c.example", "<p>no list</p>")]
    listed = listings.product_items(spark.createDataFrame(pages, "chain string, domain string, html string"))
    take = ("chain", "ext_key", "category", "source_url", "image_url", "allergens", "kcal", "fat")
    assert sorted((tuple(r) for r in listed.select(*take).collect()), key=str) == [
        ("A", "dip", None, "https://www.a.example/menu/solo2", "t2", [], 55.0, None), ("A", "plain-one", "Pretzels", "https://www.a.example/menu/pretzels/plain", "h", ["eggs", "wheat"], 310.0, None)]
    label = pushed('{"name":"Plain {one}","nutrition":{"calories":"300 calories","fatContent":"4.5g"}}')
    details = spark.createDataFrame([("https://www.a.example/menu/pretzels/plain", label), ("https://www.a.example/menu/solo2", label)], "source_url string, html string")
    full = listings.product_items(spark.createDataFrame(pages, "chain string, domain string, html string"), details)
    assert full.columns == list(listings.ITEM)
    assert sorted(tuple(r) for r in full.select("ext_key", "kcal", "fat").collect()) == [("dip", 55.0, None), ("plain-one", 300.0, 4.5)]


def test_keyed_pages(spark):
    page = '<meta property="og:title" content="{0}"><script>{{"nutrition":{1}}}</script>'
    good = json.dumps([{"key": "calories", "value": "1,120 kcal"}, {"key": "fat", "value": 4.5}, {"key": "protein", "value": None}])
    pages = [("A", "s", "u1", page.format("Mac &amp; Cheese | Shop", good)), ("A", "s", "u2", page.format("mac cheese", good)), ("A", "s", "u3", page.format("", good)), ("A", "s", "u4", page.format("Tea", "[]")), ("A", "s", "u5", page.format("Bad", "[{cut]")), ("A", "s", "u6", None)]
    found = listings.keyed_items(spark.createDataFrame(pages, "chain string, source string, source_url string, html string"))
    assert [tuple(r) for r in found.select("ext_key", "name", "source_url", "kcal", "fat", "protein").collect()] == [("mac-cheese", "Mac & Cheese", "u1", 1120.0, 4.5, None)]


def test_clean_url_equals_quoting(spark):
    texts = ["https://x.example/a​b®.png?q=1&r=ü+%20*", "", "ÅÄ 😀~", "a­b", "[x]{y}|\\^`\"<>"]
    want = [urllib.parse.quote("".join(c for c in x if unicodedata.category(c) != "Cf"), safe=":/?#[]@!$&'()*+,;=~%-._") for x in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, u string").select("i", listings.clean_url(F.col("u")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == want


def test_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    pages = "chain string, domain string, source string, source_url string, html string"
    sections = empty("chain string, title string, id string")
    for df in (listings.content_items(empty(DOCS)), listings.snapshot_items(empty(RECORDS), sections, [("a", "b")], []), listings.product_items(empty(pages), empty(pages)), listings.keyed_items(empty(pages))):
        assert df.columns == list(listings.ITEM) and df.collect() == []
