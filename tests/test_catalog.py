"""Catalog operators on small fixtures."""

import datetime
import difflib

import pytest
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.operators import catalog, classify, history, matching, menu, quality, search, variants
from larder.plans.items import items
from larder.sources import html, packs, seed
from larder.streaming import search_events


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_slug_and_search_form(spark):
    assert one(spark, t.slug(F.lit("McDonald's  Big-Mac!"))) == "mcdonald-s-big-mac"
    assert one(spark, t.search_form(F.lit("Chick-Fil-A"))) == "chick fil a"
    assert one(spark, t.search_form(F.lit("Crème Brûlée"))) == "creme brulee"


def test_numbers(spark):
    assert [one(spark, t.seed_number(F.lit(x))) for x in ("12.34", "NA", "", "-", "1d")] == [12.3, None, None, None, None]
    assert one(spark, t.bounded_number(F.lit("1,050mg"))) == 1050 and one(spark, t.bounded_number(F.lit("<5mg"))) == 5
    assert one(spark, t.guide_number(F.lit("<5mg"))) is None


def test_names(spark):
    assert one(spark, t.portion(F.lit("10 Chicken McNuggets, Large"))) == ["10", "large"]
    assert one(spark, t.comparable(F.lit("Kid's Burger, 2 pc"))) == "burger"
    assert one(spark, t.shortenings(F.lit("Club on Wheat, Giant")))[0] == "club on wheat"
    assert "club" in one(spark, t.shortenings(F.lit("Club on Wheat, Giant")))


@pytest.mark.parametrize(("name", "category", "want"), [
    ("Egg McMuffin", "Entrees", "Breakfast"), ("Blueberry Bagel", "Baked Goods", "Baked Goods"),
    ("Bacon Ranch Sandwich", "Sandwiches", "Sandwiches"), ("Bacon, Egg & Cheese Sandwich", "Sandwiches", "Breakfast")])
def test_sections(spark, name, category, want):
    assert one(spark, classify.section(F.lit(name), F.lit(category))) == want


@pytest.mark.parametrize(("name", "want"), [('12" Wrap', "wrap"), ('6" Steak Philly', "sub-sandwich"), ("Big Mac", "cheeseburger"), ("Dip for Chicken Nuggets", "sauce")])
def test_archetypes(spark, name, want):
    assert one(spark, classify.archetype(F.lit(name), F.lit(None).cast("string"))) == want


@pytest.mark.parametrize(("name", "want"), [("Ranch Dressing, Cup", False), ("Coca Cola, Large", False), ("Cheese Ravioli with Meat Sauce", True), ("Coke Float", True), ("Cookie Monster Cake", True), ("Butter", False)])
def test_own_photo(spark, name, want):
    assert one(spark, classify.needs_own_photo(F.lit(name))) == want


def menu_rows(spark, rows):
    return spark.createDataFrame(rows, "chain string, item_id long, name string, has_photo boolean, off_menu boolean, kcal double")


def test_search_ranks(spark):
    rows = menu_rows(spark, [("A", 1, "Big Mac Sauce", False, False, 90.0), ("A", 2, "Big Mac", False, False, 540.0), ("B", 3, "Macaroni Salad", False, False, 300.0), ("A", 4, "Mac", False, True, 1.0)])
    assert [r.item_id for r in search.ranked_search(rows, "mac").collect()] == [3, 2, 1, 4]
    assert [r.item_id for r in search.ranked_search(rows, "big mac", chain="A").collect()] == [2, 1]
    assert search.ranked_search(rows, "  ").count() == 0


def test_variant_groups(spark):
    names = ["Coca Cola, Small", "Coca Cola, Large", "Coca Cola, Medium", "10 Chicken Nuggets", "6 Chicken Nugget", "Big Breakfast w/ Hotcakes", "Big Breakfast", "Apple Slices, 1 Package"]
    rows = menu_rows(spark, [("A", i, n, i == 2, False, 100.0 + i) for i, n in enumerate(names)])
    got = {r.item_id: (r.group, r.label, r.position, r.kind) for r in variants.assign_groups(rows).collect()}
    assert got == {0: ("coca-cola", "Small", 0, "size"), 2: ("coca-cola", "Medium", 1, "size"), 1: ("coca-cola", "Large", 2, "size"),
                   4: ("chicken-nugget", "6", 0, "size"), 3: ("chicken-nugget", "10", 1, "size"),
                   6: ("big-breakfast", "Plain", 0, "option"), 5: ("big-breakfast", "Hotcakes", 1, "option")}
    grouped = rows.join(variants.assign_groups(rows).select("chain", "item_id", "group", "position"), ["chain", "item_id"], "left")
    assert {r.item_id for r in variants.collapse(grouped, ["chain", "group"], "position").collect()} == {2, 4, 6, 7}


def test_items_of_one_row_group_are_dealt_over_all_tasks(spark, sf_dir):
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() == 1
    assert items(spark, sf_dir).rdd.getNumPartitions() == 4  # it was 1, so one task computed on every row


def test_names_are_read_once(spark, tmp_path):
    names = ("Soup, Small", "Soup, Odd Tub", "Stew, Odd Tub", "Rice, Odd Tub", "Fries w/ Cheese", "Fries", "6 pc Wings", "Plain Dish", None)
    rows = spark.range(900).select(F.lit("a").alias("chain"), F.col("id").alias("item_id"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 9 + 1).cast("int")).alias("name"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/items.parquet")
    scanned = variants.assign_groups(spark.read.parquet(f"{tmp_path}/items.parquet"))
    assert "regexp_extract(name" not in scanned._jdf.queryExecution().optimizedPlan().toString()  # names were read before
    assert {r.label for r in scanned.where("kind = 'size'").collect()} == {"Small", "Odd Tub", "6 pc"}
    assert scanned.where("label = 'Plain'").count() == 100 and scanned.where("item_id % 9 >= 7").count() == 0


def test_label_rules(spark):
    row = {"chain": "A", "item_id": 1, "name": "x", "category": None, "kcal": 200.0, "protein": 10.0, "carbs": 20.0, "fat": 10.0, "sat_fat": 30.0, "trans_fat": 0.0, "cholesterol": 30.0, "sodium": 400.0, "sugar": 5.0, "fiber": 2.0}
    kinds = "chain string, item_id long, name string, category string, kcal double, protein double, carbs double, fat double, sat_fat double, trans_fat double, cholesterol double, sodium double, sugar double, fiber double"
    rows = spark.createDataFrame([tuple(row.values()), tuple((row | {"item_id": 2, "kcal": 100.0, "sat_fat": 1.0}).values())], kinds)
    found = {(r.item_id, r.kind, r.field, r.severity) for r in quality.check_items(rows).collect()}
    assert found == {(1, "label", "sat_fat", "warning"), (2, "atwater", "kcal", "error")}
    assert quality.strip_broken_labels(rows).where("item_id = 1").first().sat_fat is None


def test_versions_are_idempotent(spark):
    day = datetime.datetime(2026, 1, 1)
    store = spark.createDataFrame([("a", 1, day, None), ("b", 2, day, None)], "k string, v int, valid_from timestamp, valid_to timestamp")
    given = spark.createDataFrame([("a", 5), ("b", 2), ("c", 9)], "k string, v int")
    now = F.lit(day + datetime.timedelta(days=1))
    moved = history.close_and_insert(store, given, ["k"], ["v"], now)
    assert moved.count() == 3 and moved.where("k = 'a' and valid_to is null").first().v == 5
    assert sorted(map(str, history.close_and_insert(moved, given, ["k"], ["v"], now).collect())) == sorted(map(str, moved.collect()))


def test_readiness_by_cards(spark):
    rows = spark.createDataFrame([("A", f"c{i}", i < 5, i < 9, False, True) for i in range(10)] + [("A", "old", False, False, True, True)],
                                 "chain string, card string, has_photo boolean, fresh boolean, off_menu boolean, wants_photo boolean")
    r = catalog.readiness(rows).first()
    assert (r.cards, r.photo_share, r.fresh_share, r.ready) == (10, 0.5, 0.9, True)


def test_order_quantities(spark):
    lines = spark.createDataFrame([(1, 30, 10.0, False), (1, 0, 99.0, True), (1, 2, 5.0, False)], "o int, quantity int, kcal double, stale boolean")
    r = menu.order_totals(lines, ["o"], ["kcal"]).first()
    assert (r.item_count, r.kcal, r.stale) == (22, 210.0, False)


def test_assignment_is_one_to_one(spark):
    live = spark.createDataFrame([("A", "x1", "Grilled Chicken Sandwich"), ("A", "x2", "Chiken Sandwich"), ("A", "x3", "6 Nuggets")], "chain string, ext_key string, name string")
    stored = spark.createDataFrame([("A", "s1", "Grilled Chicken Sandwich"), ("A", "s2", "Chicken Sandwich"), ("A", "s3", "10 Nuggets")], "chain string, ext_key string, name string")
    got = {(r.live_key, r.stored_key) for r in matching.assign(live, stored).collect()}
    assert got == {("x1", "s1"), ("x2", "s2")}


def test_photo_words(spark):
    assert matching.words_agree_in("dragon fruit lemonade", "dragonfruit lemonade")
    assert not matching.words_agree_in("farmhouse egg sandwich", "maplehouse egg sandwich")
    stored = spark.createDataFrame([("A", "k1", "Blueberry Muffin Paradise"), ("A", "k2", "#1 BLT, Seeded Italian Bread, Giant")], "chain string, ext_key string, name string")
    shots = spark.createDataFrame([("A", "p1", "Muffin - Blueberry"), ("A", "p2", "#1 BLT")], "chain string, shot_key string, name string")
    assert {(r.ext_key, r.shot_key) for r in matching.photo_pairs(stored, shots).collect()} >= {("k2", "p2")}


TYPOS = [("pepperoni", "pepperonis"), ("cheeseburger", "cheesburger"), ("lemonade", "elmonade"), ("tea", "soup"), ("grilled sandwich", "griled sandwitch"), ("omelette", "homelette")]


def test_presence_and_photos_equal_brute_force_on_typos(spark):
    items = spark.createDataFrame([("A", f"k{i}", a) for i, (a, _) in enumerate(TYPOS)], "chain string, ext_key string, name string")
    shown = spark.createDataFrame([("A", f"p{i}", b) for i, (_, b) in enumerate(TYPOS)] + [("B", "q", "tea")], "chain string, shot_key string, name string")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    got = {r.ext_key: r.on_menu for r in matching.present(items, shown).collect()}
    assert got == {f"k{i}": any(ratio(a, b) >= matching.PRESENT for _, b in TYPOS) for i, (a, _) in enumerate(TYPOS)}
    assert got["k0"] and got["k1"] and not got["k3"]

    wanted = items.select("ext_key", matching.dish(F.col("name")).alias("dish")).collect()
    offered = shown.where("chain = 'A'").select("shot_key", matching.dish(F.col("name")).alias("dish")).collect()
    pairs = {(r.ext_key, r.shot_key) for r in matching.photo_pairs(items, shown).collect()}
    want = set()
    for w in wanted:
        fits = [(-ratio(w.dish, o.dish), o.shot_key) for o in offered if ratio(w.dish, o.dish) >= matching.NEAR and matching.words_agree_in(w.dish, o.dish)]
        want |= {(w.ext_key, min(fits)[1])} if fits else set()
    assert pairs == want and ("k2", "p2") in pairs and ("k5", "p5") in pairs


def test_page_readers(spark):
    page = ('<html><script type="application/ld+json">{"@graph":[{"@type":"MenuItem","name":"Soup","nutrition":{"calories":"120 kcal","sodiumContent":"1.5"}}]}</script>'
            '<meta property="og:title" content="Bowl | Site"><meta property="og:image" content="i.png">'
            '<table><tr><th id="c1">Calories Sort by</th></tr><tr class="subCategory"><td>Hot</td></tr><tr><td headers="c1" title="1,050mg Sodium">x</td></tr></table></html>')
    pages = spark.createDataFrame([(1, "http://a.b/x", page)], "page_id long, url string, html string")
    facts = html.structured_facts(pages).first()
    assert (facts.name, facts.image, facts.kcal, facts.sodium) == ("Soup", "i.png", 120.0, 1.5)
    cell = html.table_cells(pages).where("cell like '1,050%'").first()
    assert (cell.section, cell.column) == ("Hot", "Calories")


def test_packs_round_trip(spark):
    rows = spark.createDataFrame([("A", "k1", "Soup", 120.0), ("A", "k2", "Bread", 80.0)], "chain string, key string, name string, kcal double")
    built = packs.build_packs(rows, 3).withColumn("url", F.lit("https://host/x")).cache()
    again = packs.build_packs(rows.repartition(3), 3)
    assert built.first().sha256 == again.first().sha256
    assert packs.installable(built, 2, "host").count() == 1 and packs.installable(built, 3, "host").count() == 0
    assert packs.installable(built.withColumn("sha256", F.lit("0")), 2, "host").count() == 0
    built.unpersist()


def test_seed_scan(spark, tmp_path):
    lines = ["Restaurant,Item_Name,Food_Category,Calories,Protein,Carbohydrates,Total_Fat,Combo_Meal,Kids_Meal,Serving_Size,Serving_Size_Unit",
             '"A","1 Mini Cheeseburger",Burgers,360,15,22,23,0,1,,', 'A,Combo,Burgers,1,1,1,1,1,0,,', 'A,1 Mini  Cheeseburger,Burgers,9,9,9,9,0,0,4,oz', "A,No Fat,Burgers,1,1,1,NA,0,0,,"]
    (tmp_path / "seed.tab").write_text("\n".join(lines))
    rows = seed.parse(seed.scan(spark, str(tmp_path / "seed.tab"))).collect()
    assert [(r.name, r.kcal, r.flags) for r in rows] == [("1 Mini Cheeseburger", 360.0, ["kids"])]


def test_streams(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    events = search_events.event_stream(spark, str(tmp_path / "in"), batch.schema)
    query = (search_events.windowed_counts(events, late="60 days").writeStream.format("memory").queryName("larder_counts").outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert spark.table("larder_counts").agg(F.sum("n")).first()[0] == batch.count()
