"""Places, site probes and texts of labels against fixtures."""

import pytest
from pyspark.sql import functions as F

from larder.functions import labels
from larder.operators import places
from larder.sources import probe

CHAINS = ["Taco", "Taco Hill", "Blue Fry"]


@pytest.fixture(scope="module")
def chains(spark):
    return spark.createDataFrame([(c,) for c in CHAINS], "chain string")


def test_places_become_venues_of_the_longest_chain(spark, chains):
    rows = [(1, "Taco Hill Downtown", 1.5, 2.25, None), (1, "Taco Hill Downtown", 1.5, 2.25, None), (2, "Taco", 0.0, -3.0, "b"), (3, "Tacos", 1.0, 1.0, "c"), (4, None, 1.0, 1.0, "d"), (5, "Blue Fry", None, 1.0, "e"), (6, "", 1.0, 1.0, "f")]
    got = places.place_venues(spark.createDataFrame(rows, "place_id long, place string, lat double, lng double, address string"), chains).collect()
    assert sorted((r.place_id, r.chain, r.venue_key or "", r.address) for r in got) == [(1, "Taco Hill", "map:1.5,2.25", ""), (1, "Taco Hill", "map:1.5,2.25", ""), (2, "Taco", "map:0.0,-3.0", "b"), (5, "Blue Fry", "", "e")]


def test_only_answers_of_the_asked_chain_count_and_first_rows_stay(spark, chains):
    rows = [(7, "Taco One", 1.0, 1.0, "z", "Taco", 1), (3, "Taco Two", 1.0, 1.0, None, "Taco", 2), (4, "Taco Hill", 1.0, 1.0, "a", "Taco", 3), (5, "Taco", 2.0, 1.0, "a", "Taco", 4), (6, "Taco", None, None, "a", "Taco", 5), (8, "Taco", 3.0, 1.0, "a", None, 6)]
    answers = spark.createDataFrame(rows, "place_id long, place string, lat double, lng double, address string, asked string, place_no_ long")
    got = places.by_address(places.verified_venues(answers, chains, "asked")).collect()
    assert sorted((r.place_no, r.place_id, r.address, r.place_no_) for r in got) == [(1, 3, "", 2), (2, 5, "a", 4)]
    assert places.verified_venues(answers.limit(0), chains, "asked").count() == 0


def test_first_page_with_guides_gives_them(spark):
    guide = '<a href="/files/Nutrition.PDF?v=2">x</a><a href=\'allergens.pdf\'>y</a><a href="/files/Nutrition.PDF?v=2">again</a><a href="/map.pdf">m</a><a href="/nutrition.html">n</a>'
    rows = [(2, "https://www.a.com/food/menu?x=1", guide), (1, "https://a.com", "<a href='/menu'>none</a>"), (3, "https://a.com/other", '<a href="/nutrition-late.pdf">late</a>'),
            (4, "http://b.com", '<a href="//cdn.b.com/allergy.pdf#p2">z</a><a href="https://c.com/nutritional.pdf">w</a>'), (5, "no host", guide), (6, None, guide), (7, "https://d.com/", None)]
    got = probe.guide_links(spark.createDataFrame(rows, "page long, url string, html string"), "page").orderBy("site", "place").collect()
    assert [tuple(r) for r in got] == [("a.com", 2, 0, "https://www.a.com/files/Nutrition.PDF?v=2"), ("a.com", 2, 1, "https://www.a.com/food/allergens.pdf"),
                                       ("b.com", 4, 0, "http://cdn.b.com/allergy.pdf#p2"), ("b.com", 4, 1, "https://c.com/nutritional.pdf")]


def test_readable_guides(spark):
    files = spark.createDataFrame([(1, b"%PDF-1.7 rest"), (2, b"<html>"), (3, b""), (4, None), (5, b"%PD")], "id long, content binary")
    assert [r.id for r in probe.readable_guides(files).collect()] == [1]


def test_routes_by_first_open_page(spark):
    image = "".join(f'<img src="https://i.com/{n}.png?w=1">' for n in ("a", "a", "b", "site-logo"))
    rows = [(1, "https://wall.com/", "<title>Just a moment</title>"), (2, "https://wall.com/x", ""), (3, "https://opens.com/", "Access denied"), (4, "https://opens.com/m", f'"calories": 5 {image}'),
            (5, "https://gone.com", None), (6, "https://own.com", '<a href="/dish">d</a>'), (7, "https://shell.com", '<a href="/">home</a>'), (8, "https://api.com", "x" * 20000 + "/API/menu"), (9, "https://guide.com", '"kcal" <a href="/nutrition.pdf">')]
    got = {r.site: tuple(r)[1:] for r in probe.site_routes(spark.createDataFrame(rows, "page long, url string, html string"), "page").collect()}
    assert got == {"wall.com": (1, "blocked", 0, True), "opens.com": (4, "label", 2, True), "gone.com": (5, "unknown", 0, True), "own.com": (6, "linked", 0, True),
                   "shell.com": (7, "rendered", 0, True), "api.com": (8, "api", 0, False), "guide.com": (9, "guide", 0, True)}


def test_label_texts(spark):
    one = spark.range(1)
    sizes = {"Large": "L", "EXTRA LARGE": "XL", "Regular": "Reg", "16 oz": "16", "12.5 Oz": "12.5", "Grande": "Grande", "Big oz": "Big oz", "oz": "oz", "": ""}
    for label, want in sizes.items():
        assert one.select(labels.short_size(F.lit(label)).alias("x")).first().x == want, label
    texts = one.select(
        labels.amount(F.lit(1050.5), "mg").alias("a"), labels.amount(F.lit(0.5)).alias("b"), labels.fine_grams(F.lit(0.5)).alias("c"), labels.fine_grams(F.lit(2.0)).alias("d"),
        labels.difference(F.lit(-6.2), "g").alias("e"), labels.difference(F.lit(40.0)).alias("f"), labels.difference(F.lit(0.0)).alias("g"), labels.amount(F.lit(None).cast("double"), "g").alias("h"),
        labels.provenance(F.lit("table-2018"), F.lit("2018-01-01"), {"table": "The Table", "tab": "Tab"}).alias("i"), labels.provenance(F.lit("own.com"), F.lit("2024"), {"table": "x"}).alias("j"),
        labels.stale_notice(F.lit(False), F.lit("2018-01-01")).alias("k"), labels.stale_notice(F.lit(True), F.lit("2018-01-01")).alias("l")).first()
    assert tuple(texts)[:11] == ("1,050 mg", "0", "0.5 g", "2 g", "-6 g", "+40", "+0", None, "The Table · 2018", "own.com · 2024", None)
    assert texts.l.startswith("Published 2018. Chains")
    flags = one.select(F.array(F.lit("seasonal"), F.lit("kids"), F.lit("other")).alias("f")).select(labels.flag_titles(F.col("f")).alias("t"), labels.flag_notices(F.col("f")).alias("n")).first()
    assert flags.t == ["Kids meal", "Was a seasonal item"] and len(flags.n) == 1 and flags.n[0].startswith("This was")
