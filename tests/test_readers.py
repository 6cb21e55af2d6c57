"""Readers against plain Python over the same rows: guides, nearest lines, tiles, embedded JSON, streams, walks, sinks."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.operators import nearest, tiles, walk
from larder.sources import embedded, guides, packs, sinks

LINES = "guide string, line_no int, line string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Guides

LAYOUTS = {"plain": guides.Layout(("kcal", "sodium", "protein")), "tail": guides.Layout(("kcal", None, "protein"), serving_in_name=True), "heading": guides.Layout(("kcal", "sodium", "protein"), name_from_heading=True)}
TEXTS = ["SANDWICHES", "SALADS Values include bread", "Chicken Subs (Page 1 of 9)", "Soups (8 oz.)", "a note of small letters", "Ends with a stop.", "Page 3", "- 4 -", "", "  ", "Small", "BLT", "Steak Philly**",
         "Classic Italian - with capicola", "Bowl of Joy", "1 Bowl", "1/2 Stuffer", "Cole Slaw 12", "x" * 60]
NAMES = ["Small", "Large (two)", "Kids", "Bacon - Egg", "Soup - with egg", "BLT*", "Bagel 1 Bagel", "1 Bowl", "Nuggets Approx 8", "Tea N/A", "", "Café 2%"]


def guide_reader(texts, layout):
    """One pass with a state: a plain reading of the rules."""
    state = {"outer": None, "group": None, "before": None, "last": None}
    out = []
    strip = lambda t: t.strip().rstrip(guides.FOOTNOTES)
    for number, text in texts:
        if not text or not text.strip():
            continue
        pulled = None
        if layout.serving_in_name and (m := re.search(rf"(?i)\s+({guides.WORD_FIRST})(?=\s+[0-9])", text)):
            text, pulled = text[:m.start()] + text[m.end():], m[1].strip()
        tokens = text.split()
        while tokens and not tokens[-1].strip(guides.FLAG_SIGNS.replace("\\", "")):
            tokens.pop()
        size = next((i for i, t in enumerate(reversed(tokens)) if not re.fullmatch(guides.VALUE, t)), len(tokens))
        name = " ".join(tokens[:len(tokens) - size]).strip().rstrip(guides.FOOTNOTES)
        if size < len(layout.columns) or not name:
            if re.search(guides.PAGE_MARK, text.strip()):
                continue
            state["last"] = re.sub(guides.PAGE_OF, "", text.strip())
            cut = strip(re.sub(guides.EXPLANATION, "", text.strip()))
            letters = [c for c in cut if c.isalpha()]
            inner = strip(re.sub(guides.PARENTHESIS, "", re.sub(guides.EXPLANATION, "", text.strip())))
            if cut and len(cut) <= 48 and len(letters) >= 4 and all(c.isupper() for c in letters):
                state["outer"] = cut
            elif inner and len(inner) <= 48 and inner[-1] not in ".:," and inner[0].isupper():
                state["before"], state["group"] = state["group"], re.sub(guides.PAGE_OF, "", inner)
            continue
        serving, tail = pulled, re.search(rf"\s+({guides.SERVING})$", name)
        if not pulled and layout.serving_in_name and tail:
            serving, name = tail[1], name[:tail.start()].strip() or name
        elif not pulled and state["last"] and (layout.name_from_heading or re.search(guides.SIZE_ONLY, name) or layout.serving_in_name and re.fullmatch(guides.SERVING, name)):
            serving, name = name, state["last"]
            if state["group"] == state["last"]:
                state["group"] = state["before"]
        cells = tokens[len(tokens) - size:][:len(layout.columns)]
        number_of = lambda c: float(c.replace(",", ".")) if re.fullmatch(r"[0-9]+([.,][0-9]+)?", c) else None
        told = re.match(guides.DESCRIPTION, name)
        out.append(("g", number, told[1].strip() if told else name, serving, state["outer"], state["group"], *[number_of(c) for c, f in zip(cells, layout.columns, strict=True) if f]))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", sorted(LAYOUTS))
def test_guide_lines_equal_a_sequential_reading(spark, kind):
    rng = random.Random(kind)
    cell = lambda: rng.choice(["10", "<1", "-", "N/A", "1,5", "220", "3.5"])
    texts = [(i, rng.choice(TEXTS) if rng.random() < 0.45 else f"{rng.choice(NAMES)}  {' '.join(cell() for _ in range(rng.randint(2, 4)))}{rng.choice(['', ' X #', ' •'])}") for i in range(400)]
    lines = spark.createDataFrame([("g", *t) for t in texts] + [("g", 900, None), (None, 1, "Tea 1 2 3"), ("g", None, "Tea 1 2 3")], LINES).repartition(3)
    assert rows(guides.parse(lines, LAYOUTS[kind])) == guide_reader(texts, LAYOUTS[kind])
    assert guides.parse(lines.limit(0), LAYOUTS[kind]).collect() == []


def test_guide_lines_are_read_once(spark):
    lines = spark.createDataFrame([("g", 0, "BURGERS"), ("g", 1, "Plain Bun 100 2 3"), ("g", 2, "3")], LINES)
    found = guides.parse(lines, LAYOUTS["plain"])
    assert guides.VALUE not in found._jdf.queryExecution().optimizedPlan().toString()  # cells were cut again in every reader of the result
    assert [(r.name, r.section, r.kcal) for r in found.collect()] == [("Plain Bun", "BURGERS", 100.0)]


def test_deferred_names_give_their_group_back(spark):
    texts = ["SLIDERS", "Sides", "Onion Rings", "Small 100 5 1", "Medium 200 9 2", "Fries 300 9 3", "Drinks", "Tea 5 5 0", "Small 6 5 0"]
    got = guides.parse(spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], LINES), LAYOUTS["plain"]).orderBy("line_no").collect()
    assert [(r.name, r.serving, r.category) for r in got] == [("Onion Rings", "Small", "Sides"), ("Onion Rings", "Medium", "Sides"), ("Fries", None, "Sides"), ("Tea", None, "Drinks"), ("Drinks", "Small", "Sides")]


def test_checks_and_names_told_apart(spark):
    kinds = "guide string, line_no int, name string, serving string, section string, category string, kcal double, sodium double, protein double, carbs double, fat double"
    row = lambda g, i, name, serving, section, category, kcal=100.0, sodium=300.0: (g, i, name, serving, section, category, kcal, sodium, 10.0, 15.0, 0.0)
    made = [row("a", 1, "Steak", None, "WRAPS", "Hot"), row("a", 2, "Steak", None, "GRAB-N-GO", "Hot"), row("a", 3, "Soup", "Cup", "X", "Y"), row("a", 4, "Soup", "Bowl", "X", "Y", 101.0), row("a", 5, "Soup", "Bowl", "X", "Y", 101.0),
            *[row("a", 10 + i, f"Dish {i}", None, None, None) for i in range(20)], row("a", 40, "Same", None, None, None, 99.0), row("a", 41, "Same", None, None, None, 98.0),
            row("b", 1, "Tea", None, None, None, sodium=1.0), row("c", 1, "Tea", None, None, None, 500.0), row("d", 1, "A", None, None, None, 1.0), row("e", 1, "A", None, None, None, None, None)]
    items = spark.createDataFrame(made, kinds)
    assert {r.guide: r.reason for r in guides.checks(items).collect()} == {"a": None, "b": "salt, not sodium", "c": "columns shifted", "d": "no macros", "e": "no sodium"}
    told = {r.qualified: r.held for r in guides.qualified(items.where("guide = 'a'")).collect()}
    assert set(told) >= {"Steak, Wraps", "Steak, Grab-N-Go", "Soup, X (Y), Cup", "Soup, X (Y), Bowl"} and "Same" not in told and len(told) == 24 and not any(told.values())
    few = guides.qualified(items.where("guide = 'a' and line_no in (1, 3, 40, 41)")).collect()
    assert len(few) == 2 and all(r.held for r in few)


def test_placed_lines_take_the_nearest_cells(spark):
    page = [(1, 10.0, 20.0, "SALADS"), (2, 40.0, 20.0, "Greens"), (3, 71.0, 20.0, "Catering Asian Chicken -"), (4, 80.0, 257.0, "1 Container 1260 640 71"), (5, 86.0, 20.0, "serves 5"),
            (6, 100.0, 20.0, "Whole Row 1 2 3"), (7, 120.0, 20.0, "Half way"), (8, 112.0, 257.0, "1 Cup 9 8 7"), (9, 128.0, 257.0, "2 Cups 6 5 4"), (10, 200.0, 20.0, "Page 2")]
    lines = spark.createDataFrame([("g", 1, *p) for p in page] + [("g", 2, 1, 50.0, 257.0, "1 Bowl 3 2 1"), ("g", 2, 2, 45.0, 20.0, "Soup")], "guide string, page int, line_no int, top double, x0 double, line string")
    got = {(r.page, r.line_no): (r.name, r.serving, r.section, r.category) for r in guides.parse_positioned(lines, LAYOUTS["tail"]).collect()}
    assert got == {(1, 4): ("Catering Asian Chicken - serves 5", "1 Container", "SALADS", "Greens"), (1, 6): ("Whole Row", None, "SALADS", "Greens"), (1, 8): ("Half way", "1 Cup", "SALADS", "Greens"),
                   (1, 9): ("2 Cups", None, "SALADS", "Greens"), (2, 1): ("Soup", "1 Bowl", "SALADS", "Greens")}


# Nearest rows

@pytest.mark.parametrize("tolerance", [0.0, 1.0, 2.5])
def test_nearest_equals_all_pairs(spark, tolerance):
    rng = random.Random(11)
    spots = lambda n: [(rng.choice("ab"), i, rng.choice([float(rng.randint(-20, 20)), rng.uniform(-20, 20)])) for i in range(n)]
    left, right = spots(200), [(k, i % 40, x) for k, i, x in spots(90)]
    odd = [(None, 900, 1.0), ("a", 901, None), ("a", 902, float("nan"))]
    got = {r.i: r.near and tuple(r.near) for r in nearest.nearest(spark.createDataFrame(left + odd, "k string, i int, x double"), spark.createDataFrame(right + odd, "k string, j int, y double"), ["k"], "x", "y", "j", tolerance).collect()}
    assert len(got) == 203 and got[900] is got[901] is got[902] is None
    for k, i, x in left:
        near = sorted((abs(y - x), y, j) for c, j, y in right if c == k and abs(y - x) <= tolerance)
        assert got[i] == (near[0] if near else None)


def test_nearest_with_one_place_for_all(spark):
    left = spark.range(2000).selectExpr("'a' AS k", "id AS i", "5.0D AS x")
    right = spark.range(500).selectExpr("'a' AS k", "id AS j", "6.0D AS y")
    found = nearest.nearest(left, right, ["k"], "x", "y", "j", 1.0)
    assert found.count() == 2000 and found.select("near.tie").distinct().collect()[0].tie == 0
    assert nearest.nearest(left, right.limit(0), ["k"], "x", "y", "j", 1.0).where("near is null").count() == 2000


# Tiles

def tile_words(name, tile):
    text = name.lower()
    text = re.sub(rf"\b(?:{tiles.TILE_JUNK})\b", " ", text) if tile else text
    text = re.sub(rf"\b(?:{tiles.PORTIONS})\b", " ", re.sub("[^a-z0-9 ]+", " ", text))
    return [w for w in re.sub(rf"\b(?:{tiles.BRANDS})\b", " ", text).split() if len(w) > 1]


def tile_score(own, shown):
    a, b = tile_words(own, False), tile_words(shown, True)
    flags = [{t for t in tiles.TELLING if t in "".join(w) + ("chicken" if "nugget" in "".join(w) else "")} for w in (a, b)]
    if flags[0] != flags[1] or not a or not b:
        return 0.0
    like = max(difflib.SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio(), difflib.SequenceMatcher(None, "".join(a), "".join(b)).ratio())
    if like >= tiles.LIKE:
        return like
    inside = [len("".join(s)) / len("".join(t)) for s, t in ((a, b), (b, a)) if re.search(".*?".join(map(re.escape, s)), "".join(t))]
    best = max(inside, default=0.0)
    return best * tiles.LIKE if best >= tiles.INSIDE else 0.0


def test_tiles_equal_all_pairs(spark):
    own = ["10 Chicken McNuggets", "McChicken", "McDouble", "Sausage Egg McMuffin", "Sausage McMuffin", "Sweet Tea", "Unsweet Tea", "Dasani Water", "Sprite", "Sprite Berry Blast", "Fruit & Maple Oatmeal", "Hot Fudge Sundae, Large",
           "Strawberry Shake", "McCafe Strawberry Shake", "Café Latte w/ Ice", "Small", "", "Cheeseburger", "Hamburger", None]
    shown = ["10 Mc Nuggets", "Mc Chicken", "Mc Double", "Sausage Egg Mc Muffin hero", "Dasani Bottled Water", "Sweet Tea glass", "Sprite", "Oatmeal Fruit", "HotFudgeSundae", "Strawberry Shakes", "Hamburger front", "Cheese Burger", "Hero", "Sprite", None]
    catalog = spark.createDataFrame([(c, f"k{i}", n) for c in "AB" for i, n in enumerate(own)] + [(None, "z", "Sprite")], "chain string, ext_key string, name string")
    shots = spark.createDataFrame([("A", f"t{i}", i, n) for i, n in enumerate(shown)], "chain string, tile_key string, place int, name string")
    want = {}
    for i, a in enumerate(own):
        scores = [(-tile_score(a, b), j) for j, b in enumerate(shown) if a and b and tile_score(a, b) > 0]
        if scores:
            want[f"k{i}"] = (f"t{min(scores)[1]}", -min(scores)[0])
    got = {r.ext_key: (r.tile_key, r.score) for r in tiles.match_tiles(catalog, shots).collect()}
    assert got == want and got["k0"][0] == "t0" and got["k5"][0] == "t5" and "k4" not in got and len(got) > 9
    assert tiles.match_tiles(catalog, shots.limit(0)).collect() == []


# Embedded JSON and streams

def test_ladder_takes_the_first_that_knows(spark):
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Soup &amp; Co","nutrition":{"calories":"120 kcal"}}]}</script>'
    state = '<script id="__NEXT_DATA__">{"a":{"calories":6700205},"b":[{"calories":"90","Total-Fat":"3g","allergens":" milk "}],"c":{"sodium":5}}</script>'
    wp = """<div data-wp-context='{"nutrition":[{"key":"protein","value":"7g"},{"label":"Sugars","amount":2}]}'>"""
    deep = '<script id="__NEXT_DATA__">' + '{"a":[' * 300 + '{"protein":1,"fat":2}' + "]}" * 300 + "</script>"
    pages = [(1, ld + state + wp + '<meta property="og:title" content="Other | Site"><meta property="og:image" content="i.png">'), (2, '<script id="__NEXT_DATA__">{"calories":90}</script>'), (3, None), (4, ""),
             (5, '<script id="__NEXT_DATA__">{"cut":'), (6, deep), (7, '"nutrition": [{"name":"Calories","value":50},{"name":"fat","value":-1},{"name":"Fat","value":4}]')]
    got = {r.page_id: r for r in embedded.page_ladder(spark.createDataFrame(pages, "page_id int, html string").withColumn("name", F.lit("clash"))).collect()}
    one = got[1]
    assert (one.name, one.photo, one.kcal, one.fat, one.allergens, one.protein, one.sugar, one.sodium, one.shapes) == ("Soup & Co", "i.png", 120.0, 3.0, "milk", 7.0, 2.0, None, "json-ld,embedded-json,open-graph")
    assert all(got[i].shapes == "" and got[i].kcal is None for i in (2, 3, 4, 5))
    assert (got[6].protein, got[6].fat) == (1.0, 2.0) and (got[7].kcal, got[7].fat) == (50.0, 4.0)


def test_objects_and_labels_of_streams(spark):
    push = lambda s: f'self.__next_f.push([1,{json.dumps(s)}])'
    text = '0:["$",{"a":"} \\" {","hit":1,"b":{"hit":2}}]\n1:{"hit":3,"c":{'
    assert embedded.marked_objects(text, '"hit"') == [{"a": '} " {', "hit": 1, "b": {"hit": 2}}, {"hit": 2}]
    assert embedded.objects('{"a":1}\n"{\n{}') == [(0, 7), (11, 13)] and embedded.objects("") == [] == embedded.objects("}}{")
    many = '{"a":"x{y"}' * 20000
    assert len(embedded.objects(many)) == 20000
    a, b = '{"name":"Bagel","nutrition":{"calories":"340 calories","fatContent":"5g"}}', '{"name":"Roll","nutrition":{"calories":"1 calories"}}'
    page = push("1:[" + a[:40]) + push(a[40:] + "," + b[:-2]) + push(b[-2:] + "]\n")
    assert embedded.stream(page).startswith('1:[{"name":"Bagel"') and embedded.label(page, "roll ") == {"kcal": 1.0} and embedded.label(page, None) == {"kcal": 340.0, "fat": 5.0}
    assert embedded.label(page, "Bun") == {} == embedded.label(page[:90], "Bagel")
    got = spark.createDataFrame([(1, page, "BAGEL"), (2, None, "x"), (3, page, None), (4, "", "")], "i int, html string, name string").select("i", embedded.stream_label("html", "name").alias("l")).orderBy("i").collect()
    assert [(r.l.kcal, r.l.fat) for r in got] == [(340.0, 5.0), (None, None), (340.0, 5.0), (None, None)]


# Walks and sinks

def test_walk_equals_a_queue(spark):
    rng = random.Random(2)
    links = [(s, rng.randint(0, 60), rng.randint(0, 60)) for s in "ab" for _ in range(150)] + [("a", 1, 1), ("a", None, 2), (None, 1, 2)]
    items = {(s, p) for s in "ab" for p in range(0, 61, 5)}
    frames = spark.createDataFrame([("a", 1), ("b", 5), ("b", 5)], "k string, page int"), spark.createDataFrame(links, "k string, page int, target int"), spark.createDataFrame(sorted(items), "k string, page int")
    for depth in (1, 2, 9):
        want = set()
        for site, start in (("a", 1), ("b", 5)):
            seen, queue = {start}, [(start, 0)]
            while queue:
                page, d = queue.pop(0)
                if d:
                    want.add((site, page, d, (site, page) in items))
                if d < depth and (d == 0 or (site, page) not in items):
                    for s, p, t in links:
                        if s == site and p == page and t is not None and t not in seen:
                            seen.add(t)
                            queue.append((t, d + 1))
        assert {tuple(r) for r in walk.walk(*frames, ["k"], depth).collect()} == want
    assert walk.walk(frames[0], frames[1].limit(0), frames[2], ["k"]).collect() == []


def test_sources_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "items")
    make = lambda *r: spark.createDataFrame(r, "k int, source string")
    sinks.replace_by_source(make((1, "seed"), (2, "seed"), (3, "site")), path)
    for _ in range(2):
        sinks.replace_by_source(make((9, "seed"), (None, "seed")), path)
        assert rows(spark.read.parquet(path).select("k", "source")) == rows(make((9, "seed"), (None, "seed"), (3, "site")))
    sinks.replace_by_source(make((1, "x")).limit(0), path)
    assert spark.read.parquet(path).count() == 3


def test_damaged_packs_are_set_apart_as_a_whole(spark):
    make = lambda version, *names: packs.build_packs(spark.createDataFrame([("A", n, n, 1.0) for n in names], "chain string, key string, name string, kcal double"), version).first()
    old, new = make(1, "Soup"), make(2, "Soup", "Tea")
    kinds = "chain string, origin string, sha256 string, deflated binary"
    row = lambda chain, origin, pack, **other: (chain, origin, other.get("sha256", pack.sha256), other.get("deflated", pack.deflated))
    given = [row("new", "seed", old), row("new", "download", new), row("tie", "seed", new), row("tie", "download", new), row("bad", "seed", old), row("bad", "download", new, sha256="0"),
             row("cut", "seed", old), row("cut", "download", new, deflated=bytearray(b"xx")), row("none", "download", new, deflated=None), row("none", "seed", old, sha256=None), row("older", "seed", new), row("older", "download", old)]
    got = {r.chain: (r.origin, r.version, len(r["items"] or []), r.damaged) for r in packs.best_of(spark.createDataFrame(given, kinds)).collect()}
    assert got == {"new": ("download", 2, 2, ""), "tie": ("seed", 2, 2, ""), "bad": ("seed", 1, 1, "download"), "cut": ("seed", 1, 1, "download"), "none": (None, None, 0, "download,seed"), "older": ("seed", 2, 2, "")}
    assert packs.best_of(spark.createDataFrame([], kinds)).collect() == []
