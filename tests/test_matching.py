"""Similarity join and assignment by rounds against plain Python, ties, hot names, long names and empty sides."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import assignment, matching, similar

ROWS = "chain string, ext_key string, name string"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def formed(df):
    return [(r.chain, r.x_key, r.x_form, r.portion) for r in matching._formed(df, "x").collect()]


def brute_assignment(live, stored, least):
    """All pairs, best first; each side is used once."""
    pairs = [(ratio(a, b), x == y, x, y, c) for c, x, a, p in live for d, y, b, q in stored if c == d and p == q]
    left, right, out = set(), set(), set()
    for r, _, x, y, c in sorted((p for p in pairs if p[0] >= least), reverse=True):
        if (c, x) not in left and (c, y) not in right:
            left.add((c, x))
            right.add((c, y))
            out.add((c, x, y, r))
    return out


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14))) for _ in range(160)]
    words += [w + rng.choice("abc") for w in words[:40]] + ["x" * 300, "x" * 299 + "y", "é漢", "é漢字"]
    left = spark.createDataFrame([("k" + str(i % 2), w) for i, w in enumerate(words)] + [("k0", None), (None, "abc")], "k string, f string")
    right = spark.createDataFrame([("k" + str(i % 2), w) for i, w in enumerate(words[::-1])], "k string, g string")
    for least in (0.82, 0.75, 0.5, 1e-6):
        got = {(r.k, r.f, r.g): r.ratio for r in similar.similar_pairs(left, right, ["k"], "f", "g", least).collect()}
        rows = {(a.k, a.f) for a in left.collect() if a.k and a.f is not None}, {(b.k, b.g) for b in right.collect()}
        want = {(k, a, b): ratio(a, b) for k, a in rows[0] for j, b in rows[1] if j == k and ratio(a, b) >= least}
        assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_greedy_rule_on_ties(spark, seed):
    rng = random.Random(seed)
    pool = ["soup", "soap", "soups", "coup", "cola", "cole", "mile", "milk", "silk", "sol a", "bun", "bin", "ban", ""]
    make = lambda n, tag: [("AB"[i % 2], rng.choice(("", tag)) + str(i), rng.choice(pool) + rng.choice(("", " small", " 2"))) for i in range(n)]
    live, stored = spark.createDataFrame(make(90, "x"), ROWS), spark.createDataFrame(make(80, "s"), ROWS)
    got = {(r.chain, r.live_key, r.stored_key, r.ratio) for r in matching.assign(live, stored, 0.6).collect()}
    assert got == brute_assignment(formed(live), formed(stored), 0.6)


def test_hot_forms_long_names_nulls_and_empty_sides(spark):
    hot = [("A", f"h{i:04}", "Plain Pizza") for i in range(3000)]
    long = "word " * 8000
    odd = [("A", "l", long), ("A", "m", long + "end"), (None, "n", "Tea"), ("A", None, "Tea"), ("A", "o", None), ("B", "only", "Tea"), ("A", "p", ""), ("A", "q", "Large")]
    live = spark.createDataFrame([*hot, *odd, ("A", "h0001", "Plain Pizza"), ("A", "z", "Plain Pizzas")], ROWS)
    stored = spark.createDataFrame([*hot[:1000], ("A", "y", "Plain Pizzas"), ("A", "l2", long), ("C", "only", "Tea"), ("A", "q2", "Large")], ROWS)
    got = {(r.live_key, r.stored_key): r.ratio for r in matching.assign(live, stored).collect()}
    assert len(got) == 1003 and all(got[f"h{i:04}", f"h{i:04}"] == 1.0 for i in range(1000))
    assert got["l", "l2"] == got["z", "y"] == got["q", "q2"] == 1.0
    assert matching.assign(live.limit(0), stored).collect() == [] == matching.assign(live, stored.limit(0)).collect()
    best = {(r.chain, r.live_key): (r.stored_key, r.ratio) for r in matching.best_ratios(live.where("ext_key in ('only', 'o', 'z')"), stored).collect()}
    assert best["A", "z"] == ("y", 1.0) and best["B", "only"] == best["A", "o"] == (None, None)


def test_numbers_count_down_in_each_group(spark):
    rows = spark.createDataFrame([(g, f"{k:03}") for g in "abc" for k in range(50 * (ord(g) - 96))], "g string, k string").repartition(7)
    got = {(r.g, r.k): r.n for r in assignment.numbered(rows, ["g"], "k", "n").collect()}
    assert got == {(g, f"{k:03}"): 50 * (ord(g) - 96) - 1 - k for g in "abc" for k in range(50 * (ord(g) - 96))}


def test_registered_assignment_and_best_ratios_equal_brute_force(spark, sf_dir):
    from larder.plans.fuzzy_plans import _named

    live, stored = (df.where("chain in ('Brand#11', 'Brand#12')") for df in _named(spark, sf_dir))
    own, other = formed(live), formed(stored)
    got = {(r.chain, r.live_key, r.stored_key, r.ratio) for r in matching.assign(live, stored).collect()}
    assert got == brute_assignment(own, other, matching.MATCH) and got
    best = {(r.chain, r.live_key): (r.stored_key, r.ratio) for r in matching.best_ratios(live, stored).collect()}
    assert len(best) == len(own) > 10
    for chain, key, form, _ in own:
        low, stored_key = min((-ratio(form, b), y) for c, y, b, _ in other if c == chain)
        assert best[chain, key] == (stored_key, -low)


def test_nearest_names_far_off(spark):
    live = spark.createDataFrame([("A", "1", "Beef Taco"), ("A", "2", "Zzz"), ("A", "3", "Iced Latte")], ROWS)
    stored = spark.createDataFrame([("A", "a", "Tomato Soup"), ("A", "b", "Apple Pie"), ("A", "c", "Ice Latte")], ROWS)
    got = {r.live_key: (r.stored_key, r.ratio) for r in matching.best_ratios(live, stored).collect()}
    for key, form in (("1", "beef taco"), ("2", "zzz"), ("3", "iced latte")):
        want = min((-ratio(form, b), k) for k, b in (("a", "soup tomato"), ("b", "apple pie"), ("c", "ice latte")))
        assert got[key] == (want[1], -want[0])
    assert got["2"] == ("a", 0.0)
    assert live.select(F.lit(1)).count() == 3


def test_photo_pairs_compare_equal_names_once(spark, monkeypatch):
    """Forty rows and forty shots of one name are one pair; a key of two names takes the better one, ties the first shot."""
    seen = spark.sparkContext.accumulator(0)
    plain = matching.ratio.func

    @F.pandas_udf("double")
    def counted(left: pd.Series, right: pd.Series) -> pd.Series:
        seen.add(len(left))
        return next(plain(iter([(left, right)])))

    monkeypatch.setattr(matching, "ratio", counted)
    stored = [("a", f"k{i}", "Club Melt, Small") for i in range(40)] + [("a", "k0", "Pea Soup"), ("a", "n", "Tomato Sop"), ("a", None, "Club Melt"), (None, "k", "Club Melt"), ("a", "z", None)]
    shots = [("a", f"s{i:02}", "Melt Club") for i in range(40)] + [("a", "t", "Tomato Soup"), ("a", "u", "Club Melt, Small"), ("a", "p", "Pea Soup")]
    got = matching.photo_pairs(spark.createDataFrame(stored, "chain string, ext_key string, name string"), spark.createDataFrame(shots, "chain string, shot_key string, name string"))
    found = {(r.ext_key, r.shot_key) for r in got.where("ext_key is not null").collect()}
    assert found == {(f"k{i}", "u") for i in range(1, 40)} | {("k0", "p"), ("n", "t")}
    assert 0 < seen.value < 20


def test_assignment_sends_no_side_through_the_driver(spark):
    own = spark.range(60).select(F.lit("g").alias("chain"), (F.col("id") % 3).alias("form"), F.format_string("k%02d", "id").alias("live_key"))
    other = spark.range(40).select(F.lit("g").alias("chain"), (F.col("id") % 3).alias("form"), F.format_string("k%02d", F.col("id") + 30).alias("stored_key"))
    found = assignment.zipped(own, other, ["chain", "form"])
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()  # small sides were broadcast before
    assert found.count() == 40 and found.where("live_key = stored_key").count() == 30
