"""Edge cases of upkeep operators: nulls, ties, empty tables and repeated changes."""

from pyspark.sql import functions as F

from larder.operators import upkeep as u
from larder.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_takes_the_last_change_and_keeps_the_rest(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, None, 0), (None, "n", 0)], "k int, v string, t int")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "p", 1), (3, "q", 1), (None, "m", 1)], "k int, v string, t int")
    assert rows(u.upsert(target, changes, ["k"], "t")) == rows(spark.createDataFrame(
        [(1, "a", 0), (2, "y", 2), (3, "q", 1), (None, "n", 0), (None, "m", 1)], "k int, v string, t int"))
    assert rows(u.upsert(target, changes.limit(0), ["k"], "t")) == rows(target)
    assert rows(u.upsert(target.limit(0), changes.where("k = 2"), ["k"], "t")) == [(2, "y", 2)]


def test_update_sets_nulls_and_leaves_unmatched_rows(spark):
    target = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (None, "c", 9)], "k int, v string, w int")
    changes = spark.createDataFrame([(1, None), (None, "z")], "k int, v string")
    assert rows(u.update_from(target, changes, ["k"])) == rows(spark.createDataFrame([(1, None, 9), (2, "b", 9), (None, "c", 9)], "k int, v string, w int"))


def test_overlay_prefers_the_right_side(spark):
    left = spark.createDataFrame([(1, "l"), (2, "l"), (None, "l")], "k int, v string")
    right = spark.createDataFrame([(2, None), (3, "r"), (None, "r")], "k int, v string")
    assert rows(u.overlay(left, right, ["k"])) == [(1, "l"), (2, None), (3, "r"), (None, "r")]


def test_counts_versions_and_outcomes_without_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.createDataFrame([(1, 4), (1, None), (7, 1)], "k int, v int")
    assert rows(u.with_child_counts(parents, children, "k", "n")) == [(1, 2), (2, 0)]
    assert rows(u.next_versions(parents, children, "k", "v")) == [(1, 5), (2, 1)]
    offered = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, d string")
    released = spark.createDataFrame([(1, "a"), (2, "z")], "k int, d string")
    assert rows(u.release_outcomes(released, offered, ["k"], "d")) == [(1, "same"), (2, "conflict"), (3, "new")]


def test_regressions_look_at_the_last_two_runs(spark):
    runs = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False), (3, 1, True), (3, 2, True)], "k int, t int, ok boolean")
    assert rows(u.regressions(runs, "k", "t", "ok")) == [(1, False, True), (2, False, False), (3, True, False)]


def test_clashes_count_repeats_and_known_keys(spark):
    adopted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,), (None,)], "k string")
    catalog = spark.createDataFrame([("b",), ("b",), (None,)], "k string")
    assert rows(u.clashes(adopted, catalog, ["k"])) == [("a", 2, False), ("b", 1, True)]


def test_shares_and_covered_words(spark):
    one = spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (None, 1.0, 1.0)], "p double, c double, f double")
    share = u.macro_share(F.col("p"), 4, F.col("p"), F.col("c"), F.col("f"))
    assert [r[0] for r in one.select(share).collect()] == [0.0, 1.0, 0.0]
    words = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "c"]), (["a"], [])], "w array<string>, o array<string>")
    assert [r[0] for r in words.select(u.covers(F.col("w"), F.col("o"))).collect()] == [True, False, True]


def test_variant_photo_and_outcomes(spark):
    items = spark.createDataFrame([("g", 1, None), ("g", 2, "x"), ("g", 3, "y"), ("h", 4, None), (None, 5, "z")], "g string, i int, photo string")
    assert [tuple(r) for r in u.variant_photo(items, ["g"], "i", "photo").select("i", "photo").orderBy("i").collect()] == [(1, "x"), (2, "x"), (3, "y"), (4, None), (5, "z")]
    answers = spark.createDataFrame([(1, 1, "v"), (1, 1, "v"), (1, 2, "w"), (2, None, "v"), (None, None, "v")], "a int, m int, v string")
    assert rows(u.answer_outcomes(answers, "a", "m", "v")) == rows(spark.createDataFrame(
        [(1, 3, 2, 1, 1), (2, 1, 0, 0, 0), (None, 1, 0, 0, 0)], "a int, n long, s long, u long, r long"))


def test_clashing_crawls_are_held_and_recorded_once(spark, tmp_path):
    adopted = spark.createDataFrame([("A", k, i) for i, k in enumerate("hgfedcbaabcdefgh")] + [("B", "new", 1), ("B", None, 2), ("C", "old", 1), (None, "x", 1)], "chain string, ext_key string, v int")
    catalog = spark.createDataFrame([("C", "old", 1), ("B", "other", 1), ("A", "h", 1)], "chain string, ext_key string, found int")
    crawls = spark.createDataFrame([("A", 16, 1, 0), ("B", 2, 0, 0), ("C", 1, 0, 3), ("D", 0, 0, 0)], "chain string, found int, changed int, dropped int")
    log, stored = u.crawl_log(crawls, adopted, catalog)
    found = {r.chain: (r.adopted, r.status, r.notes) for r in log.collect()}
    assert found == {"A": (0, "held", "each other: a, b, c, d, e, f; catalog: h"), "B": (2, "ok", ""), "C": (0, "held", "catalog: old"), "D": (0, "ok", "")}
    assert sorted((r.chain or "", r.v) for r in stored.collect()) == [("", 1), ("B", 1), ("B", 2)]
    path = str(tmp_path / "log")
    for day, rows in (("2026-01-01", log), ("2026-01-02", log.where("chain = 'A'")), ("2026-01-01", log.where("chain <> 'D'")), ("2026-01-03", log.limit(0))):
        sinks.record_crawls(rows, path, day)
    assert sorted((str(r.observed), r.chain, r.status) for r in spark.read.parquet(path).collect()) == [("2026-01-01", "A", "held"), ("2026-01-01", "B", "ok"), ("2026-01-01", "C", "held"), ("2026-01-01", "D", "ok"), ("2026-01-02", "A", "held")]
