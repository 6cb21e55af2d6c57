"""Pictures' tiles to catalog names: equal sets of telling words, then likeness or ordered containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.checkpoints import cut
from larder.operators.similar import similar_pairs

# Words of tiles, portions and brands that name no dish; words that make another dish; least scores.
TILE_JUNK = r"evm|hb|hl|v\s?[0-9]|no bag|potato bun|glass|cup|bag|alt|protein|shredded|with can|light|upright|front|side|angle|hero|closeup|top|open|stacked|standing|pile|half slice|contour|category|header|left rail|pcp|meal deal|bundle"
PORTIONS = r"small|medium|large|kids?|jr|extra small|child|snack size|mini|[0-9]+\s*(?:oz|pc|piece|ct)?"
BRANDS = r"chick fil a|chickfila|mcdonalds|mccafe|mcvalue"
TELLING = ("steak", "bacon", "sausage", "chicken", "fish", "turkey", "spicy", "deluxe", "double", "triple", "grilled", "crispy", "diet", "zero", "frozen", "egg", "cheese")
IMPLIED = {"nugget": "chicken"}
LIKE, INSIDE = 0.86, 0.5


def photo_words(name: Column, tile: bool = False) -> Column:
    """Words of two signs or more, without portions and brands, and of a tile without words of the shot."""
    text = F.lower(name)
    if tile:
        text = F.regexp_replace(text, rf"(?iU)\b(?:{TILE_JUNK})\b", " ")
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]+", " "), rf"\b(?:{PORTIONS})\b", " ")
    return F.filter(F.split(F.regexp_replace(text, rf"\b(?:{BRANDS})\b", " "), " +"), lambda w: F.length(w) > 1)


def telling(words: Column) -> Column:
    """The telling words in the joined letters, with those that a word implies; equal sets give equal texts."""
    letters = F.array_join(words, "")
    for token, implied in IMPLIED.items():
        letters = F.when(F.contains(letters, F.lit(token)), F.concat(letters, F.lit(implied))).otherwise(letters)
    return F.array_join(F.array_compact(F.array(*[F.when(F.contains(letters, F.lit(w)), F.lit(w)) for w in TELLING])), ",")


def contained(words: Column, letters: Column) -> Column:
    """Whether all words stand in the letters, one after the other."""
    def step(at: Column, word: Column) -> Column:
        found = F.call_function("locate", word, letters, at)
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(word))

    return F.aggregate(words, F.lit(1), step) > 0


def _forms(rows: DataFrame, side: str) -> DataFrame:
    return cut(rows.where(F.size("words") > 0).select("chain", telling(F.col("words")).alias("telling"), F.col("words").alias(f"{side}_words"), F.array_join(F.array_sort("words"), " ").alias(f"{side}_key"),
                    F.array_join("words", "").alias(f"{side}_letters")).distinct()).withColumn(f"{side}_id", F.monotonically_increasing_id())


def _grams(letters: Column, n: int) -> Column:
    return F.when(F.length(letters) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(letters) - n + 1), lambda i: F.substring(letters, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _inside(short: DataFrame, long: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose ``short`` words lie in the ``long`` letters in order, and which share of them they are.

    All words of the short side must be in the long one, so one of them is enough to look it up: the
    first signs of the longest, which the long side offers among all its runs of that length.
    """
    longest = F.array_max(F.transform(f"{a}_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = short.select("chain", "telling", f"{a}_id", F.substring(longest, 1, 3).alias("gram"))
    offered = long.select("chain", "telling", f"{b}_id", F.explode(F.concat(_grams(F.col(f"{b}_letters"), 2), _grams(F.col(f"{b}_letters"), 3))).alias("gram"))
    met = asked.join(offered.hint("merge"), ["chain", "telling", "gram"]).select(f"{a}_id", f"{b}_id")  # a row's runs are more than plans reckon with
    pairs = met.join(short, f"{a}_id").join(long.drop("chain", "telling"), f"{b}_id")
    share = F.length(f"{a}_letters") / F.length(f"{b}_letters")
    fits = pairs.where((share <= 1) & (share >= INSIDE)).where(contained(F.col(f"{a}_words"), F.col(f"{b}_letters")))
    return fits.select("chain", "telling", "own_words", "tile_words", (share * LIKE).alias("score"))


def match_tiles(catalog: DataFrame, tiles: DataFrame) -> DataFrame:
    """chain, ext_key, tile_key and score: each item's best tile of its chain; a tile may serve many items.

    ``catalog`` has chain, ext_key, name; ``tiles`` chain, tile_key, place, name. Only names of equal
    telling words can match. The score is the ratio by sorted words or by letters, the greater one, where
    it is ``LIKE`` or more; else ``LIKE`` times the share of a name that contains the other in order, at
    least half. Ties go to the first place. Names without words and nulls match nothing.
    """
    rows = cut(catalog.dropna(subset=["chain", "name"]).select("chain", "ext_key", photo_words(F.col("name")).alias("words")))
    shots = cut(tiles.dropna(subset=["chain", "name"]).select("chain", "tile_key", "place", photo_words(F.col("name"), True).alias("words")))
    own, shown = _forms(rows, "own"), _forms(shots, "tile")
    keys = ["chain", "telling"]
    found = cut(_inside(own, shown, "own", "tile").unionByName(_inside(shown, own, "tile", "own")))
    for a, b in (("own_key", "tile_key"), ("own_letters", "tile_letters")):
        pairs = similar_pairs(own, shown, keys, a, b, LIKE)
        wide = pairs.join(own, [*keys, a]).join(shown.select(*keys, b, "tile_words"), [*keys, b])
        found = found.unionByName(cut(wide.select(*keys, "own_words", "tile_words", F.col("ratio").alias("score"))))
    score = found.groupBy(*keys, "own_words", "tile_words").agg(F.max("score").alias("score"))
    first = shots.withColumnRenamed("words", "tile_words").groupBy("chain", "tile_words").agg(F.min(F.struct("place", "tile_key")).alias("tile"))
    best = score.join(first, ["chain", "tile_words"]).groupBy("chain", "own_words").agg(F.min(F.struct((-F.col("score")).alias("low"), "tile")).alias("best"))
    return rows.withColumnRenamed("words", "own_words").join(best, ["chain", "own_words"]).select("chain", "ext_key", F.col("best.tile.tile_key").alias("tile_key"), (-F.col("best.low")).alias("score"))
