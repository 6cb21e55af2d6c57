"""Folding of names against Python's own Unicode data, over all signs."""

import re
import unicodedata

from pyspark.sql import functions as F

from larder.functions import text as t


def test_every_sign_as_unicode_decomposes_it(spark):
    signs = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i <= 0xD7A3]
    rows = spark.createDataFrame([(c, f"a{c}b") for c in signs], "c string, s string").select("c", t.decomposed(F.col("s")).alias("d"), t.fold(F.col("s")).alias("f")).collect()
    assert len(rows) == len(signs)
    for r in rows:
        assert r.d == "".join(x for x in unicodedata.normalize("NFKD", f"a{r.c}b") if not unicodedata.combining(x)), hex(ord(r.c))
        kind = unicodedata.decomposition(r.c)
        if r.c not in "øØ" and not kind.startswith("<"):
            assert r.f == "".join(x for x in unicodedata.normalize("NFD", f"a{r.c}b") if not unicodedata.combining(x)), hex(ord(r.c))


def names(spark, *given):
    df = spark.createDataFrame([(n,) for n in given], "n string")
    return [tuple(r) for r in df.select(F.array_join(t.plain_words(F.col("n")), " "), t.search_form(F.col("n"))).collect()]


def test_names_of_all_scripts(spark):
    got = names(spark, "Caffè Americano", "Chick-fil-A® Nuggets", "Kid’s ﬁllet ½ lb", "Ｆｕｌｌ Ｗｉｄｔｈ", "Crème Brûlée", "ĠŐŹ ẅ ǻ", "", None, "Борщ Ёлка", "McDonald's Fries")
    assert [g[0] for g in got] == ["caffe americano", "nuggets", "kids fillet 1 2 lb", "full width", "creme brulee", "goz w a", "", None, "", "fries"]
    assert [g[1] for g in got][:2] == ["caffe americano", "chick fil a nuggets".replace("a nuggets", "a® nuggets")]
    assert got[3][1] == "full width" and got[8][1] == "борщ елка" and got[9][1] == "mcdonalds fries"


def test_plain_words_equal_a_plain_reading(spark):
    def plain(name):
        text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().replace("®", " ").replace("’", "'")
        text = re.sub(r"'s\b", "s", re.sub(r"\s*nutrition and ingredients\s*$", "", text))
        found = [{"kid": "kids", "childs": "kids", "child": "kids"}.get(w, w) for w in re.sub(t.BRAND_WORDS, " ", re.sub("[^a-z0-9 ]+", " ", text)).split()]
        return " ".join(w for w in found if w not in t.COUNT_UNITS)

    given = ["Jalapeño Poppers 8 ct", "Child Meal", "Kid's Meal Nutrition and Ingredients", "№ 5 Ⅻ ① Tea", "Chick fil A Nuggets", "Ångström Øl", "Nuggets™ 10 pc"]
    assert [g[0] for g in names(spark, *given)] == [plain(n) for n in given]
