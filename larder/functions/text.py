"""Text functions as Column builders; all of them run inside code generation."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search levels.
LEADING, WORD_START, INSIDE, NONE = 3, 2, 1, 0


def slug(text: Column) -> Column:
    """Lower case; runs of other than a-z and 0-9 become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@cache
def _plain_forms(compatible: bool) -> tuple[str, str, str]:
    """Letters and other signs with their forms without marks, by Unicode's own decompositions.

    Two texts of equal length (each sign and its form, then the marks that go) and a JSON object of those
    whose form has several signs. ``compatible`` takes every decomposition, otherwise only marks and
    widths go. Syllables of Hangul are left whole.
    """
    signs, forms, gone, several = [], [], [], {}
    for sign in map(chr, [*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)]):
        if unicodedata.combining(sign):
            gone.append(sign)
        elif kind := unicodedata.decomposition(sign):
            if compatible or not kind.startswith("<") or kind.startswith(("<wide>", "<narrow>")):
                whole = unicodedata.normalize("NFKD" if compatible or kind.startswith("<") else "NFD", sign)
                form = "".join(c for c in whole if not unicodedata.combining(c))
                if len(form) == 1:
                    signs.append(sign)
                    forms.append(form)
                elif form != sign:
                    several[sign] = form
    if not compatible:  # a stroke is no mark to Unicode
        signs += "øØ"
        forms += "oO"
    return "".join([*signs, *gone]), "".join(forms), json.dumps(several)


def _unmarked(text: Column, compatible: bool) -> Column:
    signs, forms, several = _plain_forms(compatible)
    table = F.from_json(F.lit(several), "map<string,string>")
    some = F.lit("[" + "".join(json.loads(several)) + "]")

    def taken_apart(x: Column) -> Column:
        whole = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return F.when(F.regexp_like(x, F.lit("[^\\x00-\\x7F]")) & F.regexp_like(x, some), whole).otherwise(x)

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))  # the value's own expression stands once

    # Translating compares its whole tables for every text, so ASCII texts, which stay as they are, pass it by.
    return once(text, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(once(F.translate(x, signs, forms), taken_apart)))


def fold(text: Column) -> Column:
    """Without marks on letters of any script, and in their usual width."""
    return _unmarked(text, False)


def decomposed(text: Column) -> Column:
    """Compatibility forms (ligatures, fractions, signs in circles) taken apart, and without marks."""
    return _unmarked(text, True)


def search_form(text: Column) -> Column:
    """Folded lower case for search: apostrophes vanish, other ASCII signs become one space."""
    plain = F.lower(fold(F.translate(text, "'’", "")))
    return F.trim(F.regexp_replace(plain, "[\\x00-\\x7F&&[^a-z0-9]]+", " "))


def match_level(token: Column, text: Column) -> Column:
    """3 at the start of the text, 2 at the start of a word, 1 inside a word, 0 if absent."""
    return (F.when(F.startswith(text, token), LEADING).when(F.contains(text, F.concat(F.lit(" "), token)), WORD_START)
            .when(F.contains(text, token), INSIDE).otherwise(NONE))


def clean(text: Column) -> Column:
    """White space made single and trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def seed_number(text: Column) -> Column:
    """A number with one decimal; blanks, NA, N/A, NULL and - are null."""
    value = F.upper(F.trim(text))
    return F.when(F.regexp_like(value, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")), F.round(value.try_cast("double"), 1))


def bounded_number(text: Column) -> Column:
    """The number in a label cell: thousands commas go, a leading < keeps the bound."""
    return F.regexp_extract(F.translate(text, ",", ""), r"<?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def guide_number(text: Column) -> Column:
    """The number in a guide cell: a cell with < has no number."""
    return F.when(~F.contains(text, F.lit("<")), bounded_number(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


# The words that say a portion, and those that count units.
SIZE_WORDS = ("small", "medium", "large", "kids", "jr", "giant", "mini", "short", "tall", "grande", "venti", "trenta")
COUNT_UNITS = ("ct", "count", "pc", "pcs", "piece", "pieces")
KID_WORDS = ("kid", "childs", "child")


# A chain's own name inside names of its items.
BRAND_WORDS = r"\b(?:chick fil a|chickfila|mcdonalds)\b"


def plain_words(name: Column) -> Column:
    """Words of a name: without marks and brands, lower case, possessives joined, kid words alike, count units dropped."""
    text = F.regexp_replace(F.translate(F.lower(decomposed(name)), "®’", " '"), r"'s\b", "s")
    text = F.regexp_replace(F.regexp_replace(text, r"\s*nutrition and ingredients\s*$", ""), "[^a-z0-9 ]+", " ")
    text = F.regexp_replace(text, BRAND_WORDS, " ")
    return F.filter(F.transform(words(text), lambda w: F.when(w.isin(*KID_WORDS), "kids").otherwise(w)), lambda w: ~w.isin(*COUNT_UNITS))


def is_portion(word: Column) -> Column:
    return F.regexp_like(word, F.lit("^[0-9]+$")) | word.isin(*SIZE_WORDS)


def portion(name: Column) -> Column:
    """Sorted distinct numbers and size words: two names of one item have the same."""
    return F.array_sort(F.array_distinct(F.filter(plain_words(name), is_portion)))


def comparable(name: Column) -> Column:
    """Words without portions, sorted, joined by a space."""
    return F.array_join(F.array_sort(F.filter(plain_words(name), lambda w: ~is_portion(w))), " ")


# Words of serving that a picture doesn't show.
SERVING_SHAPES = ("regular", "wrap", "bowl", "tub", "sub", "half", "whole", "combo")
STOP_WORDS = ("and", "the", "of", "a", "an")


def dish(name: Column) -> Column:
    """A name without measures, serving words, sizes and stop words; its words sorted."""
    text = F.regexp_replace(name, r"(?i)\(?\b[0-9]+(?:\.[0-9]+)?\s*(?:fl\s*)?(?:oz|ml|l|g|kg|lb|inch|in|cal)\b\.?\)?", " ")
    text = F.regexp_replace(text, r"(?i)\b(?:with\s+ice|bottle|can|jugs?|gallon|group|serves\s+[0-9]+|drive\s*-?\s*thru|naturally\s+flavored)\b", " ")
    kept = F.filter(plain_words(text), lambda w: ~is_portion(w) & ~w.isin(*SERVING_SHAPES, *STOP_WORDS))
    return F.array_join(F.array_sort(kept), " ")


def shortenings(name: Column) -> Column:
    """Dish names from the whole name to ever shorter heads, then without on- and with-phrases."""
    parts = F.split(name, r",|\s+-\s+|\s+–\s+|\s*\(")
    heads = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ", "))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(F.array(name), heads)
    no_on, no_with = (lambda t: F.regexp_replace(t, r"(?i)\s+on\s+.*$", "")), (lambda t: F.regexp_replace(t, r"(?i)\s+(?:w/|with)\s+.*$", ""))
    forms = F.concat(whole, F.transform(whole, no_on), F.transform(whole, no_with), F.transform(heads, lambda t: no_with(no_on(t))))
    return F.array_distinct(F.filter(F.transform(F.array_distinct(forms), dish), lambda d: d != ""))  # most phrases change nothing


def monogram(name: Column) -> Column:
    """First letters of the first two words."""
    return F.array_join(F.transform(F.slice(words(name), 1, 2), lambda w: F.substring(w, 1, 1)), "")


def price_band(tier: Column) -> Column:
    return F.when(tier.between(1, 4), F.repeat(F.lit("$"), tier))


# Grams in a unit of serving.
UNIT_GRAMS = {"g": 1.0, "ml": 1.0, "oz": 28.35, "fl oz": 29.57, "lb": 453.6, "kg": 1000.0, "l": 1000.0}


def serving_grams(serving: Column) -> Column:
    """Grams of a serving such as '12 oz'; null where the unit has no weight."""
    amount = F.regexp_extract(serving, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[A-Za-z]", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(serving, r"^\s*[0-9.]+\s*([A-Za-z]+(?:\s+oz)?)\s*$", 1))
    grams = F.lit(None).cast("double")
    for name, weight in UNIT_GRAMS.items():
        grams = F.when(unit == name, F.lit(weight)).otherwise(grams)
    return amount * grams
