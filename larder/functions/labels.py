"""Texts of labels: short sizes, amounts with units, differences, origin and notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short forms of sizes, titles and notices of flags, and the notice of old figures.
SHORT_SIZES = {"extra small": "XS", "small": "S", "medium": "M", "large": "L", "extra large": "XL", "regular": "Reg"}
FLAG_TITLES = {"kids": "Kids meal", "shareable": "Made to share", "regional": "Not at every location", "seasonal": "Was a seasonal item"}
FLAG_NOTICES = {
    "seasonal": "This was a limited-time item when the figures were collected, so the chain may no longer serve it.",
    "regional": "The chain lists this dish at some locations only.",
}
STALE_NOTICE = "Published {}. Chains change portions and recipes, so treat this as a guide."


def _looked_up(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def short_size(label: Column) -> Column:
    """S, M, L for sizes; the number alone of ounces; other labels as they are."""
    ounces = F.regexp_extract(label, r"^ *([0-9]+(?:\.[0-9]+)?) +(?:.* +)?(?i:oz) *$", 1)
    return F.coalesce(_looked_up(F.lower(label), SHORT_SIZES), F.nullif(ounces, F.lit("")), label)


def amount(value: Column, unit: str = "") -> Column:
    """A whole number, halves to even, thousands apart, and its unit."""
    return F.concat(F.format_number(value, 0), F.lit(f" {unit}" if unit else ""))


def fine_grams(value: Column) -> Column:
    """Grams with at most one decimal, so that half a gram isn't nought."""
    return F.concat(F.regexp_replace(F.format_number(value, 1), r"\.0$", ""), F.lit(" g"))


def difference(value: Column, unit: str = "") -> Column:
    """A whole number that always has its sign."""
    return F.concat(F.when(value < 0, "-").otherwise("+"), amount(F.abs(value), unit))


def source_name(source: Column, names: dict[str, str]) -> Column:
    """Readable name of a source: that of the longest prefix in ``names``, else the source itself."""
    named = [F.when(F.startswith(source, F.lit(p)), n) for p, n in sorted(names.items(), key=lambda x: -len(x[0]))]
    return F.coalesce(*named, source)


def provenance(source: Column, observed: Column, names: dict[str, str]) -> Column:
    """Source and year of a figure."""
    return F.concat(source_name(source, names), F.lit(" · "), F.substring(observed.cast("string"), 1, 4))


def stale_notice(stale: Column, observed: Column) -> Column:
    before, after = STALE_NOTICE.split("{}")
    return F.when(stale, F.concat(F.lit(before), F.substring(observed.cast("string"), 1, 4), F.lit(after)))


def flag_titles(flags: Column) -> Column:
    """Titles of the known flags, in the fixed order."""
    return F.transform(F.filter(F.array(*[F.lit(f) for f in FLAG_TITLES]), lambda f: F.array_contains(flags, f)), lambda f: _looked_up(f, FLAG_TITLES))


def flag_notices(flags: Column) -> Column:
    """Notices of the flags that have one, in the fixed order of flags."""
    known = [f for f in FLAG_TITLES if f in FLAG_NOTICES]
    return F.transform(F.filter(F.array(*[F.lit(f) for f in known]), lambda f: F.array_contains(flags, f)), lambda f: _looked_up(f, FLAG_NOTICES))
