"""Ranked text search over a catalog in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import match_level, search_form


def search_tokens(phrase: str) -> list[str]:
    """The tokens of a typed phrase, by the same folding as names in plain ASCII."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", phrase.replace("'", "").replace("’", "")) if not unicodedata.combining(c))
    return [t for t in re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", plain.lower()).split(" ") if t]


def search_score(tokens: list[str], name: Column, chain: Column | None) -> Column:
    """Sum over tokens of twice the name's level and once the chain's; null unless every token hits."""
    total, hits = F.lit(0), F.lit(True)
    for token in tokens:
        on_name = match_level(F.lit(token), name)
        on_chain = match_level(F.lit(token), chain) if chain is not None else F.lit(0)
        total = total + on_name * 2 + on_chain
        hits = hits & ((on_name > 0) | (on_chain > 0))
    return F.when(hits, total)


def ranked_search(items: DataFrame, phrase: str, chain: str | None = None, limit: int = 50) -> DataFrame:
    """The best ``limit`` items: on the menu first, then by score, shorter names, item_id.

    Within one chain only names count. Expects chain, item_id, name and off_menu.
    """
    tokens = search_tokens(phrase)
    scope = items if chain is None else items.where(F.col("chain") == chain)
    formed = scope.withColumn("_name", search_form(F.col("name")))
    if not tokens:
        return formed.limit(0).withColumn("score", F.lit(0)).drop("_name")
    score = search_score(tokens, F.col("_name"), search_form(F.col("chain")) if chain is None else None)
    return (formed.withColumn("score", score).where("score is not null")
            .orderBy(F.coalesce("off_menu", F.lit(False)), F.desc("score"), F.octet_length("_name"), "item_id").limit(limit).drop("_name"))
