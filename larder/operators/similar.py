"""Similarity join of texts by the ratio of matching blocks, behind a prefix filter over rare character pairs.

Let M signs be matched in two texts of S signs together, so that the ratio is 2M / S. The matched signs
stand in at most S - 2M + 1 runs, so the texts have at least 3M - S - 1 neighbouring pairs of signs in
common, and M single signs. A text whose tokens (pairs or signs, each with its running number) are put
in one order for all texts shares one of its first (tokens - needed + 1) with every text that has the
needed number in common. Those first tokens are the join key: no match is lost, and rare tokens come
first, so common ones seldom meet. Single signs serve where S is too small for the bound by pairs.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.checkpoints import cut

RANKED_TOKENS = 4096  # the most frequent ones are told apart; all others count as rare


def needed_tokens(n: int, least: float) -> dict[int, int]:
    """How many tokens of one and of two signs a text of ``n`` signs shares with a text of ratio ``least``; only sizes that are used."""
    reach = 1.5 * least - 1
    turn = 1 / reach if reach > 0 else math.inf  # from this S on, pairs of signs are bound to be shared
    smallest, largest = 2 * n / (2 - least), 2 * n / least
    out = {}
    if smallest <= turn:
        out[1] = max(1, math.ceil(least * n / (2 - least) - 1e-9))
    if largest > turn:
        out[2] = max(1, math.ceil(reach * max(smallest, turn) - 1 - 1e-9))
    return out


def prefix_tokens(form: str, least: float, rank: dict[str, int]) -> list[str]:
    """The tokens under which a text is looked for, rare ones first."""
    out = []
    for q, needed in needed_tokens(len(form), least).items():
        seen: Counter = Counter()
        tokens = []
        for i in range(len(form) - q + 1):
            sign = form[i:i + q]
            seen[sign] += 1
            tokens.append((rank.get(sign, -1), sign, seen[sign]))
        tokens.sort()
        out += [f"{q}{sign}{number}" for _, sign, number in tokens[:max(0, len(tokens) - needed + 1)]]
    return out


def _ranks(forms: DataFrame) -> dict[str, int]:
    """Ranks of the most frequent signs and pairs of signs; the order only decides how many pairs are compared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for form in frame["form"]:
                seen.update(form)
                seen.update(map("".join, zip(form, form[1:], strict=False)))
        yield pd.DataFrame({"token": list(seen), "n": list(seen.values())}, columns=["token", "n"]).astype({"token": "object", "n": "int64"})

    counted = forms.mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequent = counted.orderBy(F.desc("n"), "token").limit(RANKED_TOKENS).collect()
    return {r.token: i for i, r in enumerate(reversed(frequent))}


def at_least(least: float):
    """The ratio of matching blocks of two texts where it is ``least`` or more, else null.

    The bounds by lengths and by shared signs are never below the ratio.
    """

    @F.pandas_udf(T.DoubleType())
    def bounded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(a: str, b: str) -> float | None:
            found = difflib.SequenceMatcher(None, a, b)
            if found.real_quick_ratio() < least or found.quick_ratio() < least:
                return None
            exact = found.ratio()
            return exact if exact >= least else None

        for left, right in batches:
            yield pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")

    return bounded


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_form: str, right_form: str, least: float) -> DataFrame:
    """``keys``, both forms and ``ratio``: all distinct pairs of equal keys with a ratio of ``least`` (over 0) or more.

    Null forms and keys match nothing. Two empty forms are equal, so their ratio is 1.
    """
    spark = left.sparkSession
    own, other = (df.select(*keys, F.col(form).alias(name)).dropna().distinct() for df, form, name in ((left, left_form, "_l"), (right, right_form, "_r")))
    equal = own.join(other.withColumnRenamed("_r", "_l"), [*keys, "_l"]).select(*keys, "_l", F.col("_l").alias("_r"), F.lit(1.0).alias("ratio"))
    forms = cut(own.select(F.col("_l").alias("form")).union(other.select("_r")).distinct()).withColumn("id", F.monotonically_increasing_id())
    rank = _ranks(forms)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([prefix_tokens(f, least, rank) for f in texts], dtype="object")

    own, other = (df.join(forms, F.col(form) == F.col("form")).select(*keys, form, F.col("id").alias(f"{form}_id")) for df, form in ((own, "_l"), (other, "_r")))
    marked = forms.select(F.col("id").alias("_id"), F.length("form").alias("_n"), tokens("form").alias("_tokens"))

    def looked(df: DataFrame, form: str) -> DataFrame:
        """A row a token: a hash of keys and token, the text's number and its length, as long texts have many tokens."""
        told = df.join(marked, F.col(f"{form}_id") == F.col("_id")).select(*keys, f"{form}_id", F.col("_n").alias(f"{form}_n"), F.explode("_tokens").alias("_token"))
        return told.select(F.xxhash64(*keys, "_token").alias("_met"), f"{form}_id", f"{form}_n")

    # Equal hashes of other keys only add pairs here: the keys are joined for themselves below.
    close = 2.0 * F.least("_l_n", "_r_n") >= (least - 1e-9) * (F.col("_l_n") + F.col("_r_n"))
    # A merge join, as plans don't reckon with the rows that explode makes and might broadcast them.
    met = looked(own, "_l").join(looked(other, "_r").hint("merge"), "_met").where(close & (F.col("_l_id") != F.col("_r_id")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes a pair, but much to compute: not to be put together
    once = met.select("_l_id", "_r_id").distinct().repartition(parts)  # keys share names, so pairs of texts are compared once
    texts = once.join(forms.select(F.col("id").alias("_l_id"), F.col("form").alias("_lf")), "_l_id").join(forms.select(F.col("id").alias("_r_id"), F.col("form").alias("_rf")), "_r_id")
    near = F.expr(f"levenshtein(_lf, _rf, cast(floor({1 - least + 1e-9}D * (length(_lf) + length(_rf))) AS int)) >= 0")  # changes at most S - 2M
    ratios = texts.where(near).withColumn("ratio", at_least(least)("_lf", "_rf")).where("ratio is not null").select("_l_id", "_r_id", "ratio")
    scored = own.join(ratios, "_l_id").join(other, [*keys, "_r_id"]).select(*keys, "_l", "_r", "ratio")
    return equal.unionByName(scored).select(*keys, F.col("_l").alias(left_form), F.col("_r").alias(right_form), "ratio")
