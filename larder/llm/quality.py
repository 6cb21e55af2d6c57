"""Quality classifier from weak labels (operator 6).

Heuristic labellers vote good, poor or nothing on every document. Expectation-maximisation over the
counts of vote patterns (there are at most 3**labellers of them, however many documents) estimates
the labellers' accuracies and the share of good documents. The posteriors label a bounded sample, on
which a linear scorer of hashed words and character classes is trained; it scores whole texts.

Edge cases: a null text is an empty one; labellers abstain on texts without words, except the length
labeller, which votes poor; repeated rows stay with equal scores; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, text_or_empty

BITS = 15
KEEP = 0.5


def _stats(text: Column) -> dict[str, Column]:
    words = F.filter(F.split(F.translate(text, "\n\t\r", "   "), " "), lambda w: w != "")
    return {"chars": F.length(text), "n": F.size(words), "kinds": F.size(F.array_distinct(words)),
            "letters": F.length(F.regexp_replace(text, r"[^\p{L}]", "")), "upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")),
            "marks": F.length(F.regexp_replace(text, r"[^%$#&*!|<>{}=\\^~@\[\]]", "")), "stops": F.length(F.regexp_replace(text, r"[^.,]", "")),
            "lines": F.size(F.split(text, "\n")), "line_kinds": F.size(F.array_distinct(F.split(text, "\n")))}


def _votes() -> dict[str, Column]:
    """1 good, -1 poor, 0 no vote; every labeller looks at another side of the text."""
    c = F.col
    n, chars = F.greatest(c("n"), F.lit(1)), F.greatest(c("chars"), F.lit(1))

    def two(good: Column, poor: Column) -> Column:
        return F.when(c("n") == 0, 0).when(poor, -1).when(good, 1).otherwise(0)

    return {"length": F.when(c("n") < 5, -1).when(c("n") >= 30, 1).otherwise(0),
            "marks": two(c("marks") / chars < 0.005, c("marks") / chars > 0.03),
            "upper": two(c("upper") / F.greatest(c("letters"), F.lit(1)) < 0.15, c("upper") / F.greatest(c("letters"), F.lit(1)) > 0.4),
            "letters": two(c("letters") / chars > 0.7, c("letters") / chars < 0.55),
            "repeats": two((c("n") >= 30) & (c("kinds") / n > 0.35), (c("n") >= 30) & (c("kinds") / n < 0.2)),
            "line_repeats": F.when((c("lines") >= 4) & (c("line_kinds") / c("lines") < 0.6), -1).when((c("lines") >= 4) & (c("line_kinds") == c("lines")), 1).otherwise(0),
            "word_length": two((c("chars") / n).between(3.5, 9), (c("chars") / n > 12) | (c("chars") / n < 3)),
            "stops": two(((c("stops") / n).between(0.03, 0.4)) & (c("n") >= 20), (c("n") >= 20) & ((c("stops") / n < 0.01) | (c("stops") / n > 0.6)))}


LABELLERS = ("length", "marks", "upper", "letters", "repeats", "line_repeats", "word_length", "stops")


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, row key and one vote column per labeller."""
    base = docs.select("doc_id", text_or_empty().alias("text"))
    stats = base.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), *[e.alias(k) for k, e in _stats(F.col("text")).items()])
    return stats.select("doc_id", "row_key", *[v.cast("int").alias(k) for k, v in _votes().items()])


@dataclass(frozen=True)
class LabelModel:
    prior: float
    good: np.ndarray  # labeller by vote (-1, 0, 1): chance on good documents
    poor: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(patterns.shape[1])
        a = np.log(self.prior) + np.log(self.good[at, patterns + 1]).sum(axis=1)
        b = np.log(1 - self.prior) + np.log(self.poor[at, patterns + 1]).sum(axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(b - a, -50, 50)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Accuracies of conditionally independent labellers from vote patterns and their counts."""
    k = patterns.shape[1]
    good = np.tile([0.15, 0.35, 0.5], (k, 1))
    poor = np.tile([0.5, 0.35, 0.15], (k, 1))
    model = LabelModel(0.8, good, poor)
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    before = -np.inf
    for _ in range(rounds):
        p = model.posterior(patterns)
        a, b = p * counts, (1 - p) * counts
        good = ((hot * a[:, None, None]).sum(0) + 0.5) / (a.sum() + 1.5)
        poor = ((hot * b[:, None, None]).sum(0) + 0.5) / (b.sum() + 1.5)
        model = LabelModel(float(np.clip(a.sum() / max(counts.sum(), 1), 0.02, 0.98)), good, poor)
        now = float((p * counts).sum())
        if abs(now - before) < 1e-6 * max(counts.sum(), 1):
            break
        before = now
    return model


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: hashed word shapes and words, and their rates in the text."""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return np.array([0]), np.array([1.0])
    slots = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) & np.uint64((1 << BITS) - 1)
    kinds, n = np.unique(slots.astype(np.int64), return_counts=True)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    classes = np.array([((raw >= 65) & (raw <= 90)).mean(), ((raw >= 97) & (raw <= 122)).mean(), (raw >= 128).mean(), ((raw >= 48) & (raw <= 57)).mean(),
                        np.isin(raw, np.frombuffer(b"%$#&*!|<>{}=^~@[]", np.uint8)).mean(), np.isin(raw, np.frombuffer(b".,", np.uint8)).mean(),
                        len(kinds) / len(words), min(1.0, np.log1p(len(words)) / 8)])
    values = np.concatenate([n / np.sqrt((n.astype(float) ** 2).sum()), classes * 3.0, [1.0]])
    return np.concatenate([kinds, (1 << BITS) + np.arange(len(classes) + 1)]), values


SLOTS = (1 << BITS) + 9


def train_linear(rows: list[tuple[str, float]], epochs: int = 6, rate: float = 0.3) -> np.ndarray:
    """Adagrad logistic regression on posterior labels."""
    w, grown = np.zeros(SLOTS), np.full(SLOTS, 1e-2)
    data = [(*hashed(t), y) for t, y in rows]
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            slots, values, y = data[i]
            pull = (y - 1.0 / (1.0 + np.exp(-np.clip(w[slots] @ values, -30, 30)))) * values
            grown[slots] += pull ** 2
            w[slots] += rate * pull / np.sqrt(grown[slots])
    return w


@dataclass(frozen=True)
class TrainingBounds:
    docs: int = 4000
    max_chars: int = 20000  # longer documents are not used for training (all are scored)


def quality(docs: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> DataFrame:
    """doc_id, weak_label, score and keep of every document."""
    voted = cut(votes(docs))
    patterns = voted.groupBy(*LABELLERS).count().collect()
    if not patterns:
        return voted.select("doc_id", F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("keep"))
    votes_of = np.array([[r[k] for k in LABELLERS] for r in patterns])
    model = expectation_maximisation(votes_of, np.array([r["count"] for r in patterns], float))
    keys = voted.select("row_key", *LABELLERS).dropDuplicates(["row_key"]).orderBy("row_key").limit(bounds.docs)
    chosen = {r.row_key: model.posterior(np.array([[r[k] for k in LABELLERS]]))[0] for r in keys.collect()}
    ids = F.broadcast(keys.select("row_key"))
    texts = (docs.select(F.xxhash64("doc_id", text_or_empty()).alias("row_key"), text_or_empty().alias("text"))
             .where(F.length("text") <= bounds.max_chars).join(ids, "row_key").groupBy("row_key").agg(F.min("text").alias("text")).orderBy("row_key").collect())
    weights = train_linear([(r.text, float(chosen[r.row_key])) for r in texts])

    @F.pandas_udf("double")
    def linear(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                slots, values = hashed(text)
                out.append(float(1.0 / (1.0 + np.exp(-np.clip(weights[slots] @ values, -30, 30)))))
            yield pd.Series(out, dtype="float64")

    at = np.arange(len(LABELLERS))
    lifts = np.log(model.good) - np.log(model.poor)
    logit = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for i in at:
        table = F.array(*[F.lit(float(x)) for x in lifts[i]])
        logit = logit + F.get(table, _votes()[LABELLERS[i]].cast("int") + 1)
    base = docs.select("doc_id", text_or_empty().alias("text"))
    stats = base.select("doc_id", linear("text").alias("score"), *[e.alias(k) for k, e in _stats(F.col("text")).items()])
    return stats.select("doc_id", (1.0 / (1.0 + F.exp(-logit))).alias("weak_label"), "score", (F.col("score") >= KEEP).alias("keep"))
