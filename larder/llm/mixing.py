"""Mixing to target weights by soft domain membership (operator 10), in DataFrame functions only.

1. A bounded sample of labelled documents trains a naive Bayes classifier on hashed words; its word
   weights are counted by aggregation, and a text's posterior is the softmax of its priors and its
   log-likelihood ratio, of at most ``EVIDENCE_WORDS`` words' weight, so that membership stays soft.
2. Every document gets its token count and domain posteriors (whole texts).
3. Document rates, as near to 1 as can be in least squares, bring the domains' expected token totals
   to their targets by projected gradient: each round aggregates the totals, scales their gradient by
   the curvature of the free rates and adds it to the steps taken so far. The steps are summed before
   the projection, so a rate is ``greatest(floor, 1 + sum of step * posterior)`` after any number of
   rounds, and the plan keeps its size. Only one row of domain totals reaches the driver in a round.

Edge cases: a null text is an empty one: no tokens, prior posteriors; documents without tokens get a
rate like any other; repeated rows stay, each with its rate; an empty table gives an empty table; a
domain without labelled rows has no members and its target is left out. Targets that no rates reach,
or only beyond ``max_growth``, are missed: ``Fit`` holds the reached shares and a warning names them.
``mixed`` keeps all columns as they are, whatever their names; the others ignore extra columns.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, fresh, text_or_empty

BUCKETS = 4096
SAMPLE_DOCS = 4000  # labelled rows that the classifier is fitted on, at most
SAMPLE_CHARS = 20000  # longer documents aren't used for training (all get posteriors)
EVIDENCE_WORDS = 128  # the mean word weight counts as often as a text has words, at most so often: membership stays soft
TARGETS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}
ROUNDS = 30
TOLERANCE = 1e-4
MAX_GROWTH = 8.0  # most tokens after mixing, in times of those before, where no document may go


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled table: toxic, else poor or good."""
    domain = F.when(F.max("toxic") == 1, "toxic").when(F.min("quality") == 0, "poor").when(F.min("quality") == 1, "good")
    return labels.groupBy("doc_id").agg(domain.alias("domain")).where("doc_id is not null and domain is not null")


def _words(text: Column) -> Column:
    return F.split(F.translate(text, "\n\t\r", "   "), " ")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class DomainModel:
    """Priors, and word weights relative to the first domain, one list of BUCKETS for each other."""

    def __init__(self, domains: list[str], priors: list[float], weights: list[list[float]]):
        self.domains, self.priors, self.weights = domains, priors, weights


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_docs: int = SAMPLE_DOCS) -> DomainModel:
    """Naive Bayes over hashed words; ``labelled`` has doc_id and domain."""
    labelled = labelled.where(F.col("domain").isin(domains))
    sizes = {r.domain: r["count"] for r in labelled.groupBy("domain").count().collect()}
    known = [d for d in domains if sizes.get(d)] or domains[:1]
    least = max(1, sample_docs // len(known))
    parts = [labelled.where(F.col("domain") == d).select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id").limit(least) for d in known]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionAll(part)
    words = (docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(sample), "doc_id")
             .select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).where("w <> ''"))
    counts = {(r.domain, r.b): r.n for r in words.groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).collect()}
    total = {d: sum(counts.get((d, b), 0) for b in range(BUCKETS)) for d in known}
    logs = {d: [math.log((counts.get((d, b), 0) + 1.0) / (total[d] + BUCKETS)) for b in range(BUCKETS)] for d in known}
    everything = max(1, sum(sizes.get(d, 0) for d in known))
    priors = [math.log(max(1, sizes.get(d, 0)) / everything) for d in known]
    return DomainModel(known, priors, [[round(x - y, 5) for x, y in zip(logs[d], logs[known[0]])] for d in known[1:]])


def _summed(model: DomainModel, text: Column) -> Column:
    """struct<n, s0, s1, ...>: the words of a text and its weights for every domain but the first."""
    tables = [F.from_json(F.lit(json.dumps(w)), "array<double>") for w in model.weights]
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f"s{k}") for k in range(len(tables))])

    def step(acc: Column, word: Column) -> Column:
        moved = F.struct((acc["n"] + 1).alias("n"), *[(acc[f"s{k}"] + F.get(t, _bucket(word))).alias(f"s{k}") for k, t in enumerate(tables)])
        return F.when(word == "", acc).otherwise(moved)

    return F.aggregate(_words(text), zero, step)


def _posteriors(model: DomainModel, summed: str) -> list[Column]:
    """One probability for each domain, from the column that ``_summed`` made."""
    evidence = F.least(F.lit(1.0), F.lit(float(EVIDENCE_WORDS)) / F.greatest(F.col(f"{summed}.n"), F.lit(1)))
    scores = [F.lit(model.priors[0])] + [F.lit(p) + evidence * F.col(f"{summed}.s{k}") for k, p in enumerate(model.priors[1:])]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    whole = sum(parts[1:], parts[0])
    return [p / whole for p in parts]


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens (long) and p_<domain> of every row of ``docs``."""
    summed = docs.select("doc_id", _summed(model, text_or_empty()).alias("summed"))
    return summed.select("doc_id", F.col("summed.n").alias("n_tokens"), *[p.alias(f"p_{d}") for d, p in zip(model.domains, _posteriors(model, "summed"))])


@dataclass(frozen=True)
class Fit:
    """Summed steps and floor of the rates, and what they reach."""

    steps: tuple[float, ...]  # one for each domain, after the constant one
    floor: float
    targets: dict[str, float]  # wanted shares
    reached: dict[str, float]  # shares of expected tokens
    growth: float
    converged: bool

    def rate(self, posteriors: list[Column]) -> Column:
        moved = sum((F.lit(s) * p for s, p in zip(self.steps[1:], posteriors)), F.lit(1.0 + self.steps[0]))
        return F.greatest(F.lit(self.floor), moved)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], min_rate: float = 0.0, max_growth: float = MAX_GROWTH) -> Fit:
    """Fit the rates; ``members`` (n_tokens, p_<domain>) must be cheap to read again.

    With ``min_rate`` 0 the tokens stay as many as they are. With ``min_rate`` 1 no document is dropped
    and the shares alone are met: tokens grow as needed, at most to ``max_growth`` times.
    """
    n, p = F.col("n_tokens").cast("double"), [F.col(f"p_{d}") for d in domains]
    wanted = sum(targets.get(d, 0.0) for d in domains)
    share = np.array([targets.get(d, 0.0) / wanted if wanted > 0 else 0.0 for d in domains])
    grows = min_rate > 0
    # What the totals are taken of: membership, or membership over the share where the size is free.
    over = [x - F.lit(float(s)) for x, s in zip(p, share)] if grows else p
    pairs = [(i, j) for i in range(len(domains)) for j in range(i + 1)]
    shift = -share if grows else np.zeros(len(domains))

    def made(steps: np.ndarray, totals: np.ndarray, after: float, whole: float, converged: bool) -> Fit:
        reached = dict(zip(domains, (totals / after if after else totals).tolist()))
        return Fit((float(steps @ shift), *steps.tolist()), min_rate, dict(zip(domains, share.tolist())), reached, after / whole if whole else 1.0, converged)

    def state(steps: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Tokens at hand and after, expected totals, and curvature over the rates that aren't at the floor."""
        rate = made(steps, share, 0.0, 0.0, False).rate(p)
        free = F.when(rate > min_rate, n).otherwise(0.0) if steps.any() else n
        row = members.agg(F.sum(n), F.sum(n * rate), *[F.sum(n * x * rate) for x in p], *[F.sum(free * over[i] * over[j]) for i, j in pairs]).first()
        values = [float(v or 0.0) for v in row]
        curve = np.zeros((len(p), len(p)))
        for (i, j), v in zip(pairs, values[2 + len(p):]):
            curve[i, j] = curve[j, i] = v
        return values[0], values[1], np.array(values[2:2 + len(p)]), curve

    steps = np.zeros(len(domains))
    whole, after, totals, curve = state(steps)
    if whole <= 0 or wanted <= 0:
        return made(steps, totals, after, whole, whole <= 0)

    def miss_of(after: float, totals: np.ndarray) -> np.ndarray:
        return share * (after if grows else whole) - totals

    miss, pace = miss_of(after, totals), 1.0
    for _ in range(ROUNDS):
        if np.abs(miss).max() <= TOLERANCE * (after if grows else whole):
            break
        move = np.linalg.solve(curve + 1e-6 * whole * np.eye(len(domains)), miss)
        _, new_after, new_totals, new_curve = state(steps + pace * move)
        new_miss = miss_of(new_after, new_totals)
        if grows and new_after > max_growth * whole or np.abs(new_miss).max() >= np.abs(miss).max():
            pace /= 4.0  # too far: the rates at the floor changed
            if pace < 1e-3:
                break
            continue
        steps, after, totals, curve, miss, pace = steps + pace * move, new_after, new_totals, new_curve, new_miss, min(1.0, 2.0 * pace)
    fitted = made(steps, totals, after, whole, bool(np.abs(miss).max() <= TOLERANCE * (after if grows else whole)))
    if not fitted.converged:
        logging.getLogger(__name__).warning("mixing reaches %s, not %s, at %.2f times the tokens", fitted.reached, fitted.targets, fitted.growth)
    return fitted


def rates(members: DataFrame, domains: list[str], targets: dict[str, float], min_rate: float = 0.0, max_growth: float = MAX_GROWTH) -> Column:
    """The fitted rate as an expression over p_<domain>."""
    return fit_rates(members, domains, targets, min_rate, max_growth).rate([F.col(f"p_{d}") for d in domains])


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, posteriors and rate of every document."""
    model = fit(docs, label_domains(labels), list(targets))
    members = cut(with_posteriors(docs, model))
    return members.withColumn("rate", rates(members, model.domains, targets))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, min_rate: float = 0.0) -> DataFrame:
    """``docs`` with rows repeated by rate: its whole part, and once more with its fraction's chance.

    The chance is a hash of the row, so that a run again gives the same rows.
    """
    model = fit(docs, label_domains(labels), list(targets))
    fitted = fit_rates(cut(with_posteriors(docs, model)), model.domains, targets, min_rate)
    summed, times = fresh(docs, "summed"), fresh(docs, "times")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    rate = fitted.rate(_posteriors(model, summed))
    # Exploded from one element, the sums are a column that the rate reads; else the optimizer puts them, tables included, wherever it does.
    counted = docs.select("*", F.explode(F.array(_summed(model, text_or_empty()))).alias(summed))
    repeated = counted.select(*docs.columns, F.floor(rate + chance).cast("int").alias(times))
    return repeated.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
