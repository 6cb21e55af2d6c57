"""Toxicity by compression distance (operator 3).

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut into
windows of eight words; each window is compressed with either dictionary, and the window's gain is
the number of bytes that the toxic dictionary saves. Windows over a coarse gain are cut again into
one-word windows and compared once more. Calibrated weights turn the counts of toxic windows into
a score between 0 and 1.

The toxic dictionary is trained on the spans of toxic documents whose character shingles or starts of
words make up a much larger share of their words than of ordinary documents' words. It is followed by
the ordinary dictionary's content, so that ordinary text compresses alike with both and the difference
comes from toxic spans alone.

Edge cases: a null text scores as an empty text; empty texts get the score of a text without toxic
windows; repeated rows get one row each with equal scores; an empty table gives an empty table;
with no toxic or no ordinary training rows every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import release, text_or_empty

WINDOW_WORDS = 8
COARSE_GAIN = 1
SHINGLE = 5
FINE_BYTES = 1024
MIN_MATCH = 6
TOXIC_BYTES, TOP_SPANS = 512, 48  # of the toxic dictionary: trained bytes, and spans put behind them
STEMS = (6, 7, 8, 9)  # bytes of a word's start with the space before it
EDGE = b".,;:!?%$#*&|\"'()"
TAIL_BYTES, FINE_TAIL_BYTES = 16, 64  # a stretch of both dictionaries put after a window: zstandard looks for no match in the last bytes
THRESHOLD = 0.3
TOXIC_WEIGHT = 2.0  # of a toxic row in the calibration
LIFT, LEAST, REPEATS = 10.0, 4, 3  # of parts of toxic words: their share against ordinary texts, their texts, and how often a word counts in a text


@dataclass(frozen=True)
class TrainingBounds:
    """Upper bounds of the labelled sample that the model is fitted on."""

    toxic_docs: int = 2000
    ordinary_docs: int = 5000
    max_chars: int = 20000  # longer documents are not used for training (all are scored)


@dataclass(frozen=True)
class ToxicPart:
    """Dictionaries trained on one part of the rows, and weights calibrated on the others."""

    ordinary: bytes
    toxic: bytes
    usual: int  # median gain of an ordinary word
    weights: tuple[float, ...]  # bias, then one weight per feature

    def scorer(self) -> Callable[[str], float]:
        features, w = _Scorer(self.ordinary, self.toxic, self.usual).features, np.array(self.weights)
        return lambda text: float(w[0] + np.array(features(text)) @ w[1:])


@dataclass(frozen=True)
class ToxicModel:
    parts: tuple[ToxicPart, ...]

    def scorer(self) -> Callable[[str], float]:
        """Log-odds of a text, the mean of the parts' ones."""
        scorers = [part.scorer() for part in self.parts]
        return lambda text: sum(score(text) for score in scorers) / len(scorers)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


class _Scorer:
    """Window gains under a pair of dictionaries; ``usual`` is what an ordinary word gains."""

    def __init__(self, ordinary: bytes, toxic: bytes, usual: int = 0):
        near = ordinary[-FINE_BYTES:]  # nearer matches cost fewer bytes
        self._coarse = self._compressor(ordinary), self._compressor(toxic + ordinary)
        self._fine = self._compressor(near), self._compressor(toxic + near)
        self._tail, self._usual = near[:FINE_TAIL_BYTES], usual

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=17, search_log=6, min_match=MIN_MATCH,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=shared).compress

    @staticmethod
    def _gain(pair, window: bytes) -> int:
        return len(pair[0](window)) - len(pair[1](window))

    def fine_gain(self, word: bytes) -> int:
        return self._gain(self._fine, word + self._tail) - self._usual

    def features(self, text: str) -> tuple[float, ...]:
        words, best, share, sure, likely = _words(text), 0, 0.0, 0, 0
        for at in range(0, len(words), WINDOW_WORDS):
            part = words[at:at + WINDOW_WORDS]
            if self._gain(self._coarse, b" " + b" ".join(part) + b" " + self._tail[:TAIL_BYTES]) < COARSE_GAIN:
                continue
            for word in part:
                core = b" " + word.strip(EDGE) + b" "
                gain = self.fine_gain(core)
                best, share = max(best, gain), max(share, gain / len(core))
                sure += gain >= 3
                likely += gain >= 2
        n = max(1.0, len(words) / WINDOW_WORDS)
        return (min(best, 6) / 6.0, share, min(sure, 4) / 4.0, min(likely, 6) / 6.0, float(np.log1p(100.0 * likely / n)), float(np.log1p(100.0 * sure / n)))


def _cores(text: str) -> Counter:
    """The words with a space on either side and how often they stand in the text, at most ``REPEATS`` times."""
    counts = Counter(b" " + word.strip(EDGE) + b" " for word in _words(text))
    return Counter({word: min(n, REPEATS) for word, n in counts.items()})


def _all_cores(texts: list[str]) -> Counter:
    """The same of all texts together, so that a word many of them hold is kept once."""
    counts = Counter()
    for text in texts:
        counts.update(_cores(text))
    return counts


def _shingles(word: bytes) -> set[bytes]:
    return {word[i:i + SHINGLE] for i in range(len(word) - SHINGLE + 1)}


def _stems(word: bytes) -> set[bytes]:
    return {word[:n] for n in STEMS if n <= len(word)}


def _over(parts: Callable[[bytes], set[bytes]], toxic: list[Counter], ordinary: Counter, lift: float, least: int) -> set[bytes]:
    """Parts in ``least`` toxic texts or more whose share of the words is at least ``lift`` times that in ordinary ones (all in one)."""
    texts, ours, others = Counter(), Counter(), Counter()
    for words in toxic:
        found = Counter()
        for word, n in words.items():
            for part in parts(word):
                found[part] += n
        ours.update(found)
        texts.update(found.keys())
    known = {part for part, n in texts.items() if n >= least}
    for word, n in ordinary.items():
        for part in parts(word) & known:
            others[part] += n
    rate = max(1, sum(w.total() for w in toxic)) / max(1, ordinary.total())
    return {part for part in known if ours[part] >= lift * rate * (others[part] + 0.5)}


def _toxic_spans(toxic: list[str], ordinary: list[str], lift: float = LIFT, least: int = LEAST) -> list[bytes]:
    """Spans of toxic texts whose shingles or stems are over-represented in them."""
    ours, others = [_cores(t) for t in toxic], _all_cores(ordinary)
    kept, stems = _over(_shingles, ours, others, lift, least), _over(_stems, ours, others, lift, least)
    spans: list[bytes] = []
    for words in ours:
        for word in sorted(words):
            on = [word[i:i + SHINGLE] in kept for i in range(len(word) - SHINGLE + 1)]
            stem = max((n for n in STEMS if n <= len(word) and word[:n] in stems), default=0)
            on[:stem - SHINGLE + 1] = [True] * max(0, stem - SHINGLE + 1)
            at = 0
            while at < len(on):
                if not on[at]:
                    at += 1
                    continue
                end = at
                while end < len(on) and on[end]:
                    end += 1
                spans.append(word[at:end - 1 + SHINGLE])
                at = end
    return spans


_HEADER_END = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))  # of a trained dictionary; its content follows


def _dictionary(samples: list[bytes], size: int, **cover: int) -> bytes:
    """A trained dictionary's content; few samples are used as they are."""
    try:
        trained = zstandard.train_dictionary(size, samples, **cover).as_bytes()
        return trained[trained.index(_HEADER_END) + len(_HEADER_END):]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _windows(text: str) -> list[bytes]:
    words = _words(text)
    return [b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method for ridge logistic regression, toxic rows weighted; the first weight is the bias."""
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    """Contents of the ordinary and of the toxic dictionary."""
    spans = _toxic_spans(toxic, ordinary)
    if not spans:
        return None
    plain = _dictionary([w for text in ordinary for w in _windows(text)], 32768)
    ranked = [s for s, _ in Counter(spans).most_common(TOP_SPANS)]
    return plain, _dictionary(spans, TOXIC_BYTES, k=16, d=6) + b"".join(reversed(ranked))


def _fit_part(toxic: list[str], ordinary: list[str], toxic_held: list[str], ordinary_held: list[str]) -> ToxicPart | None:
    pair = _dictionaries(toxic, ordinary)
    if pair is None:
        return None
    first = _Scorer(*pair)
    held = Counter()
    for text in ordinary_held:
        held.update(_cores(text).keys())
    usual = int(np.median(np.repeat([first.fine_gain(word) for word in held], list(held.values())) if held else [0]))
    scorer = _Scorer(*pair, usual)
    x = np.array([scorer.features(t) for t in toxic_held + ordinary_held])
    y = np.array([1.0] * len(toxic_held) + [0.0] * len(ordinary_held))
    return ToxicPart(*pair, usual, tuple(_logistic(x, y)))


def fit(toxic: list[str], ordinary: list[str]) -> ToxicModel | None:
    """Two parts: dictionaries on even rows with the calibration on odd rows, and the other way round."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return None
    even, odd = (toxic[::2], ordinary[::2]), (toxic[1::2], ordinary[1::2])
    parts = tuple(p for p in (_fit_part(*even, *odd), _fit_part(*odd, *even)) if p)
    return ToxicModel(parts) if parts else None


def train(docs: DataFrame, labels: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> ToxicModel | None:
    """Fit on a bounded sample of labelled rows whose crc32(doc_id) mod 4 is not 2."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("doc_id")
    picked = [usable.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(n)
              for t, n in ((1, bounds.toxic_docs), (0, bounds.ordinary_docs))]
    ids = picked[0].unionByName(picked[1])
    rows = (docs.select("doc_id", "text").where(F.length("text").between(1, bounds.max_chars))
            .join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: r.doc_id)
    toxic, ordinary = ([r.text for r in rows if r.toxic == t] for t in (1, 0))
    del rows
    model = fit(toxic, ordinary)
    del toxic, ordinary
    release()
    return model


def score(docs: DataFrame, model: ToxicModel | None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add the score and the prediction to every row of ``docs`` (columns of other names are kept)."""
    if model is None:
        return docs.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)})

    @F.pandas_udf("double")
    def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        log_odds = model.scorer()
        for texts in batches:
            z = np.array([log_odds(t or "") for t in texts], dtype=float)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

    return (docs.withColumn(names[0], toxic_score(text_or_empty()))
            .withColumn(names[1], F.when(F.col(names[0]) >= THRESHOLD, 1).otherwise(0)))


def toxicity(docs: DataFrame, labels: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = score(docs.select("doc_id", "text"), train(docs, labels, bounds))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
