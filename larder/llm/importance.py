"""Target-distribution importance resampling (operator 12).

1. One pass cuts every whole text into words and hashes runs of one and two words into buckets; a
   document's buckets are kept as two bytes each, beside its id.
2. Bucket counts of the corpus and of the target texts give one gain a bucket (10,000 numbers, the only
   thing sent to all tasks); a document's weight is the floored mean of its buckets' gains, gathered
   from the array.
3. Gumbel noise from the id makes the draw without replacement a choice of the highest scores. The
   k-th composite key (score down, doc_id up) is found by distributed quickselect: random rows inside the
   open interval are pivots, one aggregate counts exactly what is before and at each, and the interval
   narrows until a pivot holds the k-th place. Only the winners are sorted and ranked.

Edge cases: null and empty texts have no features and weight 0; a null doc_id is hashed as an empty one
and is last in ties; rows of equal score and doc_id are drawn one by one until the number is reached;
an empty table gives an empty one and an empty target counts 0 in every bucket; extra columns are
ignored. A long text is cut into words by windows, so its words are never held at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from larder.llm.common import cut

BUCKETS = 10_000
MIN_WORDS = 20
DRAW_PERCENT = 25
SEED = 7
PIVOTS = 16  # keys that a round of the quickselect compares
_WINDOW = 1 << 20  # bytes of text that are cut into words at a time
#: What isn't a digit, a letter a-z or a byte of another character parts words; A-Z are lower-cased.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _windows(text: str) -> Iterator[list[bytes]]:
    """Words of a text by windows; a word is whole, however long."""
    rest = b""
    for start in range(0, len(text), _WINDOW):
        data = rest + text[start:start + _WINDOW].encode().translate(_WORDS)
        end = data.rfind(b" ") + 1 if start + _WINDOW < len(text) else len(data)
        rest = data[end:]
        yield data[:end].split()


def buckets_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of one and two words."""
    found, last = [], None
    for words in _windows(text or ""):
        if words:
            own = list(map(crc32, words))
            spaced = [b" " + w for w in (words[1:] if last is None else words)]
            runs = map(crc32, spaced, own[:-1] if last is None else [last, *own[:-1]])  # a crc is carried on by the next bytes
            found.append((np.array([*own, *runs], np.uint32) % buckets).astype(np.uint16))
            last = own[-1]
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def featured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_features, buckets): every row's buckets, two bytes each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [buckets_of(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_features": [len(h) for h in held], "buckets": [h.tobytes() for h in held]})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(run, "doc_id long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of ``featured`` rows each bucket holds; one vector a partition is summed by bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            total += np.bincount(np.frombuffer(b"".join(frame["buckets"]), np.uint16), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    out = np.zeros(BUCKETS, np.int64)
    for row in rows.select("buckets").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier the target holds a bucket, one count added to each."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1) * all_s) / ((s + 1) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) by gathering from the array of gains."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = [int(gain[np.frombuffer(b, np.uint16)].sum()) for b in frame["buckets"]]
            weight = [s // n if n else 0 for s, n in zip(sums, frame["n_features"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_features": frame["n_features"], "weight": weight})

    return rows.mapInPandas(run, "doc_id long, n_features long, weight long")


def with_score(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``score``: the weight and the id's own Gumbel noise, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def _key() -> Column:
    """Smaller comes first: score down, doc_id up, no doc_id last."""
    return F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"))


def _literal(key: Row) -> Column:
    return F.struct(F.lit(key.s).cast("long").alias("s"), F.lit(key.n).alias("n"), F.lit(key.d).cast("long").alias("d"))


def kth_key(rows: DataFrame, k: int, seed: int = SEED) -> Row:
    """The k-th smallest composite key (from 1); ``rows`` hold k rows at least and are cut from their lineage."""
    inside, left, turn = rows.select(_key().alias("key")), k, 0
    while True:
        turn += 1
        drawn = inside.orderBy(F.rand(seed + turn)).limit(PIVOTS).collect()
        pivots = sorted({tuple(r.key): r.key for r in drawn}.items())
        counts = inside.agg(*(F.count_if(F.col("key") < _literal(p)).alias(f"before{i}") for i, (_, p) in enumerate(pivots)),
                            *(F.count_if(F.col("key") == _literal(p)).alias(f"at{i}") for i, (_, p) in enumerate(pivots))).first()
        low = high = None
        passed = 0
        for i, (_, pivot) in enumerate(pivots):
            before, at = counts[f"before{i}"], counts[f"at{i}"]
            if before < left <= before + at:
                return pivot
            if left <= before:
                high = pivot
                break
            low, passed = pivot, before + at
        left -= passed
        if low is not None:
            inside = inside.where(F.col("key") > _literal(low))
        if high is not None:
            inside = inside.where(F.col("key") < _literal(high))


def ranked(scored: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``rank`` from 1 for the drawn rows, null for the others; ``scored`` is read several times, so cut it before."""
    ready = F.col("n_features") >= 2 * min_words - 1  # n words make 2n - 1 features
    k = scored.where(ready).count() * percent // 100
    none = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return scored.select("*", none)
    last = _literal(kth_key(scored.where(ready), k, seed))
    won = ready & (_key() <= last)
    winners = cut(scored.where(won).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    place = F.monotonically_increasing_id()  # partition above bit 33, row in it below
    placed = winners.select("*", F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_row"))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, offsets = 0, []
    for part in range(max(sizes) + 1):
        offsets.append(before)
        before += sizes.get(part, 0)
    rank = F.element_at(F.array(*map(F.lit, offsets)), F.col("_part") + 1) + F.col("_row") + 1
    drawn = placed.select(*scored.columns, F.when(rank <= k, rank).cast("long").alias("rank"))
    return drawn.unionByName(scored.where(~won).select("*", none))


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``target`` has a text column."""
    held = cut(featured(docs))
    aim = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(bucket_counts(held), bucket_counts(aim))
    return ranked(cut(with_score(weighted(held, gain), seed)), percent, MIN_WORDS, seed)
