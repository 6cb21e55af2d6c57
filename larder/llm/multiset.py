"""Document fingerprints: a homomorphic multiset hash of paragraph pieces (operator 8).

The elements of a document are its paragraphs (lines) and, besides, their pieces: a paragraph is cut at
content-defined points, so that an edit changes the pieces it touches only. Each paragraph is hashed to
two 64-bit lanes that are summed modulo 2**64, each piece to 256 lanes of plus or minus one that are
summed modulo 2**32, more than any text has pieces. A fingerprint is the sum over all elements, so it
does not depend on their order, and elements are inserted or deleted by adding or subtracting their
vectors. Texts of equal paragraphs in any order have equal fingerprints, and others have not but by a
collision of 128 bits; the inner product of the piece lanes estimates how many pieces two texts share.

Edge cases: a null text is an empty one; the empty text's fingerprint is the zero vector, and two of
them are alike to 1; a single document is its own next one; equal doc_ids are ordered by a hash of
the row, null ids come first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import shuffle_partitions, text_or_empty

LANES = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CUT = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62) == 0).reshape(256, 256)
_BLOCK = 1 << 14


def paragraphs(text: str) -> list[bytes]:
    """The lines of a text that aren't empty, without outer white space."""
    return [p for p in (line.strip() for line in text.encode("utf-8", "replace").split(b"\n")) if p]


def pieces(paragraph: bytes) -> list[bytes]:
    """Pieces of about four words: cut where the bytes around a space say so."""
    b = np.frombuffer(paragraph, np.uint8)
    at = np.flatnonzero(_SPACE[b])
    cuts = at[_CUT[b[at - 1], b[at + 1]]].tolist()
    found = [paragraph[s:e].strip() for s, e in zip([0, *cuts], [*cuts, len(paragraph)])]
    return [p for p in found if p]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Multiset:
    """A fingerprint that paragraphs can be added to and taken from, in any order."""

    __slots__ = ("wide", "narrow")

    def __init__(self) -> None:
        self.wide = np.zeros(2, np.uint64)
        self.narrow = np.zeros(LANES, np.int32)

    @classmethod
    def of(cls, items: list[bytes]) -> Multiset:
        return cls().add(items)

    def _change(self, items: list[bytes], sign: int) -> Multiset:
        for at in range(0, len(items), _BLOCK):
            part = items[at:at + _BLOCK]
            total = _digests(part).sum(axis=0, dtype=np.uint64)
            self.wide = self.wide + total if sign > 0 else self.wide - total
            inner = [p for item in part for p in pieces(item)]
            for low in range(0, len(inner), _BLOCK):
                some = _digests(inner[low:low + _BLOCK])
                seeds = some[:, :1] + some[:, 1:] * np.arange(1, LANES // 64 + 1, dtype=np.uint64)[None, :]
                ones = np.unpackbits(_mixed(seeds).view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
                self.narrow = self.narrow + sign * (2 * ones - len(some)).astype(np.int32)
        return self

    def add(self, items: list[bytes]) -> Multiset:
        return self._change(items, 1)

    def remove(self, items: list[bytes]) -> Multiset:
        return self._change(items, -1)

    def text(self) -> str:
        """Lanes of small values, as most texts have, are written in two bytes each."""
        small = np.abs(self.narrow).max(initial=0) < 1 << 15
        return base64.b64encode(self.wide.astype("<u8").tobytes() + self.narrow.astype("<i2" if small else "<i4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Multiset:
        raw, out = base64.b64decode(text), cls()
        out.wide = np.frombuffer(raw[:16], "<u8").copy()
        out.narrow = np.frombuffer(raw[16:], "<i2" if len(raw) == 16 + 2 * LANES else "<i4").astype(np.int32)
        return out


def _digests(items: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in items]), "<u8").reshape(-1, 2)


def likeness(a: Multiset, b: Multiset) -> float:
    """About the share of pieces in common (their counts' cosine), between 0 and 1; 1 for equal fingerprints."""
    if np.array_equal(a.wide, b.wide) and np.array_equal(a.narrow, b.narrow):
        return 1.0
    x, y = a.narrow.astype(float), b.narrow.astype(float)
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / size))) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half] if half else text


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted parts: each ends with a copy of the row that follows its last one."""
    held, part, waiting = None, None, True
    for batch in batches:
        out = []
        for place, follows, doc_id, text in zip(batch["place"], batch["follows"], batch["doc_id"], batch["text"]):
            if place != part:
                held, part, waiting = None, place, True
            if not waiting:
                continue
            own = Multiset.of(paragraphs(text))
            if held is not None:
                before, before_text, before_own = held
                changed = edited(before_text, text)
                other = Multiset.of(paragraphs(changed))
                out.append((before, len(before_text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), before_own.text(),
                            other.text(), likeness(before_own, other), likeness(before_own, own)))
            held, waiting = (doc_id, text, own), not follows
        frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield frame.astype({"doc_id": "Int64"})


def _range_of(value, bounds: list[int]):
    """How many of the sorted bounds are at most the value: a coarse search, then one in a slice."""
    step = int(np.ceil(np.sqrt(len(bounds))))
    coarse, fine = (F.lit(b).cast("array<bigint>") for b in (bounds[::step], bounds))
    skip = F.greatest(F.size(F.filter(coarse, lambda b: b <= value)) - 1, F.lit(0)) * step
    return skip + F.size(F.filter(F.slice(fine, skip + 1, step), lambda b: b <= value))


def document_fingerprints(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, dealt out in ranges of doc_id.

    Only range bounds and each range's first row key reach the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    size, known = rows.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    parts = max(1, min(int((size or 0) // part_bytes) + 1, 20000))
    bounds = []
    if parts > 1 and known:
        bounds = sorted({int(q) for q in rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)})
    place = F.lit(0)
    if bounds:
        place = F.when(F.col("doc_id").isNull(), 0).otherwise(_range_of(F.col("doc_id"), bounds))
    keyed = rows.withColumns({"place": place, "row_key": F.xxhash64("doc_id", "text")})
    firsts = (keyed.groupBy("place").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row_key")).alias("first"))
              .select("place", "first.row_key").orderBy("place").collect())
    before = [(firsts[i].row_key, firsts[i - 1].place) for i in range(len(firsts))]
    heads = F.broadcast(spark.createDataFrame(before, "row_key long, target int"))
    copies = keyed.join(heads, "row_key").select(F.col("target").alias("place"), F.lit(True).alias("follows"), "doc_id", "row_key", "text")
    both = keyed.select("place", F.lit(False).alias("follows"), "doc_id", "row_key", "text").unionByName(copies)
    dealt = (both.repartition(max(parts, shuffle_partitions(spark)), "place")
             .sortWithinPartitions("place", "follows", F.col("doc_id").asc_nulls_first(), "row_key"))
    return dealt.select("place", "follows", "doc_id", "text").mapInPandas(_rows, ROW)
