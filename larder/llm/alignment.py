"""Cross-tokenizer alignment (operator 13).

1. One pass encodes every whole text with both tokenizers and lays the tokens' byte ends on one line:
   where both end, a group ends. A pair of tokens overlaps once for every stretch between neighbouring
   ends of either side, so links are found by two binary searches over the merged ends.
2. The identity map is an array from A's ids to the B id of the same bytes. Groups of one A and one B
   token that it explains are kept as their A ids (two bytes each) and counted in vectors as long as the
   vocabulary, one a partition. Only links of the other groups are counted as pairs (four bytes each),
   first in their partition, then by a shuffle on the pair.
3. Counts go back: the vectors and the highest count of each B id are bounded by the vocabularies, the
   most frequent pairs by ``HOT_PAIRS``; these go to all tasks as arrays. A pair below them stands in few
   links by construction, so the rest joins on the pair without a hot key, and is summed by row.

Edge cases: null and empty texts and texts whose joined A or B bytes aren't a space and the text have no
tokens, zeros and '' for the digest, and add nothing to the counts. Repeated rows count each; doc_id is
only carried, so it may be null or repeated. An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import cut

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: The split of the byte-level tokenizer before its merges (fixed value of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HOT_PAIRS = 1 << 20  # 12 bytes each to all tasks
_CHUNK = 1 << 20  # characters of text whose tokens are laid out at a time
_DONE = "n_a long, n_b long, n_groups long, n_links long"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both vocabularies as bytes by id, and the encoders, which every task builds once from the files' contents."""

    a_ranks: dict[bytes, int]
    b_model: bytes
    a_bytes: list[bytes] = field(default_factory=list)
    b_bytes: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        import sentencepiece

        self.a_bytes = [b""] * (max(self.a_ranks.values()) + 1)
        for token, i in self.a_ranks.items():
            self.a_bytes[i] = token
        b = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        if max(len(self.a_bytes), b.vocab_size()) > 1 << 16:
            raise ValueError("ids of more than two bytes")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.vocab_size())))]
        ids = [i for i in range(b.vocab_size()) if not (b.is_control(i) or b.is_unknown(i))]
        known = {self.b_bytes[i]: i for i in sorted(ids, key=lambda i: not b.is_byte(i))}  # a piece goes before a byte
        self.identity = np.array([known.get(t, -1) for t in self.a_bytes], np.int64)

    def encoders(self):
        import sentencepiece
        import tiktoken

        a = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=self.a_ranks, special_tokens={})
        return a.encode_ordinary, sentencepiece.SentencePieceProcessor(model_proto=self.b_model).encode


def load_tokenizers(a_path: str = A_PATH, b_path: str = B_PATH) -> Tokenizers:
    """Read both files on the driver. A's ids must be the ranks of its merges."""
    with open(a_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    with open(b_path, "rb") as f:
        b_model = f.read()
    values = byte_values()
    ranks = {bytes(values[c] for c in token): i for token, i in model["vocab"].items()}
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("the ids of the byte-level vocabulary are not in merge order")
    return Tokenizers(ranks, b_model)


class Aligner:
    """Encodes texts and lays out their tokens; one a task."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.a, self.b = tokenizers.encoders()
        self.a_bytes, self.b_bytes, self.identity = tokenizers.a_bytes, tokenizers.b_bytes, tokenizers.identity
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_words = [np.array([f"{i}{mark}" for i in range(len(self.a_bytes))], object) for mark in ",|"]
        self.b_words = [np.array([f"{i}{mark}" for i in range(len(self.b_bytes))], object) for mark in ",;"]

    def encoded(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides, or none where either side's bytes aren't a space and the text."""
        if text:
            a, b, whole = self.a(" " + text), self.b(text), b" " + text.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                return a, b
        return [], []

    def rows(self, texts: list[str | None]) -> dict[str, list]:
        """Counts, digest and packed links of every text."""
        pairs = [self.encoded(t) for t in texts]
        a = np.fromiter((i for x, _ in pairs for i in x), np.int64)
        b = np.fromiter((i for _, x in pairs for i in x), np.int64)
        a_docs, b_docs = (np.cumsum([len(p[side]) for p in pairs]) for side in (0, 1))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        doc_end = np.concatenate([[0], a_end])[a_docs]
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        in_a, in_b = (np.bincount(g, minlength=len(common)) for g in (a_group, b_group))
        ends = np.union1d(a_end, b_end)
        link_a, link_b = a[np.searchsorted(a_end, ends)], b[np.searchsorted(b_end, ends)]
        group = np.searchsorted(common, ends)
        plain = (in_a[group] == 1) & (in_b[group] == 1) & (self.identity[link_a] == link_b)

        def split(ends_of: np.ndarray) -> list[int]:
            return np.searchsorted(ends_of, doc_end, "right").tolist()

        words = np.empty(len(a) + len(b), object)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        words[np.arange(len(a)) + upto_b[a_group] - in_b[a_group]] = self._words(self.a_words, a, a_group)
        words[np.arange(len(b)) + upto_a[b_group]] = self._words(self.b_words, b, b_group)
        same, odd = link_a[plain].astype(np.uint16), (link_a[~plain] << 16 | link_b[~plain]).astype(np.uint32)
        groups, links = split(common), split(ends)
        same_to = np.searchsorted(ends[plain], doc_end, "right").tolist()
        odd_to = np.searchsorted(ends[~plain], doc_end, "right").tolist()
        out: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "odd")}
        at = [0] * 6
        for to in zip(a_docs.tolist(), b_docs.tolist(), groups, links, same_to, odd_to, strict=True):
            text = "".join(words[at[0] + at[1]:to[0] + to[1]].tolist())[:-1]
            found = *(t - f for t, f in zip(to[:4], at, strict=False)), sha256(text.encode()).hexdigest() if text else "", same[at[4]:to[4]].tobytes(), odd[at[5]:to[5]].tobytes()
            for held, value in zip(out.values(), found, strict=True):
                held.append(value)
            at = to
        return out

    @staticmethod
    def _words(words: list[np.ndarray], ids: np.ndarray, group: np.ndarray) -> np.ndarray:
        last = np.append(group[1:] != group[:-1], True)[:len(ids)]
        return np.where(last, words[1][ids], words[0][ids])


def laid_out(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(doc_id, counts, groups_sha256, same, odd): both tokenizations of every row, links packed."""
    held = docs.sparkSession.sparkContext.broadcast((tokenizers.a_ranks, tokenizers.b_model))  # both files, under 2 MB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(Tokenizers(*held.value))
        for frame in frames:
            sizes = frame["text"].map(lambda t: len(t or "")).cumsum() // _CHUNK
            for _, part in frame.groupby(sizes, sort=False):
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").reset_index(drop=True)} | aligner.rows(part["text"].tolist()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id long, {_DONE}, groups_sha256 string, same binary, odd binary")


def pair_counts(laid: DataFrame, identity: np.ndarray) -> DataFrame:
    """(pair, n): links of the corpus by pair, a << 16 | b; one-to-one groups come in as sums of vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vector = np.zeros(len(identity), np.int64)
        pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for frame in frames:
            vector += np.bincount(np.frombuffer(b"".join(frame["same"]), np.uint16), minlength=len(vector))
            new = np.unique(np.frombuffer(b"".join(frame["odd"]), np.uint32), return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, new[0]]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, new[1]]), len(pairs)).astype(np.int64)
            if len(pairs) > HOT_PAIRS:
                yield pd.DataFrame({"pair": pairs.astype(np.int64), "n": counts})
                pairs, counts = pairs[:0], counts[:0]
        seen = np.flatnonzero(vector)
        yield pd.DataFrame({"pair": np.concatenate([seen << 16 | identity[seen], pairs.astype(np.int64)]), "n": np.concatenate([vector[seen], counts])})

    return laid.select("same", "odd").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def hot_limit(pairs: DataFrame, most: int = HOT_PAIRS) -> int:
    """The smallest power of two that at most ``most`` pairs reach."""
    sizes = pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()  # at most 64 rows
    limit, held = 64, 0
    for row in sorted(sizes, key=lambda r: -r.bits):
        held += row["count"]
        if held > most:
            break
        limit = row.bits - 1
    return 1 << min(limit, 62)


def aligned(docs: DataFrame, tokenizers: Tokenizers | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    tokenizers = tokenizers or load_tokenizers()
    identity = tokenizers.identity
    laid = cut(laid_out(docs, tokenizers))
    pairs = cut(pair_counts(laid, identity))
    b = F.col("pair").bitwiseAND(0xFFFF)
    best = np.zeros(len(tokenizers.b_bytes), np.int64)
    for row in pairs.groupBy(b.alias("b")).agg(F.max("n").alias("n")).collect():
        best[row.b] = row.n
    a_known = np.flatnonzero(identity >= 0)
    codes = spark.createDataFrame(pd.DataFrame({"pair": a_known << 16 | identity[a_known]}))  # one row an A id at most
    totals = np.zeros(len(identity), np.int64)
    for row in pairs.join(F.broadcast(codes), "pair").collect():
        totals[row.pair >> 16] = row.n
    limit = hot_limit(pairs, hot_pairs)
    hot = pairs.where(F.col("n") >= limit).toPandas().sort_values("pair")
    hot_code, hot_n = hot["pair"].to_numpy(np.uint32), hot["n"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast((hot_code, hot_n, totals, identity, best))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, n, total, to_b, highest = sent.value
        plain_best = (total == highest[to_b]) & (to_b >= 0)
        hot_best = n == highest[code & 0xFFFF]
        for frame in frames:
            sums, bests, cold = [], [], []
            for same, odd in zip(frame["same"], frame["odd"], strict=True):
                a, links = np.frombuffer(same, np.uint16), np.frombuffer(odd, np.uint32)
                at = np.searchsorted(code, links)
                known = at < len(code)
                known[known] = code[at[known]] == links[known]
                sums.append(int(total[a].sum() + n[at[known]].sum()))
                bests.append(int(plain_best[a].sum() + hot_best[at[known]].sum()))
                cold.append(links[~known].astype(np.int64))
            yield frame.drop(columns=["same", "odd"]).assign(doc_id=frame["doc_id"].astype("Int64"), count_sum=sums, n_best=bests, cold=cold)

    numbered = laid.withColumn("row_no", F.monotonically_increasing_id())
    part = numbered.mapInPandas(run, f"doc_id long, {_DONE}, groups_sha256 string, row_no long, count_sum long, n_best long, cold array<long>")
    out = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    if limit <= 1:  # every pair went to all tasks
        return part.select(*out)
    part = cut(part)
    rare = pairs.where(F.col("n") < limit)
    top = spark.createDataFrame(pd.DataFrame({"b": np.arange(len(best)), "most": best}))
    rare = rare.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    links = part.select("row_no", F.explode("cold").alias("pair")).groupBy("row_no", "pair").agg(F.count("*").alias("times"))
    rest = links.join(rare, "pair").groupBy("row_no").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.col("times") * F.col("is_best")).alias("more_best"))
    whole = part.drop("cold").join(rest, "row_no", "left")
    return whole.withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))}).select(*out)
