"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 11).

1. Vectors become whole numbers (floor of ``SCALE`` times the component) and are packed where they are
   read: a block holds vectors of one width, at most ``BLOCK_BYTES``, with their ids.
2. Blocks meet in tiles: candidates are dealt into shards, queries into groups, both of bounded bytes,
   and one cogroup a (shard, group) gets both. Query blocks go once to every shard and candidate blocks
   once to every group, so what a task holds is bounded and nothing is broadcast or collected.
3. In a tile the candidates' components are turned into postings by term (a component's index): rows
   and weights of the values that aren't zero, or the whole column where most of them aren't. A query
   is the sparse row of its own non-zero terms; each of them scatters its weighted postings into a dense
   array of scores, one cell a candidate, so every candidate's score is whole.
4. Partition selection takes a tile's k best, and a window over all tiles merges them.

Scores are exact: 32 or 64 bit where the tile's largest values allow it, whole numbers of any size
otherwise, which are held to the range of a long at the end.

Edge cases: vectors null or with a component that is null or not finite (also after scaling) take no
part; an empty vector has score 0 with all; vectors of different width count as zero beyond their end.
A vec_id on several rows is asked once, by its smallest vector, and none of its own rows are its
candidates; as candidates repeated rows count one by one. Rows without a vec_id are candidates only and
come last in ties. No queries or no rows give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import shuffle_partitions

SCALE = 256
QUERY_STEP = 50
K = 5
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 64 << 20  # packed candidates of a tile
GROUP_BYTES = 8 << 20  # packed queries of a tile
_LONG = np.iinfo(np.int64)
_BLOCK = "n long, width int, kind string, ids binary, nulls binary, weights binary, place long"
_FOUND = "query_id long, vec_id long, score long"

#: DuckDB SQL for the registered query.
ORACLE_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
    FROM (SELECT vec_id, min(w) AS w FROM whole WHERE vec_id % 50 = 0 GROUP BY vec_id) q
    JOIN whole c ON c.vec_id IS DISTINCT FROM q.vec_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part."""
    out = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    return out.where(F.col("vector").isNotNull() & finite)


def _packed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part_no, made = TaskContext.get().partitionId(), 0
    for frame in rows:
        widths = frame["vector"].map(len).to_numpy(np.int64)
        for width in np.unique(widths):
            part = frame[widths == width]
            step = max(1, BLOCK_BYTES // max(8 * int(width), 64))
            for start in range(0, len(part), step):
                cut = part.iloc[start:start + step]
                values = np.floor(SCALE * np.stack(cut["vector"].to_list()).astype(np.float64)).reshape(len(cut), width)
                most = np.abs(values).max(initial=0)
                kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "float64"
                missing = cut["vec_id"].isna().to_numpy()
                ids = cut["vec_id"].astype("Int64").fillna(_LONG.max).to_numpy(np.int64)
                yield pd.DataFrame({"n": [len(cut)], "width": [int(width)], "kind": [kind], "ids": [ids.tobytes()], "nulls": [missing.tobytes()],
                                    "weights": [values.astype(kind).tobytes()], "place": [(part_no << 32) + made]})
                made += 1


def packed(vectors: DataFrame) -> DataFrame:
    """Blocks of ``usable`` rows; ``place`` tells them apart, whatever they hold.

    Rows are sorted in their partition, so a task that runs again makes the same blocks.
    """
    return vectors.sortWithinPartitions("vec_id", "vector").mapInPandas(_packed, _BLOCK)


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row.weights, row.kind).reshape(row.n, row.width)


class Postings:
    """Candidates of a tile by term: a whole column, or the rows and weights of values other than zero."""

    def __init__(self, blocks: list, dtype) -> None:
        self.ids = np.concatenate([np.frombuffer(b.ids, np.int64) for b in blocks])
        self.missing = np.concatenate([np.frombuffer(b.nulls, bool) for b in blocks])
        self.n = len(self.ids)
        by_term: dict[int, list[tuple[int, np.ndarray]]] = {}
        start = 0
        for block in blocks:
            matrix = _matrix(block)
            for term in np.flatnonzero((matrix != 0).any(axis=0)):
                by_term.setdefault(int(term), []).append((start, matrix[:, term]))
            start += block.n
        self.lists = {}
        for term, parts in by_term.items():
            rows = np.concatenate([s + np.flatnonzero(v) for s, v in parts])
            weights = np.concatenate([v[np.flatnonzero(v)] for _, v in parts])
            weights = weights.astype(dtype) if dtype is not object else np.array([int(w) for w in weights], object)
            if 2 * len(rows) > self.n:
                column = np.zeros(self.n, dtype)
                column[rows] = weights
                rows, weights = None, column
            self.lists[term] = rows, weights

    def scores(self, terms: np.ndarray, weights: list, dtype) -> np.ndarray:
        """Dense scores of one sparse query row, a term at a time."""
        found = np.zeros(self.n, dtype)
        for term, weight in zip(terms.tolist(), weights, strict=True):
            if term in self.lists:
                rows, held = self.lists[term]
                if rows is None:
                    found += held * weight
                else:
                    found[rows] += held * weight
        return found


def _best(postings: Postings, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best candidates: partition selection, then the ties at the edge by id."""
    at = np.flatnonzero(postings.missing | (postings.ids != own))
    held = scores[at]
    if held.dtype == object:
        held = np.array([min(max(x, _LONG.min), _LONG.max) for x in held], np.int64)
    if len(at) > k:
        edge = np.partition(held, len(held) - k)[len(held) - k]
        at, held = at[held >= edge], held[held >= edge]
    order = np.lexsort((postings.ids[at], postings.missing[at], ~held.astype(np.int64)))[:k]
    return np.stack([at[order], held[order]])


def _dtype(candidates: list, queries: list):
    """The narrowest type that no partial sum of the tile can leave."""
    reach = [max((float(np.abs(_matrix(b).astype(np.float64)).max(initial=0)) for b in side), default=0.0) for side in (candidates, queries)]
    bound = reach[0] * reach[1] * max((b.width for b in candidates), default=1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 2.0**62 else object


def _tile(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        c, q = list(candidates.itertuples(index=False)), list(queries.itertuples(index=False))
        if not c or not q:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})
        dtype = _dtype(c, q)
        postings, out = Postings(c, dtype), []
        for block in q:
            for own, row in zip(np.frombuffer(block.ids, np.int64).tolist(), _matrix(block), strict=True):
                terms = np.flatnonzero(row)
                at, held = _best(postings, postings.scores(terms, [int(x) for x in row[terms]], dtype), own, k)
                out.append((np.full(len(at), own), postings.ids[at], postings.missing[at], held))
        query, ids, missing, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": query, "vec_id": pd.Series(ids, dtype="Int64").mask(missing), "score": score})

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row.

    Both frames are ``usable`` ones; queries without a vec_id are not asked.
    """
    spark = candidates.sparkSession
    asked = queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    wide = F.greatest(F.lit(64), 2 * F.size("vector")).cast("long")
    rows_bytes = [df.agg(F.coalesce(F.sum(wide), F.lit(0)).alias("b")).first().b for df in (candidates, asked)]
    shards = max(shuffle_partitions(spark), -(-rows_bytes[0] // SHARD_BYTES))
    groups = max(1, -(-rows_bytes[1] // GROUP_BYTES))

    def dealt(blocks: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return blocks.select("*", F.pmod(F.xxhash64("place"), F.lit(n)).cast("long").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    left = dealt(packed(candidates), "shard", shards, "group", groups)
    right = dealt(packed(asked), "group", groups, "shard", shards)
    tiles = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group"))
    found = tiles.applyInPandas(_tile(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """``top_k`` of all rows for the rows whose vec_id is divisible by ``step``."""
    rows = usable(vectors)
    return top_k(rows, rows.where(F.col("vec_id") % step == 0), k)
