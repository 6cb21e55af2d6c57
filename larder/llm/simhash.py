"""SimHash near-duplicates through pivot distance tables (operator 7).

1. Every text gets a 64-bit fingerprint of its word shingles (Arrow batches, whole texts).
2. Distinct fingerprints are dealt out by pigeonhole: of five bit blocks at least two are equal in
   fingerprints at three or fewer differing bits, so each goes to the ten buckets of its block pairs.
   (A pivot's coordinate alone cannot deal rows out: distances to a pivot crowd around 32.)
3. For each fingerprint the Hamming distances to sixteen pivots are precomputed. Inside a bucket
   rows are ordered by the first coordinate; pairs whose largest coordinate difference is over the
   limit are discarded (triangle inequality), pairs already joined are skipped, survivors verified.
   A bucket yields a spanning forest of its links, so rows out are fewer than rows in.
4. Buckets over ``TILE`` rows are salted: each pair of chunks is a group of its own, so no task holds
   an unbounded bucket and no pair is lost.
5. Components come from alternating star contraction over the forest edges, checkpointed per round.

``similar_documents`` proposes pairs by two fingerprints and joins those only whose five-word shingle
sets are alike to ``ALIKE`` by exact count.

Edge cases: a null text is an empty one; texts without words get fingerprint zero and link like any
other; exact copies share a fingerprint and are collapsed before any pairing; a null doc_id is never
a component_id unless all members' ids are null; empty tables give empty tables; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, shuffle_partitions, text_or_empty

SEED = 42
MAX_BITS = 3
BLOCKS = (13, 13, 13, 13, 12)
PIVOTS = 16
SAMPLED_TABLES, SAMPLED_BITS = 64, 18
WIDE_BITS = 30
ALIKE = 0.8  # least Jaccard of five-word shingle sets of similar documents
TILE = 1024
BROADCAST_BUCKETS = 1 << 14  # rows of three numbers
_CHUNK = 1 << 15


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id and fp (long) for every row."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t or "", shingle_words) for t in texts], dtype="int64")

    return docs.select("doc_id", simhash(text_or_empty()).alias("fp"))


def _masks() -> list[int]:
    """Signed masks of every pair of bit blocks."""
    blocks, at = [], 0
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    pairs = [blocks[i] | blocks[j] for i in range(len(blocks)) for j in range(i)]
    return [m - (1 << 64) if m >> 63 else m for m in pairs]


def _pivots() -> list[int]:
    """Reference fingerprints: fixed hashes of the numbers from 0."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).astype(np.int64)) for i in range(PIVOTS)]


def _packed_distances(fp, pivots: list[int]):
    """Eight distances, one byte each, in a long."""
    packed = F.lit(0).cast("long")
    for k, pivot in enumerate(pivots):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long"), 8 * k))
    return packed


def _sampled_masks(tables: int = SAMPLED_TABLES, width: int = SAMPLED_BITS) -> list[int]:
    """Signed masks of randomly drawn bits, fixed by a seed."""
    rng = np.random.default_rng(SEED)
    masks = [sum(1 << int(b) for b in rng.choice(64, width, replace=False)) for _ in range(tables)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(group: np.ndarray, fps: np.ndarray, more: np.ndarray, nodes: np.ndarray, table: np.ndarray, max_bits: int, as_linked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of links of at most ``max_bits`` inside equal ``group`` runs.

    Rows are ordered by group, then by the first pivot coordinate. Edges run from roots, or between
    the rows whose link joined two trees (``as_linked``).
    """
    n = len(fps)
    root = np.arange(n)
    joined: list[tuple[int, int]] = []
    first = table[:, 0].astype(np.int16)
    ends = np.searchsorted(group, group, side="right")
    left, shift = np.arange(n), 0
    while True:
        shift += 1
        left = left[left + shift < ends[left]]
        left = left[first[left + shift] - first[left] <= max_bits]  # the order makes this final
        if not len(left):
            break
        a = left[root[left] != root[left + shift]]
        b = a + shift
        near = np.abs(table[a].astype(np.int16) - table[b].astype(np.int16)).max(axis=1, initial=0) <= max_bits
        a, b = a[near], b[near]
        close = np.bitwise_count(fps[a] ^ fps[b]).astype(np.int16) + np.bitwise_count(more[a] ^ more[b]) <= max_bits
        merged = False
        for x, y in zip(a[close].tolist(), b[close].tolist()):
            pair = x, y
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                merged = True
                joined.append(pair)
        if merged:
            while not np.array_equal(up := root[root], root):
                root = up
    if as_linked:
        x, y = np.array(joined, np.int64).reshape(-1, 2).T
        return nodes[x], nodes[y]
    child = np.flatnonzero(root != np.arange(n))
    return nodes[root[child]], nodes[child]


def _all_links(group: np.ndarray, fps: np.ndarray, more: np.ndarray, nodes: np.ndarray, table: np.ndarray, max_bits: int, parts: np.ndarray, mask: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every link between rows of different ``parts``, in the first mask that its rows agree on."""
    first = table[:, 0].astype(np.int16)
    ends = np.searchsorted(group, group, side="right")
    left, shift, found = np.arange(len(fps)), 0, [(nodes[:0], nodes[:0])]
    while True:
        shift += 1
        left = left[left + shift < ends[left]]
        left = left[first[left + shift] - first[left] <= max_bits]
        if not len(left):
            break
        a = left[parts[left] != parts[left + shift]]
        a = a[np.abs(table[a].astype(np.int16) - table[a + shift].astype(np.int16)).max(axis=1, initial=0) <= max_bits]
        bits = fps[a] ^ fps[a + shift]
        close = np.bitwise_count(bits).astype(np.int16) + np.bitwise_count(more[a] ^ more[a + shift]) <= max_bits
        a, bits = a[close], bits[close]
        a = a[(bits[:, None] & masks[None, :] == 0).argmax(axis=1) == mask[a]]
        found.append((nodes[a], nodes[a + shift]))
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def _links_in(batches: Iterator[pd.DataFrame], max_bits: int, masks: list[int], kind: str) -> Iterator[pd.DataFrame]:
    """Edges of sorted buckets; a bucket may reach over batches, and is at most two chunks."""
    held: list[pd.DataFrame] = []

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[["mask", "key", "low", "high"]].to_numpy()
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
        table = rows[["d0", "d1"]].to_numpy(np.int64).copy().view(np.uint8)
        fps, more = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "fp2"))  # signed bits would be counted of absolute values
        nodes = rows["node"].to_numpy(np.int64)
        if kind == "all":
            u, v = _all_links(group, fps, more, nodes, table, max_bits, rows["part"].to_numpy(np.int64), rows["mask"].to_numpy(), np.array(masks, np.int64).view(np.uint64))
        else:
            u, v = _forest(group, fps, more, nodes, table, max_bits, kind == "linked")
        return pd.DataFrame({"u": u, "v": v})

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        key = rows[["mask", "key", "low", "high"]].to_numpy()
        tail = int((key != key[-1]).any(axis=1).sum())  # rows of the last bucket stay for the next batch
        if tail:
            yield solve(rows.iloc[:tail])
        held = [rows.iloc[tail:].reset_index(drop=True)]
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def _in_buckets(fps: DataFrame, masks: list[int], more: list[str]) -> DataFrame:
    """A row a fingerprint and mask with its bucket (mask, key) and tile (low, high); several only in buckets over ``TILE`` rows."""
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    held = ["node", "fp", "fp2", *more]
    rows = fps.select(*held, F.explode(keys).alias("k")).select("k.mask", "k.key", *held)
    # Only buckets over a tile are dealt anew, so that each text has one row a mask whatever chance brings into its buckets.
    hot = cut(rows.groupBy("mask", "key").agg(F.count("*").alias("size")).where(F.col("size") > TILE))
    n_hot, low, high = hot.count(), F.lit(0).alias("low"), F.lit(0).alias("high")
    tiled = rows.select("mask", "key", low, high, *held)
    if n_hot:
        sizes = F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot
        chunks = F.ceil(F.col("size") / TILE).cast("int")
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                            lambda j: F.struct(F.least(F.col("chunk"), j).alias("low"), F.greatest(F.col("chunk"), j).alias("high")))
        large = (rows.join(sizes, ["mask", "key"]).withColumn("chunks", chunks).withColumn("chunk", chunk)
                 .select("mask", "key", *held, F.explode(tiles).alias("t")).select("mask", "key", "t.low", "t.high", *held))
        tiled = rows.join(sizes, ["mask", "key"], "left_anti").select("mask", "key", low, high, *held).unionByName(large)
    return tiled


def links(fps: DataFrame, max_bits: int = MAX_BITS, masks: list[int] | None = None, kind: str = "roots") -> DataFrame:
    """Edges (u, v) between nodes that connect all linked fingerprints; ``fps`` has node, fp and fp2.

    Edges run from the roots of the buckets' trees, or between linked nodes only (``kind`` linked), or
    are all links between nodes of different ``part`` (``kind`` all; ``fps`` has part too).

    Without ``masks`` no link is lost: the bits of fp and fp2 that differ are at most 3, all in fp's
    block pairs. With ``masks`` a link is found if it agrees on one mask of fp at least.
    """
    if masks is None and not 0 <= max_bits < len(BLOCKS) - 1:
        raise ValueError(f"max_bits is 0 to {len(BLOCKS) - 2}")
    pivots = _pivots()
    dealt = (_in_buckets(fps, masks or _masks(), ["part"] * (kind == "all")).repartition(shuffle_partitions(fps.sparkSession), "mask", "key", "low", "high")
             .withColumns({"d0": _packed_distances(F.col("fp"), pivots[:8]), "d1": _packed_distances(F.col("fp"), pivots[8:])})
             .sortWithinPartitions("mask", "key", "low", "high", F.col("d0").bitwiseAND(F.lit(255)), "node"))
    return dealt.mapInPandas(lambda batches: _links_in(batches, max_bits, masks or _masks(), kind), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(v, u): for every node that isn't its component's smallest, that smallest node.

    Alternating large-star and small-star rounds, each of which ends in the checkpoint folder, until the
    edges are stars: their centres, being smaller than their leaves, are the smallest nodes.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u <> v").distinct())

    def are_stars(df: DataFrame) -> bool:
        ends = F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("u").alias("node"), F.lit(0).alias("leaf")))
        nodes = df.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.leaf").alias("leaf"), F.count("*").alias("n"))
        return nodes.where("leaf > 0 AND n > 1").count() == 0

    while not are_stars(edges):
        ways = F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))
        both = edges.select(F.explode(ways).alias("way")).select("way.v", "way.u")
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # No more rows than edges; equal ones go at the round's end.
        large = cut(both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v")
        edges = cut(small.unionAll(least.select("v", F.col("m").alias("u"))).distinct())
    return edges


def _named(fps: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """``fps`` with root, one for each group, and component_id, the smallest doc_id reachable; ``distinct`` has node and least_id, ``roots`` is of ``components``."""
    rooted = distinct.join(roots.select(F.col("v").alias("node"), F.col("u").alias("root")), "node", "left")
    rooted = rooted.select("node", "least_id", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(ids, "root").select("node", "root", "component_id")
    return fps.join(named, "node")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (long) and component_id (smallest reachable doc_id) for every row."""
    fps = cut(fingerprints(docs, shingle_words).select("doc_id", F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("fp2")))
    distinct = fps.groupBy("node", "fp", "fp2").agg(F.min("doc_id").alias("least_id"))
    return _named(fps, distinct, components(links(distinct, max_bits))).select("doc_id", "fp", "component_id")


def shingle_set(text: str, shingle_words: int = 5) -> np.ndarray:
    """Hashes of the text's distinct word shingles; none for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = {digest(b" ".join(words[i:i + shingle_words]), SEED) for i in range(max(1, len(words) - shingle_words + 1))}
    return np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)


def _alike(docs: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """``edges`` (u, v: xxhash64 of texts) and whether the Jaccard of their shingle sets is ``least`` or more."""

    @F.pandas_udf("array<long>")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t) for t in texts], dtype="object")

    asked = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = docs.select(F.xxhash64(text_or_empty()).alias("node"), text_or_empty().alias("text")).join(asked, "node", "left_semi")
    sets = texts.groupBy("node").agg(F.first("text").alias("text")).select("node", shingled("text").alias("s"))
    both = edges.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    whole = F.size("a") + F.size("b") - shared
    return cut(both.select("u", "v", (shared >= F.lit(least) * whole).alias("alike")))


def similar_documents(docs: DataFrame, max_bits: int = WIDE_BITS, least: float = ALIKE) -> DataFrame:
    """doc_id, component_id, content and root of documents joined by pairs whose five-word shingle sets are alike to 0.8.

    Two fingerprints, of three-word and of five-word shingles, propose pairs that together differ in
    ``max_bits`` of 128 bits (unrelated texts differ in about 64). Bits that differ are too many for a
    pigeonhole, so buckets are made of sampled bits of the first fingerprint: at 8 bits apart the
    chance to share one of the 64 tables is 0.99.

    Buckets first give forests of links, and each of their pairs is verified. Where all pairs of a
    group hold, it is whole. In other groups every link between parts not yet joined is verified, so
    no proposed pair is lost to one that failed.

    ``content`` is xxhash64 of the text (null: empty), ``root`` names the group: where a doc_id has several
    texts, groups of one component_id are told apart by it.
    """

    @F.pandas_udf("fp long, fp2 long")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(fingerprint(t or "", 3), fingerprint(t or "", 5)) for t in texts], columns=["fp", "fp2"], dtype="int64")

    pairs = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("node"), both(text_or_empty()).alias("p"))
    fps = cut(pairs.select("doc_id", "node", "p.fp", "p.fp2"))
    distinct, masks = fps.groupBy("node", "fp", "fp2").agg(F.min("doc_id").alias("least_id")), _sampled_masks()
    tested = _alike(docs, cut(links(distinct, max_bits, masks, "linked").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), least)
    roots = components(tested.where("alike").select("u", "v"))
    failed = tested.where("not alike").select("u", "v")
    if not failed.isEmpty():
        groups = components(roots.select("u", "v").unionAll(failed)).select(F.col("v").alias("node"), F.col("u").alias("wide"))
        groups = groups.unionAll(groups.select(F.col("wide").alias("node"), "wide").distinct())
        open_groups = failed.select(F.col("u").alias("node")).join(groups, "node").select("wide").distinct()
        parts = roots.select(F.col("v").alias("node"), F.col("u").alias("root"))
        rest = distinct.join(groups.join(open_groups, "wide", "left_semi").select("node"), "node", "left_semi").join(parts, "node", "left")
        again = cut(links(rest.select("node", "fp", "fp2", F.coalesce("root", "node").alias("part")), max_bits, masks, "all")
                    .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(failed, ["u", "v"], "left_anti"))
        more = _alike(docs, again, least).where("alike").select("u", "v")
        if not more.isEmpty():  # the groups so far are joined by what is new
            roots = components(roots.select("u", "v").unionAll(more))
    return _named(fps, distinct, roots).select("doc_id", "component_id", F.col("node").alias("content"), "root")
