"""SentencePiece encoding and decoding over a relational lattice (operator 1).

1. Texts are dealt into blocks of bounded size by a hash; each block yields its distinct words. A word
   is a run of spaces with what follows up to the next space, cut wherever two neighbouring characters
   are neighbours in no piece; no edge reaches over such a cut, so words are encoded on their own.
2. The lattice: every distinct word is exploded into its substrings of at most the longest piece's
   length, which are joined to the piece table (bounded by the vocabulary, so it is broadcast). The
   matches are the word's edges (start, length, id, score) and are grouped by word.
3. The fold runs over a word's edges with higher-order aggregates, by the model's own type:
   ``viterbi`` for unigram models (best path by position, then a walk back), ``merges`` for BPE
   models, whose segmentation is defined by merge order: the best edge over two neighbouring parts
   joins them until none is left. Viterbi on a BPE model's scores gives other ids than the model.
   Characters without a piece become byte pieces.
4. Every block gets the ids of its own words, by their place in the block's sorted list of words, and
   puts its documents' ids together. A block's words depend on its texts alone, in any order, so tasks
   that run again after a lost executor name the same places.

Words over ``LONG_WORD`` characters, which are few, are folded by the same rules where their block is
put together, as a fold's cost grows with the square of the length.

Edge cases: a null or empty text has no ids and decodes to an empty text; U+2581 counts as a space;
repeated rows stay; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import release, text_or_empty

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BLOCK_BYTES = 24 << 20
PARTITION_BYTES = 16 << 20  # text for each partition of words
MAX_PARTITIONS = 100_000  # more blocks or words only make partitions larger
LONG_WORD = 40
MAX_PIECES = 1 << 18  # pieces of up to 64 bytes: at most some 30 MB to broadcast
HEADS = 1 << 14  # slots for the first two characters of pieces
PAGE_BITS = 4  # of a character's code, its place in a page of the table of single characters
_DECODED_BYTES = 4 << 20
_CHUNK_BYTES, _SLICES = 2 << 20, 1 << 16  # what numpy works on at a time
_UNITS = 1 << 14  # units that are Python strings at a time


@dataclass(frozen=True)
class PieceModel:
    """Pieces with their ids and scores; ``first_byte`` is the id of byte 0, or -1."""

    kind: str  # "bpe" or "unigram"
    pieces: tuple[tuple[str, int, float], ...]
    decoded: tuple[bytes, ...]  # by id
    first_byte: int
    unknown: int

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)


def load_model(path: str = MODEL_PATH, serialized: bytes | None = None) -> PieceModel:
    """Read a SentencePiece model file on the driver."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    if serialized is None:
        with open(path, "rb") as f:
            serialized = f.read()
    proto = sentencepiece_model_pb2.ModelProto.FromString(serialized)
    processor = sentencepiece.SentencePieceProcessor(model_proto=serialized)
    n = processor.vocab_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces are too many to broadcast")
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models with identity normalisation and a dummy prefix are read")
    pieces, decoded, first_byte = [], [], -1
    for i in range(n):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            value = int(piece[3:5], 16)
            first_byte = i - value
            decoded.append(bytes([value]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            decoded.append(b"" if processor.is_control(i) else " ⁇ ".encode())
        else:
            pieces.append((piece, i, float(processor.get_score(i))))
            decoded.append(piece.replace(SPACE, " ").encode())
    kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
    unknown = processor.unk_id()
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, _ in pieces):
        raise ValueError("only models whose pieces have spaces at their start alone, and no line ends, are read")
    model = PieceModel(kind, tuple(pieces), tuple(decoded), first_byte, unknown)
    del proto, processor, spec  # the driver keeps the pieces alone
    release()
    return model


def _unit_starts(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Where units start: at spaces after none, at line ends after none, after line ends, and at texts."""
    b = np.frombuffer(data, np.uint8)
    space, line = b == 32, b == 10
    first = np.zeros(len(b) + 1, bool)
    first[1:-1] = space[1:] & ~space[:-1] | (line[1:] != line[:-1]) & ~(space[:-1] & ~line[1:])
    first[0] = True
    first[bounds] = True  # a text's end is the next one's start
    return np.flatnonzero(first[:len(b)])


def units(texts: Iterable[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units of UTF-8 texts, the codes of all units in order, and where each text's units end.

    A unit is a run of spaces with what follows, or a run of line ends. A text that isn't empty starts
    with its dummy space; joined, its units are the text. Texts are taken one at a time, and only the
    distinct units of a chunk of them are kept.
    """
    distinct, local, ends, held, size, done = [], [], [], [], 0, 0

    def solve() -> None:
        nonlocal size, done
        data, bounds = b"".join(held), np.cumsum([len(r) for r in held], dtype=np.int64)
        starts = _unit_starts(data, bounds) if data else np.zeros(0, np.int64)
        if data:  # Arrow drops chunks without values
            cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
            coded = cut.dictionary_encode()
            distinct.append(coded.dictionary)
            local.append(coded.indices.to_numpy(zero_copy_only=False))
        ends.append(done + np.searchsorted(starts, bounds))
        done += len(starts)
        held.clear()
        size = 0

    for text in texts:
        held.append(b" " + text.replace(b"\xe2\x96\x81", b" ") if text else b"")
        size += len(held[-1])
        if size >= _CHUNK_BYTES:
            solve()
    solve()
    release()
    if not distinct:
        return pa.array([], pa.binary()), np.zeros(0, np.int32), np.concatenate(ends)
    coded = pa.chunked_array(distinct).dictionary_encode()
    found = coded.chunk(coded.num_chunks - 1).dictionary
    places = [c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]
    del distinct, coded
    codes, low = np.empty(done, np.int32), 0
    for k in range(len(local)):
        codes[low:low + len(local[k])] = places[k][local[k]]
        low += len(local[k])
        local[k] = None
    return found, codes, np.concatenate(ends)


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of ``values`` one after the other, some at a time."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], values.dtype)
    for at in range(0, len(sizes), _SLICES):
        part, low = slice(at, at + _SLICES), ends[at]
        high = ends[min(at + _SLICES, len(sizes))]
        out[low:high] = values[np.repeat(starts[part] - ends[at:at + _SLICES][:len(sizes[part])], sizes[part]) + np.arange(low, high)]
    return out


class Cutter:
    """Cuts units into words, many at once: a table of neighbouring characters tells where."""

    def __init__(self, model: PieceModel):
        pairs = {a + b for piece, _, _ in model.pieces for a, b in zip(piece, piece[1:])}
        chars = sorted({c for pair in pairs for c in pair})
        self._codes = np.array([ord(c) for c in chars], np.uint32)
        self._beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        place = {c: i for i, c in enumerate(chars)}
        for pair in pairs:
            self._beside[place[pair[0]], place[pair[1]]] = True

    def cut(self, units: list[str]) -> tuple[list[str], list[int]]:
        """All words of the units one after the other, and how many each unit has."""
        if not units:
            return [], []
        marked = [u.replace(" ", SPACE) for u in units]
        text = "".join(marked)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self._codes, codes)
        at[self._codes[np.minimum(at, len(self._codes) - 1)] != codes] = len(self._codes)
        starts = np.cumsum([0, *map(len, marked[:-1])])
        first = np.ones(len(codes), bool)
        first[1:] = ~self._beside[at[:-1], at[1:]]
        first[starts] = True
        cuts = np.flatnonzero(first)
        counts = np.diff(np.append(np.searchsorted(cuts, starts), len(cuts)))
        ends = cuts.tolist()[1:] + [len(text)]
        return [text[a:b] for a, b in zip(cuts.tolist(), ends)], counts.tolist()


RANK_BITS, ID_BITS = 36, 20


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """piece and value: its place by falling score (ties share it) above its id, packed in a long."""
    places, place, before = {}, -1, None
    for piece, _, score in sorted(model.pieces, key=lambda p: -p[2]):
        place, before = (place, before) if score == before else (place + 1, score)
        places[piece] = place
    return spark.createDataFrame([(p, (places[p] << ID_BITS) | i) for p, i, _ in model.pieces], "piece string, value long")


def _reach(model: PieceModel, head: Column) -> Column:
    """The longest piece that starts with these two characters, or at most some more: a slot may be shared."""
    slots = [1] * HEADS
    for piece, _, _ in model.pieces:
        if len(piece) > 1:
            at = xxhash.xxh64_intdigest(piece[:2].encode(), 42) & (HEADS - 1)
            slots[at] = max(slots[at], len(piece))
    table = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<int>")
    return F.get(table, F.xxhash64(head).bitwiseAND(F.lit(HEADS - 1)).cast("int"))


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """word, n (its characters), and its edges of two characters or more: keys (start * 64 + length) and values.

    ``words`` holds distinct words and is partitioned by them, so that grouping needs no shuffle. Single
    characters are read from a table where they are needed; a word's first one stands for words without edges.
    """
    n, start = F.length("word"), F.col("start")
    at = F.explode(F.sequence(F.lit(0), n - 1))
    longest = F.least(_reach(model, F.substring(F.col("word"), start + 1, F.lit(2))), n - start)
    lengths = F.when(start == 0, F.sequence(F.lit(1), F.col("longest"))).when(F.col("longest") > 1, F.sequence(F.lit(2), F.col("longest")))
    # A column of its own: the table stands in the plan once, and the driver writes out a plan each time a stage ends.
    spans = (words.select("word", at.alias("start")).select("word", "start", longest.alias("longest")).select("word", "start", F.explode(lengths).alias("len"))
             .select("word", "start", "len", F.substring(F.col("word"), start + 1, F.col("len")).alias("piece")))
    edges = spans.join(F.broadcast(piece_table(words.sparkSession, model)), "piece", "left").where("value is not null or len = 1")
    edge = F.shiftleft((start * 64 + F.col("len")).cast("long"), RANK_BITS).bitwiseOR(F.col("value"))
    grouped = edges.groupBy("word").agg(F.collect_list(F.when(F.col("len") > 1, edge)).alias("packed"))
    keys = F.transform("packed", lambda e: F.shiftright(e, RANK_BITS).cast("int"))
    values = F.transform("packed", lambda e: e.bitwiseAND(F.lit((1 << RANK_BITS) - 1)))
    return grouped.select("word", F.length("word").alias("n"), keys.alias("keys"), values.alias("values"))


def _edge(start: Column, length: Column) -> Column:
    """The value of an edge of two characters or more; null without one."""
    return F.get(F.col("values"), (F.array_position(F.col("keys"), start * 64 + length) - 1).cast("int"))


def _single(model: PieceModel, start: Column) -> Column:
    """The id of a character's own piece; null without one. Pages without pieces are one page, which keeps the table short in the plan."""
    own = {ord(piece): i for piece, i, _ in model.pieces if len(piece) == 1}
    pages, ids = [0] * ((max(own, default=0) >> PAGE_BITS) + 1), [None] * (1 << PAGE_BITS)
    for page in sorted({code >> PAGE_BITS for code in own}):
        pages[page] = len(ids)
        ids += [own.get((page << PAGE_BITS) + k) for k in range(1 << PAGE_BITS)]
    places, table = (F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<int>") for x in (pages, ids))
    code = F.ascii(F.substring(F.col("word"), start + 1, F.lit(1)))
    return F.get(table, F.get(places, F.shiftright(code, PAGE_BITS)) + code.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)))


def _id(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merges(n: Column) -> Column:
    """Cut positions of a word by merge order: the best edge over two parts, the leftmost of equal ones."""

    def step(cuts: Column, _: Column) -> Column:
        def candidate(i: Column) -> Column:
            left = F.get(cuts, i)
            return F.shiftright(_edge(left, F.get(cuts, i + 2) - left), ID_BITS) * 64 + i  # null without an edge

        best = F.array_min(F.transform(F.sequence(F.lit(0), F.size(cuts) - 3), candidate))
        # A fold that finds no edge marks its first cut, so that the rounds left are idle.
        done = F.transform(cuts, lambda c, j: F.when(j == 0, F.lit(-1)).otherwise(c))
        joined = _bound(best.bitwiseAND(F.lit(63).cast("long")).cast("int") + 1, lambda gone: F.when(gone.isNull(), done).otherwise(F.filter(cuts, lambda _, j: j != gone)))
        return F.when((F.size(cuts) < 3) | (F.get(cuts, F.lit(0)) < 0), cuts).otherwise(joined)

    return F.aggregate(F.sequence(F.lit(2), n), F.sequence(F.lit(0), n), step, lambda cuts: F.transform(cuts, lambda c: F.greatest(c, F.lit(0))))


def viterbi(n: Column, model: PieceModel) -> tuple[Column, Column]:
    """Best paths by position, and the cut positions of the walk back; longer pieces win ties."""
    scores = [0.0] * (max(i for _, i, _ in model.pieces) + 1)
    for _, i, score in model.pieces:
        scores[i] = score
    table = F.from_json(F.lit(json.dumps(scores)), "array<double>")
    unknown = min(s for _, _, s in model.pieces) - 10.0
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def step(best: Column, end: Column) -> Column:
        def candidate(start: Column) -> Column:
            alone = F.coalesce(F.get(table, _single(model, start)), F.lit(unknown))
            score = F.when(end - start == 1, alone).otherwise(F.get(table, _id(_edge(start, end - start))))
            return F.when(score.isNotNull(), F.struct((F.get(best, start)["score"] + score).alias("score"), (-start).alias("back")))

        top = F.array_max(F.transform(F.sequence(F.greatest(F.lit(0), end - model.longest), end - 1), candidate))
        return F.concat(best, F.array(_bound(top, lambda t: F.struct(t["score"].alias("score"), (-t["back"]).alias("back")))))

    paths = F.aggregate(F.sequence(F.lit(1), n), first, step)
    walk = F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda cuts, _: F.when(F.get(cuts, F.lit(0)) == 0, cuts).otherwise(
        F.concat(F.array(F.get(F.col("paths"), F.get(cuts, F.lit(0)))["back"]), cuts)))
    return paths, walk


def _ids(model: PieceModel) -> Column:
    """Ids of the parts between a word's cuts; parts without a piece are single characters."""
    def part(i: Column) -> Column:
        start, size = F.get("cuts", i), F.get("cuts", i + 1) - F.get("cuts", i)
        edge = F.when(size > 1, _id(_edge(start, size))).otherwise(_single(model, start))
        if model.first_byte < 0:
            return F.array(F.coalesce(edge, F.lit(model.unknown)))
        code = F.hex(F.encode(F.substring("word", start + 1, F.lit(1)), "UTF-8"))
        values = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda k: F.conv(F.substring(code, (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + model.first_byte)
        return _bound(edge, lambda e: F.when(e.isNotNull(), F.array(e)).otherwise(values))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), part))


def fold_word(word: str, model: PieceModel, table: dict[str, tuple[int, float]]) -> list[int]:
    """Ids of one word of any length by the same rules: merges from a heap, or Viterbi."""
    text, n = word, len(word)
    if model.kind == "bpe":
        ends, starts, alive = list(range(1, n + 1)), list(range(n)), [True] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (hit := table.get(text[starts[i]:ends[after[i]]])):
                heapq.heappush(heap, (-hit[1], i, ends[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or ends[after[i]] != end:
                continue
            j = after[i]
            ends[i], alive[j], after[i] = ends[j], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        parts = [text[starts[i]:ends[i]] for i in range(n) if alive[i]]
    else:
        unknown = min(s for _, s in table.values()) - 10.0
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - model.longest), end):
                hit = table.get(text[start:end])
                score = hit[1] if hit else unknown if end - start == 1 else None
                if score is not None and best[start] + score > best[end]:
                    best[end], back[end] = best[start] + score, start
        parts, end = [], n
        while end:
            parts.append(text[back[end]:end])
            end = back[end]
        parts.reverse()
    out: list[int] = []
    for part in parts:
        hit = table.get(part)
        if hit:
            out.append(hit[0])
        elif model.first_byte >= 0:
            out.extend(model.first_byte + b for b in part.encode())
        else:
            out.append(model.unknown)
    return out


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """word and ids (array<int>) of distinct words."""
    found = lattice(words, model)
    if model.kind == "bpe":
        found = found.withColumn("cuts", merges(F.col("n")))
    else:
        paths, walk = viterbi(F.col("n"), model)
        found = found.withColumn("paths", paths).withColumn("cuts", walk)
    return found.select("word", _ids(model).alias("ids"))


_PACKED = pa.schema([("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("blob", pa.binary())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch by block, their texts compressed together."""
    pack = zstandard.ZstdCompressor(level=5)
    for batch in batches:
        groups: dict[int, list[int]] = {}
        texts, doc_ids, rows = batch.column("text").cast(pa.binary()), batch.column("doc_id").to_pylist(), []
        for i, block in enumerate(batch.column("block").to_pylist()):
            groups.setdefault(block, []).append(i)
        for block, places in groups.items():  # the texts of one block at a time
            raw = [texts[i].as_py() for i in places]
            rows.append({"block": block, "ids": [doc_ids[i] for i in places], "sizes": [len(r) for r in raw], "blob": pack.compress(b"".join(raw))})
            del raw
        yield pa.RecordBatch.from_pylist(rows, schema=_PACKED)
        del groups, rows, texts, doc_ids, batch
        release()


def _texts(sizes: list[int], blob: bytes) -> Iterator[bytes]:
    raw, at = zstandard.ZstdDecompressor().decompress(blob) if sum(sizes) else b"", 0
    for size in sizes:
        yield raw[at:at + size]
        at += size


class _Block:
    """Documents of a block as units, its units as words, and its distinct words in order."""

    def __init__(self, rows: pa.Table, cutter: Cutter):
        release()  # what the block before left
        self.doc_ids = pa.concat_arrays([pa.array([], pa.int64()), *[pc.list_flatten(c) for c in rows.column("ids").chunks]])
        packed = ((r.column("sizes")[0].as_py(), r.column("blob")[0].as_py()) for b in rows.to_batches() for r in (b.slice(i, 1) for i in range(len(b))))
        found, self.codes, self.ends = units(text for sizes, blob in packed for text in _texts(sizes, blob))
        del packed
        release()
        words, counts = [pa.array([], pa.string())], [np.zeros(0, np.int32)]
        for at in range(0, len(found), _UNITS):
            some, sizes = cutter.cut([u.decode("utf-8", "replace") for u in found.slice(at, _UNITS).to_pylist()])
            words.append(pa.array(some, pa.string()))
            counts.append(np.array(sizes, np.int32))
        self.counts = np.concatenate(counts)
        some = sizes = None
        del found, counts
        release()
        parts = pa.concat_arrays(words).dictionary_encode()
        del words
        release()
        long = pc.greater(pc.utf8_length(parts.dictionary), LONG_WORD).to_numpy(zero_copy_only=False)
        text_order = pc.sort_indices(parts.dictionary).to_numpy()
        order = np.concatenate([text_order[~long[text_order]], text_order[long[text_order]]])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.parts = place[parts.indices.to_numpy(zero_copy_only=False)]
        self.words = parts.dictionary.take(pa.array(order))
        self.short = int(len(order) - long.sum())


def _vocabulary(key: tuple, rows: pa.Table, cutter: Cutter) -> pa.Table:
    """word and ref (the block above the word's place in it) of a block's words, without long ones."""
    block = _Block(rows, cutter)
    refs = (key[0].as_py() << 32) + np.arange(block.short, dtype=np.int64)
    return pa.table({"word": block.words[:block.short], "ref": pa.array(refs)})


def _assembled(key: tuple, docs: pa.Table, words: pa.Table, model: PieceModel, cutter: Cutter) -> pa.Table:
    """Ids of a block's documents from the ids of its words."""
    block = _Block(docs, cutter)
    words = words.combine_chunks()
    places = words.column("ref").to_numpy() & 0xFFFFFFFF
    if len(places) != block.short:
        raise RuntimeError(f"block {key[0]} has {block.short} words, but ids of {len(places)}")
    lists = words.column("ids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    sizes = np.zeros(len(block.words), np.int64)
    starts = np.zeros(len(block.words), np.int64)
    sizes[places] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    starts[places] = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    if block.short < len(block.words):
        pieces = {p: (i, s) for p, i, s in model.pieces}
        folded = [fold_word(w, model, pieces) for w in block.words[block.short:].to_pylist()]
        sizes[block.short:] = [len(f) for f in folded]
        starts[block.short:] = len(flat) + np.cumsum([0, *[len(f) for f in folded[:-1]]])
        flat = np.concatenate([flat, *[np.array(f, np.int32) for f in folded]])
    word_sizes = sizes[block.parts]
    unit_ids = _gathered(flat, starts[block.parts], word_sizes)
    word_ends, unit_parts = np.concatenate([[0], np.cumsum(word_sizes)]), np.concatenate([[0], np.cumsum(block.counts)])
    unit_starts = word_ends[unit_parts[:-1]]
    unit_sizes = word_ends[unit_parts[1:]] - unit_starts
    del words, lists, places, flat, sizes, starts, word_sizes, word_ends, unit_parts, block.words, block.parts, block.counts
    release()
    batches, done, low = [], 0, 0
    while done < len(block.ends):  # some documents at a time; each slice is a batch of its own for the JVM too
        stop = max(done + 1, int(np.searchsorted(block.ends, low + _SLICES, side="right")))
        codes, ends = block.codes[low:block.ends[stop - 1]], block.ends[done:stop] - low
        token_sizes = unit_sizes[codes]
        ids = _gathered(unit_ids, unit_starts[codes], token_sizes)
        ends = np.concatenate([[0], np.concatenate([[0], np.cumsum(token_sizes)])[ends]])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        batches.append(pa.record_batch({"doc_id": block.doc_ids[done:stop], "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": listed}))
        done, low = stop, int(block.ends[stop - 1])
    del block, unit_ids, codes, token_sizes
    release()
    return pa.Table.from_batches(batches)


ENCODED = "doc_id long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, model: PieceModel, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = (rows.withColumn("block", block).mapInArrow(_packed, "block int, ids array<bigint>, sizes array<int>, blob binary")
             .repartition(min(blocks, MAX_PARTITIONS), "block"))
    cutter = Cutter(model)
    pairs = (dealt.groupBy("block").applyInArrow(lambda key, docs: _vocabulary(key, docs, cutter), "word string, ref long")
             .repartition(min(max(4, int(size // PARTITION_BYTES) + 1), MAX_PARTITIONS), "word"))
    # Counting a word's blocks lets both uses of the pairs read one shuffle.
    distinct = pairs.groupBy("word").agg(F.count("ref").alias("blocks")).where("blocks > 0").select("word")
    by_block = pairs.join(encode_words(distinct, model), "word").select(F.shiftright("ref", 32).cast("int").alias("block"), "ref", "ids")
    together = lambda key, docs, words: _assembled(key, docs, words, model, cutter)
    return dealt.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(together, ENCODED)


def decode(encoded: DataFrame, model: PieceModel, column: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of the ids; the piece table is bounded by the vocabulary."""
    table = np.frombuffer(b"".join(model.decoded), np.uint8)
    sizes = np.array([len(d) for d in model.decoded], np.int64)
    starts = np.cumsum(sizes) - sizes

    def some(lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        at, lengths = starts[ids], sizes[ids]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        first = bounds[:-1][counts > 0]
        first = first[lengths[first] > 0]
        at[first] += 1  # the dummy space
        lengths[first] -= 1
        data = _gathered(table, at, lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds].astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        try:
            return found.cast(pa.string())
        except pa.ArrowInvalid:  # ids that aren't of a text
            return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            step = np.cumsum(counts) // (_DECODED_BYTES // 8)
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(lists)]
            del counts, step
            for a, b in zip(cuts, cuts[1:]):
                if b > a:  # a part leaves before the next one is made
                    yield some(lists[a:b])
            del lists
            release()

    return encoded.withColumn(out, text_of(F.col(column)))
