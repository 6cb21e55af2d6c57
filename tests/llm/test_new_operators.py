"""Top-k search, importance resampling and tokenizer alignment against plain Python over the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import alignment, importance, queries, topk_search
from larder.llm.common import table

TEXTS = [None, "", " ", "a", "The <|endoftext|> and </s> of it's  two   spaces\n\n\tend ", "naïve Straße ▁ é漢😀 x" * 3, "x" * 5000, "word " * 3000,
         "don't STOP 12345 — ok?", "\x00\x01 ctrl", "é combining", "the same text", "the same text"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# 11 top-k search

def brute_top(rows, step, k):
    """rows: (vec_id, vector or None)."""
    held = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in v):
            held.append((i, [math.floor(256 * x) for x in v], list(v)))
    asked = {}
    for i, w, v in held:
        if i is not None and i % step == 0 and (i not in asked or v < asked[i][1]):
            asked[i] = w, v
    out = []
    for i, (w, _) in asked.items():
        found = sorted((-max(min(sum(a * b for a, b in zip(w, c, strict=False)), 2**63 - 1), -2**63), j is None, j or 0) for j, c, _ in held if j != i)
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def test_topk_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.sql(topk_search.ORACLE_SQL).fetchall())
    got = queries.op11_topk_search(spark, sf_dir)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5, 0.001]), (0, [0.5, 2.0, 0.0]), (50, []), (100, [1e18, -1e18, 3.0]), (150, None), (200, [1.0, None, 2.0]), (250, [nan, 0.0, 0.0]),
            (300, [inf, 0.0, 0.0]), (350, [1.7e308, 0.0, 0.0]), (1, [1.0, 1.0, 1.0]), (1, [1.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (None, [9.0]), (3, [0.0, 0.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("weights", F.lit(1))
    got = topk_search.search(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows, 50, 5)
    assert topk_search.search(df.limit(0)).collect() == []
    assert topk_search.search(df.where("vec_id = 1")).collect() == []
    assert [r.vec_id for r in topk_search.search(df.where("vec_id in (0, 2)"), 2).where("query_id = 2").orderBy("rank").collect()] == [0, 0]


def test_topk_many_tiles_ties_and_sparse_rows(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 4000)
    monkeypatch.setattr(topk_search, "GROUP_BYTES", 1000)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 500)
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-2, 3, 12) * (rng.random(12) < 0.3)).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted((tuple(r) for r in topk_search.search(df, 10, 7).collect()), key=str) == brute_top(rows, 10, 7)


# 12 importance resampling

def brute_features(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words + [" ".join(p) for p in zip(words, words[1:], strict=False)]


def brute_importance(rows, target, percent=25, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    held = [list(map(bucket, brute_features(t))) for _, t in rows]
    s, t = Counter(b for h in held for b in h), Counter(bucket(f) for x in target for f in brute_features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (n_s + 10000)) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for (i, _), h in zip(rows, held, strict=True):
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        noise = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296))), None])
    ready = sorted((r for r in out if (r[1] + 1) // 2 >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(ready[:len(ready) * percent // 100]):
        r[4] = n + 1
    return sorted(map(tuple, out), key=str)


def test_importance_equals_brute_force(spark, sf_dir, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    got = queries.op12_importance(spark, sf_dir)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_importance(rows, target)


def test_importance_odd_rows_ties_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(importance, "_WINDOW", 64)
    monkeypatch.setattr(importance, "PIVOTS", 2)
    long = "Some words that go on, é漢 and 12 on. " * 9
    rows = [*enumerate(TEXTS), *((7, long) for _ in range(40)), (None, long), (None, long + "x"), *((100 + i, long + f" w{i} v{i}") for i in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    target = spark.createDataFrame([("go on v3",), (None,), ("",)], "text string")
    assert sorted((tuple(r) for r in importance.resampled(df, target).collect()), key=str) == brute_importance(rows, ["go on v3", None, ""])
    assert importance.resampled(df.limit(0), target).collect() == []
    assert importance.resampled(df.where("doc_id < 3"), target.limit(0)).select("rank").distinct().collect()[0].rank is None


# 13 alignment

def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(alignment.A_PATH), sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    a_tok.encode_special_tokens = True
    values = alignment.byte_values()
    per_row, counts = [], Counter()
    for _, text in rows:
        spans = []
        if text:
            whole = b" " + text.encode()
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            sides = [(a, [bytes(values[c] for c in a_tok.id_to_token(i)) for i in a]),
                     (b, [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b])]
            if all(b"".join(t) == whole for _, t in sides):
                for ids, tokens in sides:
                    ends = np.cumsum([len(t) for t in tokens]).tolist()
                    spans.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
        groups, links = [], []
        if spans:
            i = j = 0
            start = 0
            for end in sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]}):
                ga = [x for x in spans[0][i:i + end - start] if x[2] <= end]
                gb = [x for x in spans[1][j:j + end - start] if x[2] <= end]
                i, j, start = i + len(ga), j + len(gb), end
                groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
                links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        per_row.append((len(spans[0]) if spans else 0, len(spans[1]) if spans else 0, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((i, a, b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (i, _), (a, b, g, k) in zip(rows, per_row, strict=True)), key=str)


def test_alignment_equals_brute_force(spark, sf_dir, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_alignment(rows)
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, sf_dir).collect()), key=str) == want
    assert sorted((tuple(r) for r in alignment.aligned(docs, hot_pairs=50).collect()), key=str) == want  # most pairs are joined


def test_alignment_odd_rows(spark, monkeypatch):
    rows = [*enumerate(TEXTS), (None, "no id"), (11, "the same text"), (11, "the same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).withColumn("row_no", F.lit(1))
    want = brute_alignment(rows)
    assert sorted((tuple(r) for r in alignment.aligned(df).collect()), key=str) == want
    monkeypatch.setattr(alignment, "_CHUNK", 10)
    assert sorted((tuple(r) for r in alignment.aligned(df, hot_pairs=1).collect()), key=str) == want
    assert alignment.aligned(df.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in alignment.aligned(df.where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, "")]
