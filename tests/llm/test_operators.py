"""The corpus operators against brute force, round trips and held-out labels."""

import hashlib
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import html_crf, line_dedup, media, mixing, multiset, pii, quality, queries, sentencepiece_lattice, simhash, toxicity
from larder.llm.common import cut, release, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "one two three", None, "b", 13), (3, "one two three", None, "b", 13), (None, "a text without an id here", "fr", "c", 5),
       (4, " \t\n ", "de", "a", 4), (5, "é漢😀 x@y.example +1 (907) 555-1190", "es", "a", None), (6, "word " * 30000, "en", "b", 150000), (7, "x" * 70000, "en", "b", 70000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("n_removed", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_registered_names():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))


# 1 SentencePiece

def test_sentencepiece_equals_library_and_decodes(spark, sf_dir, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL_PATH)
    rows = queries.op1_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_sentencepiece_assembles_in_slices(monkeypatch):
    """A block's tokens leave in batches of bounded size, in order, with null and empty rows."""
    import pyarrow as pa
    import sentencepiece

    model = sentencepiece_lattice.load_model()
    cutter, library = sentencepiece_lattice.Cutter(model), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL_PATH)
    rows = [(i or None, ["", "to be  or\n\nnot to be", "x" * 60 + " é漢😀 and more"][i % 3] * (1 + i % 4)) for i in range(30)]
    packed = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "block": pa.array([0] * len(rows), pa.int32())})
    docs = pa.Table.from_batches(list(sentencepiece_lattice._packed([packed])))
    short = sentencepiece_lattice._vocabulary((pa.scalar(0),), docs, cutter)
    pieces = {p: (i, s) for p, i, s in model.pieces}
    ids = pa.array([sentencepiece_lattice.fold_word(w, model, pieces) for w in short["word"].to_pylist()], pa.list_(pa.int32()))
    monkeypatch.setattr(sentencepiece_lattice, "_SLICES", 16)
    got = sentencepiece_lattice._assembled((pa.scalar(0),), docs, pa.table({"ref": short["ref"], "ids": ids}), model, cutter)
    assert got.column("ids").num_chunks > 3
    assert [(r["doc_id"], r["ids"], r["n_tokens"]) for r in got.to_pylist()] == [(d, e, len(e)) for d, t in rows for e in [library.encode(t)]]


def test_sentencepiece_units_keep_no_texts():
    """Units are told apart a chunk of texts at a time, so a block's texts aren't held beside its codes."""
    words = " ".join(f"w{i % 997}" for i in range(40_000)).encode()
    sentencepiece_lattice.units([words])  # what is imported at first use doesn't count
    tracemalloc.start()
    try:
        found, codes, ends = sentencepiece_lattice.units(words + b" %d" % i for i in range(80))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 997 + 80 and len(codes) == ends[-1] == 80 * 40_001
    assert peak < 26 << 20  # 15 MB of text, whose codes take 12 MB: 17 MB, and 48 MB while the chunks were kept


def test_released_memory_goes_back():
    """Freed blocks under one that is still held are given back too."""
    def resident() -> int:
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10

    held = [bytes([i % 256]) * 50_000 for i in range(2000)]
    last, before = held[-1], resident()
    del held
    release()
    assert len(last) == 50_000 and resident() < before - 70


@pytest.mark.parametrize("texts", [[None, "", None], ["", "a b  c", None, "é漢😀" * 30, "x" * 200]])
def test_sentencepiece_decodes_in_parts(spark, monkeypatch, texts):
    """Texts leave the decoder in parts; a block without any text has no ids."""
    monkeypatch.setattr(sentencepiece_lattice, "_DECODED_BYTES", 64)
    model = sentencepiece_lattice.load_model()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, model), model, out="decoded").collect()
    assert {r.doc_id: r.decoded for r in rows} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.n_tokens == len(r.ids) and bool(r.ids) == bool(texts[r.doc_id]) for r in rows)


def test_sentencepiece_odd_rows(odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL_PATH)
    model = sentencepiece_lattice.load_model()
    rows = sentencepiece_lattice.encode(odd, model).collect()
    want = Counter((d, tuple(library.encode(t or ""))) for d, t, *_ in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert sentencepiece_lattice.encode(empty, model).count() == 0


def test_sentencepiece_unigram_viterbi(spark):
    """The same pieces as a unigram model: the fold's path scores as much as the library's."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(sentencepiece_lattice.MODEL_PATH, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # scores that a unigram model could have
        p.score = max(p.score, -40000.0) / 4000.0 - 1.0 if p.type == 1 else p.score
    raw = proto.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model = sentencepiece_lattice.load_model(serialized=raw)
    assert model.kind == "unigram"
    words = ["▁thation", "▁unbelievable", "▁a", "▁straße", "▁x漢y", "▁tokenization"]
    got = {r.word: r.ids for r in sentencepiece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string").repartition(2, "word"), model).collect()}
    table_ = {p: (i, s) for p, i, s in model.pieces}
    for w in words:
        assert got[w] == library.encode(w[1:]), w
        assert sentencepiece_lattice.fold_word(w, model, table_) == got[w]


# 2 line dedup

def test_line_dedup_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(line_dedup.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op2_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_removed", "text_md5").collect())
    assert got == want


def test_line_dedup_removes_boilerplate_and_keeps_copies(spark):
    rows = [(i, f"Own {i} opening.\nAll rights reserved.\nOwn {i} end.", "en", f"s{i % 12}", 0) for i in range(24)]
    rows += [(100 + i, "First of a copy.\nSecond of a copy.\nThird of a copy.", "en", f"s{i}", 0) for i in range(12)]
    made = spark.createDataFrame(rows, SCHEMA)
    for most in (line_dedup.INLINE_LINES, 0):
        clean = line_dedup.remove_lines(made, line_dedup.boilerplate(made, broadcast_lines=most), most).collect()
        assert len(clean) == 36
        for r in clean:
            assert "All rights" not in r.text and (r.doc_id < 100 or r.n_removed == 0)


def test_line_dedup_removes_blocks_of_lines(spark):
    notice = "We use cookies.\nRead our policy.\nAccept all."
    rows = [(i, f"Own words of {i}.\n{notice}", "en", f"s{i % 25}", 0) for i in range(200)]
    assert {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == {f"Own words of {i}." for i in range(200)}


@pytest.mark.parametrize("own", [1, 2, 3])
def test_line_dedup_takes_the_notice_of_short_pages(spark, own):
    """Distinct sites alone decide, however few lines a page has of its own; nine sites are too few."""
    notice = "\n".join(f"Line {k} of a long notice." for k in range(12))
    rare = "Printed on nine sites."
    made = [(i, "\n".join([f"Line {k} that only page {i} has." for k in range(own)] + [notice] + [rare] * (i % 25 < 9)), "en", f"s{i % 25}", 0) for i in range(100)]
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(made, SCHEMA)).collect()}
    assert got == {i: [f"Line {k} that only page {i} has." for k in range(own)] + [rare] * (i % 25 < 9) for i in range(100)}


def test_line_dedup_of_one_body_on_many_sites(spark):
    """Whole copies stay for document deduplication; below lines of a site's own the body goes."""
    body = "\n".join(f"Line {k} of the body." for k in range(6))
    whole = [(i, body, "en", f"s{i}", 0) for i in range(12)]
    below = [(100 + i, f"By the desk of site {i}.\n{body}", "en", f"s{i}", 0) for i in range(12)]
    assert {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(whole, SCHEMA)).collect()} == {body}
    assert {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(below, SCHEMA)).collect()} == {f"By the desk of site {i}." for i in range(12)}


def test_line_dedup_odd_rows(odd, empty):
    kept = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("mine")))
    assert {(r.n_lines, r.n_removed) for r in kept.collect()} == {("mine", 0)} and "n_removed_1" in kept.columns
    clean = line_dedup.dedup_lines(odd.drop("n_removed")).collect()
    assert Counter(r.text for r in clean) == Counter(t for _, t, *_ in ODD)
    assert line_dedup.dedup_lines(empty).count() == 0


# 3 toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op3_toxicity(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    for r in rows[:50]:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    hits = sum(r.predicted for r in rows if r.toxic)
    false = sum(r.predicted for r in rows if not r.toxic)
    assert hits >= 0.9 * sum(r.toxic for r in rows)
    assert false <= 0.03 * sum(1 - r.toxic for r in rows)


def test_toxicity_training_keeps_common_words_once():
    ordinary = [" ".join(f"word{i}" for i in range(200))] * 1000
    tracemalloc.start()
    spans = toxicity._toxic_spans(["you idiot and moron"] * 8, ordinary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans and peak < 4e6


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    model = toxicity.fit(["you idiot and moron go"] * 40, [f"plain words number {i} here" for i in range(80)])
    assert model is None or toxicity.score(odd, model).count() == len(ODD)


# 4 media columns

def test_media_round_trip(spark, sf_dir, texts):
    rows = queries.op4_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    raw, before = [], np.zeros(7, int)
    for y in range(5):
        out = []
        for x in range(7):
            left, up, corner = (int(rows[y, x - 1]) if x else 0), int(before[x]), (int(before[x - 1]) if x else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            out.append((int(rows[y, x]) - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        raw.append([kind, *out])
        before = rows[y].astype(int)
    assert (media._unfiltered(np.array(raw, np.uint8), 1) == rows).all()


def test_png_checksums_are_tested():
    stored = bytearray(media.encode_png(media.payload_of("hello")))
    stored[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(stored))


def test_media_odd_rows(odd, empty):
    rows = media.media_rows(odd).collect()
    assert len(rows) == len(ODD) and len({r.feature for r in rows if r.doc_id == 3}) == 1
    assert media.media_rows(empty).count() == 0


# 5 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end()))
    return [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(found)]


HARD = ["a@b.c_d@e.f x.y%z@@q.w", "é😀 +1 (907) 555-1190, 10.0.0.1.2.3.4.5 256.1.1.1 001.2.3.4", "4539 1488 0343 6467 4539148803436467 1-2-3", "9" * 5000 + " 1.2.3 1.2.3.4", "a" * 50000, "+++12--34 +1 5", "mail me: first.last@host-name.co.uk.", None, ""]


def test_base_spans_equal_brute_force(spark, docs, texts):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1000 + d, t) for d, t in texts.items()]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), None)
    got = {r.doc_id: r.s.split(",") if r.s else [] for r in found.select("doc_id", pii._listed("base").alias("s")).collect()}
    for i, t in rows:
        assert got[i] == base_spans(t or ""), (i, (t or "")[:60])


def test_personal_data_query(spark, texts):
    sf = "/root/testdata/sf0.01"
    whole = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in queries.op5_pii(spark, sf).collect():
        base = base_spans(whole[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
        assert set(base) <= set(r.spans.split(",") if r.spans else [])


def test_personal_data_odd_rows(odd, empty):
    assert Counter(r.doc_id for r in pii.personal_data(odd).collect() if r.spans is not None) == Counter(d for d, *_ in ODD)
    assert pii.personal_data(empty).count() == 0
    assert "[phone]" in pii.redact(odd).where("doc_id = 5").first().text


ANY_SPAN = pii.SpanModel(((1.0, 1.0),), 0.0)  # selects every candidate


def chosen_spans(spark, texts):
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ANY_SPAN)
    return [[(pii.KINDS[s.kind], s.span) for s in r.spans] for r in found.orderBy("doc_id").collect()]


def test_many_candidates_in_one_text(spark):
    """Runs of spans: offsets, contexts and overlaps as in short texts, and no square of their number."""
    some = "Call 907-555-1190 or é mail a@b.de. "
    small, = chosen_spans(spark, [some])
    begun = time.perf_counter()
    found = pii.find_spans(spark.createDataFrame([(0, some * 20000)], "doc_id long, text string"), ANY_SPAN).first()
    taken = time.perf_counter() - begun
    assert [(pii.KINDS[s.kind], s.span) for s in found.spans] == small * 20000
    assert all(found.text[s.start:s.end] == s.span for s in found.spans[::997])
    spans = pii._candidate_spans(F.col("text"))
    near = spark.createDataFrame([(some * 700,)], "text string").withColumn("_digit", F.lit(True)).select(spans.alias("s")).first().s
    assert len(near) == 1400
    for s in near:
        text = some * 700
        assert (text[s.start:s.end], text[max(s.start - 24, 0):s.start], text[s.end:s.end + 12]) == (s.span, s.before, s.after)
    assert taken < 60, taken


def test_phone_candidates_end_before_spaces_stops_and_brackets(spark):
    numbers = ["907-555-1190", "(907) 555-1190", "0207 946 0958", "(907) - 555 - 1190"]
    told = [before + n + after for n in numbers for before, after in (("Call ", " now"), ("Call ", "."), ("(tel ", ")"), ("Call ", ""), ("Call ", ", or"))]
    for text, got in zip(told, chosen_spans(spark, told)):
        assert any(k == "phone" and s in text and s in numbers for k, s in got), (text, got)


def test_spelt_emails_are_candidates_in_any_text(spark):
    emails = ["bob (at) host.org", "bob [AT] host.org", "bob(AT)host.org", "amy at site.com", "amy at site dot com", "amy@site.com", "bob [at) host.org"]
    told = [f"Write {e}{after}" for e in emails for after in (", please", " by room 5")]
    for i, got in enumerate(chosen_spans(spark, told)):
        assert any(k == "email" and s.startswith(emails[i // 2]) for k, s in got), (told[i], got)


# 6 quality

def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    poor = [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in rows if r.quality == 1) >= 0.97 * (len(rows) - len(poor))
    assert sum(not r.keep for r in poor) >= 0.7 * len(poor)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    accuracy = [0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in accuracy], axis=1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.05
    assert np.abs(model.good[:, 2] - accuracy).max() < 0.08


def test_quality_odd_rows(odd, empty):
    assert quality.quality(odd).count() == len(ODD)
    assert quality.quality(empty).count() == 0


# 7 SimHash

def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    bits = np.array(fps, np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    root = np.arange(len(ids))
    while True:
        low = np.array([root[n].min() for n in near])
        if (low == root).all():
            return root
        root = low


def test_simhash_equals_brute_force(spark, sf_dir, texts):
    rows = sorted(queries.op7_simhash(spark, sf_dir).collect())
    fps = [slow_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    ids = [r.doc_id for r in rows]
    assert [r.component_id for r in rows] == [ids[i] for i in slow_components(ids, fps)]


@pytest.mark.parametrize("tile", [8, 1024])
def test_simhash_links_of_dense_groups(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    fps = set(rng.integers(-2**62, 2**62, 40).tolist())
    for center in list(fps)[:3]:
        for _ in range(120):
            fp = center
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                fp ^= -(1 << 63) if b == 63 else 1 << int(b)
            fps.add(fp)
    ordered = sorted(fps)
    df = spark.createDataFrame([(f, f, 0) for f in ordered], "node long, fp long, fp2 long")
    roots = {r.v: r.u for r in simhash.components(simhash.links(df)).collect()}
    slow = slow_components(ordered, [f & (2**64 - 1) for f in ordered])
    assert [roots.get(f, f) for f in ordered] == [ordered[i] for i in slow]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars are kept as they are; others end in stars without a round that only tells so."""
    cuts = []
    monkeypatch.setattr(simhash, "cut", lambda df: cuts.append(1) or cut(df))
    edges = spark.createDataFrame([(1, 2), (3, 1), (4, 5), (5, 4), (7, 7)], "u long, v long")
    assert sorted(map(tuple, simhash.components(edges).select("v", "u").collect())) == [(2, 1), (3, 1), (5, 4)]
    assert len(cuts) == 1
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    least = {n: n for pair in pairs for n in pair}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    found = simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.v: r.u for r in found} == {n: m for n, m in least.items() if n != m} and len(found) == len({r.v for r in found})


def test_simhash_deals_one_row_a_mask(spark, monkeypatch):
    """Chance partners don't add rows; a bucket over a tile is dealt in pairs of chunks and loses no link."""
    fps = [(i, (i // 2) << 20, 0) for i in range(400)]
    df = spark.createDataFrame(fps, "node long, fp long, fp2 long")
    dealt = [simhash._in_buckets(df.where(f"node < {n}"), simhash._sampled_masks(), []).count() for n in (40, 400)]
    assert dealt == [64 * 40, 64 * 400]
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", 0)
    roots = {r.v: r.u for r in simhash.components(simhash.links(df)).collect()}
    assert [roots.get(n, n) for n, _, _ in fps] == slow_components([n for n, _, _ in fps], [f for _, f, _ in fps]).tolist()


def test_similar_documents_finds_near_copies(spark, docs, texts):
    """Planted copies with one word in fifty changed are found where their exact Jaccard is 0.8, and no other texts are linked."""
    rng = np.random.default_rng(9)
    seen, rows = {}, []
    for d, t in sorted(texts.items()):
        if len(t.split(" ")) >= 80 and t not in seen and len(seen) < 60:
            seen[t] = d
            words = t.split(" ")
            for k in rng.choice(len(words), max(1, len(words) // 50), replace=False):
                words[k] = "changed"
            rows.append((100000 + d, " ".join(words), None, None, 0))
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(both).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in texts.items()} | {r[0]: shingles(r[1]) for r in rows}
    alike = lambda d, e: len(sets[d] & sets[e]) / len(sets[d] | sets[e])
    due = {d for d in seen.values() if alike(d, 100000 + d) >= 0.8}
    assert 40 < len(due) < len(seen)
    assert {d for d in seen.values() if found[100000 + d] == found[d]} == due
    reached = {}
    for d in sets:
        reached.setdefault(found[d], []).append(d)
    for members in reached.values():
        for d in members[1:]:  # each member is alike to some other member
            assert max(alike(d, e) for e in members if e != d) >= 0.8


def test_similar_documents_are_alike_by_exact_shingles(spark):
    """Components equal those of the pairs at Jaccard 0.8 or more; others stay apart, however close their fingerprints."""
    rng = np.random.default_rng(3)
    rows, sets = [], {}
    for base in range(30):
        words = [f"w{n}" for n in rng.integers(0, 5000, 200)]
        for edits in (0, 1, 2, 6, 9, 12):
            own = list(words)
            for k in rng.choice(200, edits, replace=False):
                own[k] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(own), None, None, 0))
            sets[len(sets)] = {tuple(own[i:i + 5]) for i in range(196)}
    rows += [(1000, " ".join(["same"] * 3000) + " " + " ".join(f"a{i}" for i in range(50)), None, None, 0),
             (1001, " ".join(["same"] * 3000) + " " + " ".join(f"b{i}" for i in range(50)), None, None, 0)]  # fingerprints alike, sets are not
    ids = sorted(sets)
    root = {d: d for d in ids}
    for _ in ids:
        for a in ids:
            for b in range(a - a % 6, a):
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1001] == 1001
    for d in ids:  # nothing is joined that the exact rule keeps apart
        assert root[found[d]] == root[d]
    assert sum(found[d] == root[d] for d in ids) >= 0.98 * len(ids)


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 4)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


# 8 multiset fingerprints

def test_fingerprints_equal_brute_force(spark, sf_dir, texts):
    rows = sorted(queries.op8_fingerprints(spark, sf_dir).collect())
    ids = sorted(texts)
    assert [r.doc_id for r in rows] == ids
    for i, r in enumerate(rows):
        text, following = texts[ids[i]], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == multiset.Multiset.of(multiset.paragraphs(text)).text()
        assert r.edited_fingerprint == multiset.Multiset.of(multiset.paragraphs(changed)).text()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95


def test_fingerprints_over_many_parts(docs, texts):
    rows = multiset.document_fingerprints(docs, part_bytes=20000).collect()
    ids = sorted(texts)
    assert {r.doc_id: r.edited_sha256 for r in rows} == {
        d: hashlib.sha256(multiset.edited(texts[d], texts[ids[(i + 1) % len(ids)]]).encode()).hexdigest() for i, d in enumerate(ids)}


def test_multiset_is_homomorphic():
    a, b = [b"one", b"two", b"two"], [b"three", b"one"]
    whole = multiset.Multiset.of(a + b)
    assert whole.text() == multiset.Multiset.of(b[::-1]).add(a[::-1]).text()
    assert whole.remove(b).text() == multiset.Multiset.of(a).text()
    assert multiset.Multiset.parse(whole.text()).text() == whole.text()


def test_likeness_follows_shared_pieces():
    """The estimate against the exact cosine of piece counts, long repetitions included."""
    def exact(a, b):
        x, y = (Counter(p for q in multiset.paragraphs(t) for p in multiset.pieces(q)) for t in (a, b))
        return sum(n * y[p] for p, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5

    rng = np.random.default_rng(4)
    words = [f"w{n}" for n in rng.integers(0, 3000, 900)]
    base = "\n".join(" ".join(words[i:i + 30]) for i in range(0, 900, 30))
    others = ["\n".join(base.split("\n")[:k]) + "\n" + " ".join(f"x{n}" for n in rng.integers(0, 3000, 30 * (30 - k))) for k in (3, 15, 27)]
    for other in others:
        assert abs(multiset.likeness(*(multiset.Multiset.of(multiset.paragraphs(t)) for t in (base, other))) - exact(base, other)) < 0.2
    line = "The same line of some words\n"
    a, b, c = (multiset.Multiset.of(multiset.paragraphs(t)) for t in (line * 40000, line * 20000, line * 65536 + "and one more line"))
    assert multiset.likeness(a, b) > 0.99 and multiset.likeness(a, c) > 0.99
    assert multiset.Multiset.parse(c.text()).text() == c.text() and a.text() != b.text()


def test_paragraphs_are_told_apart():
    one, two, three = ("First paragraph one two three.", "one two three.\nFirst paragraph", "x\nFirst paragraph one two three.")
    prints = [multiset.Multiset.of(multiset.paragraphs(t)) for t in (one, two, three)]
    assert len({p.text() for p in prints}) == 3 and prints[2].remove([b"x"]).text() == prints[0].text()


def test_fingerprints_odd_rows(odd, empty):
    assert multiset.document_fingerprints(odd).count() == len(ODD)
    assert multiset.document_fingerprints(empty).count() == 0


# 9 HTML extraction

PAGE = ('<html><head><title>T</title><style>x</style></head><body><header class="site-header"><a href=/>Home</a></header><div class="cookie-banner">We use cookies here.</div>'
        '<article><h1>Title &amp; one</h1><p>Hello <b>bold</b>\n world&nbsp;of &lt;b&gt;things.</p><div class="advert">Buy this now!</div><p>Second<br>line.<p>Third.<form><label>Mail</label></form>'
        '<script>var t="</p>";</script></article><section id="comments"><p>Nice post, thanks a lot.</p></section><aside>Side text.</aside><footer>&copy; 2020</footer></body></html>')


def article_text(html):
    import html as entities

    inside = html[html.index("<article>") + 9:html.index("</article>")]
    blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_extraction_equals_article_text(spark):
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    rows = queries.op9_html_extraction(spark, sf).collect()
    assert len(rows) == len(html)
    right = sum(r.text == article_text(html[r.page_id]) for r in rows)
    assert right >= 0.99 * len(rows) and all(r.n_chars == len(r.text) for r in rows)


def test_extraction_of_unseen_markup(spark, sf_dir):
    chain = html_crf.train(table(spark, sf_dir, "pages"))
    assert html_crf.main_text(PAGE, chain) == "Title & one\nHello bold world of <b>things.\nSecond line.\nThird."


SHAPES = {
    '<nav><a href=/>Home</a></nav><main><h2>Results of the year</h2><table><tr><th>Year</th><td>2020 was good.</td></tr></table><ul><li>First item here</li></ul><blockquote>A quote.</blockquote><pre>code line</pre></main><footer>Copyright</footer>':
        "Results of the year\nYear\n2020 was good.\nFirst item here\nA quote.\ncode line",
    "<div>First content of a page without names.</div><div>Second content of the page, longer than the first one.</div>":
        "First content of a page without names.\nSecond content of the page, longer than the first one.",
    "<p>First paragraph.</p><p>Second paragraph of the page.</p>": "First paragraph.\nSecond paragraph of the page.",
    '<header class="site-header"><a href=/>Home</a></header><article><header><h1>Headline of it</h1></header><p>Some text of the article.</p></article>': "Headline of it\nSome text of the article.",
    "<article><p>one <svg width=1/> two</p><p>three</p></article>": "one two\nthree",
    "<article><p>one <object data=x> two</p><canvas><p>three</p><select><option>no</option></select><p>four</p></article>": "one two\nthree\nfour",
}


def test_extraction_of_other_shapes(spark):
    chain = html_crf.train(table(spark, "/root/testdata/sf0.01", "pages"))
    for page, text in SHAPES.items():
        assert html_crf.main_text(f"<html><body>{page}</body></html>", chain) == text


def test_hostile_tags_take_linear_time():
    import time

    shapes = ["<b></i>" * 40000, "<b>" * 20000 + "<div>" + "</b>" * 20000, "<div class=deep>x" * 10000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000, "<ul>" * 20000 + "<p>x</p>" * 20000, "<button>" * 40000, "<button>a</button>x" * 20000]
    for html in shapes:
        start = time.perf_counter()
        html_crf.page_features(html_crf.blocks(html))
        assert time.perf_counter() - start < 3, html[:30]


def test_blocks_share_paths_and_leave_buttons_out():
    found = html_crf.blocks('<div class=a><p>one <button type=submit>Send <b>now</b></button>two</p><p>three</p></div><div class=a><p id=x>four</p></div><p>the sum <math><mi>x</mi><mo>+</mo><msup><mi>y</mi><mn>2</mn></msup></math> is</p><button>open')
    assert [b.text for b in found] == ["one two", "three", "four", "the sum x+y2 is", "open"]
    assert found[0].path is found[1].path and list(found[1].path) == [("div", "a"), ("p", "")] and list(found[2].path) == [("div", "a"), ("p", "x")]
    assert not any(b.hidden for b in found) and [b.hidden for b in html_crf.blocks("<div hidden><p>a</p></div><p>b</p>")] == [True, False]
    assert [b.text for b in html_crf.blocks("<p>a<button>x<button>y</button>b</p><button>")] == ["a b"]


def test_hostile_markup_takes_linear_time():
    import time

    for part in ("<p", '<p "', "<a href='", "<!-", "<svg>", "</", "<div>"):
        start = time.perf_counter()
        html_crf.blocks(part * 40000)
        assert time.perf_counter() - start < 5, part


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    chain = html_crf.Chain(rng.normal(size=1 << html_crf.BITS), rng.normal(size=(2, 2)), rng.normal(size=2))
    features = [rng.integers(0, 50, 4).tolist() for _ in range(8)]
    local = chain._scores(features)

    def score(y):
        return chain.start[y[0]] + sum(local[i][v] for i, v in enumerate(y)) + sum(chain.pairs[a][b] for a, b in zip(y, y[1:]))

    best = max(([n >> i & 1 for i in range(8)] for n in range(256)), key=score)
    assert chain.viterbi(features) == best
    single, _ = chain.marginals(features)
    weights = np.array([np.exp(score([n >> i & 1 for i in range(8)])) for n in range(256)])
    assert np.allclose(single[3, 1], weights[[n for n in range(256) if n >> 3 & 1]].sum() / weights.sum())


def test_extraction_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>unclosed <b>text &am"), (3, "u", "<p" * 2000), (4, "u", "<article><p>" + "word " * 30000)], "page_id long, url string, html string")
    rows = {(r.page_id, r.n_chars): r.text for r in html_crf.extract(pages).collect()}
    assert rows[(1, 0)] == "" and rows[(2, 0)] == "" and rows[(4, 149999)]
    assert html_crf.extract(pages.limit(0)).count() == 0


# 10 mixing

def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_mixing(spark, sf).toPandas()
    total = rows.n_tokens.sum()
    for domain, share in mixing.TARGETS.items():
        assert abs((rows.n_tokens * rows[f"p_{domain}"] * rows.rate).sum() / total - share) < 2e-3
    assert (rows.rate >= 0).all() and np.allclose(rows[[f"p_{d}" for d in mixing.TARGETS]].sum(axis=1), 1)


def test_mixing_rates_equal_direct_solution(spark):
    members = spark.createDataFrame([(1, 10, 0.9, 0.1), (2, 20, 0.2, 0.8), (3, 30, 0.5, 0.5)], "doc_id long, n_tokens long, p_a double, p_b double")
    rate = mixing.rates(members, ["a", "b"], {"a": 0.6, "b": 0.4})
    rows = members.withColumn("rate", rate).toPandas()
    n, p = rows.n_tokens.to_numpy(float), rows[["p_a", "p_b"]].to_numpy()
    curve = (p * n[:, None]).T @ p
    direct = 1 + p @ np.linalg.solve(curve, np.array([36.0, 24.0]) - n @ p)
    assert np.allclose(rows.rate, direct, atol=1e-2)


def test_mixed_keeps_every_document(spark, sf_dir, docs):
    out = mixing.mixed(docs, table(spark, sf_dir, "labels"), {"good": 0.7, "poor": 0.3}, min_rate=1.0)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert out.count() > docs.count()


def written_out(df):
    """Length of the plans that the driver writes out for a query."""
    return len(df._jdf.queryExecution().toString())


def test_tables_stand_in_plans_once(spark, sf_dir, docs):
    """The driver writes a plan out each time a stage ends: the tables of the fold, and those of the domains, stand in it once."""
    words = spark.createDataFrame([("ab",)], "word string")
    assert written_out(sentencepiece_lattice.encode_words(words, sentencepiece_lattice.load_model())) < 800_000
    assert written_out(mixing.mixed(docs, table(spark, sf_dir, "labels"), {"good": 0.7, "poor": 0.3}, min_rate=1.0)) < 300_000


def test_mixed_repeats_by_the_rate_of_the_members(spark, sf_dir, docs):
    """Rows are repeated by the rate that posteriors computed by themselves give."""
    labels, targets = table(spark, sf_dir, "labels"), {"good": 0.7, "poor": 0.3}
    model = mixing.fit(docs, mixing.label_domains(labels), list(targets))
    members = mixing.cut(mixing.with_posteriors(docs, model))
    rate = mixing.rates(members, model.domains, targets, 1.0)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    wanted = docs.join(members, "doc_id").select("doc_id", F.floor(rate + chance).alias("n")).where("n > 0")
    found = mixing.mixed(docs, labels, targets, min_rate=1.0).groupBy("doc_id").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_single_characters_have_their_own_ids(spark):
    model = sentencepiece_lattice.load_model()
    own = {p: i for p, i, _ in model.pieces if len(p) == 1}
    chars = [*sorted(own), "\u0001", "\uffff", "\U0001f9ff", "\U0010ffff", ""]
    words = spark.createDataFrame([(c,) for c in chars], "word string")
    found = words.select("word", sentencepiece_lattice._single(model, F.lit(0)).alias("i")).collect()
    assert {r.word: r.i for r in found} == {c: own.get(c) for c in chars}


def test_mixing_odd_rows(spark, odd, empty, sf_dir):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(odd, labels).count() == len(ODD)
    assert mixing.mixing_rates(empty, labels).count() == 0
