"""Personal data by boosted trees over candidate spans (operator 5), in DataFrame functions only.

1. Base rules find e-mail addresses, IP addresses, card and phone numbers with their offsets.
2. High-recall generators propose overlapping spans in the same text: words around an at sign or a
   spelt-out one, digit groups with separators, dotted numbers.
3. Every span gets format features (lengths, digit and separator counts, check digit) and context
   features (the characters and words before and after). Gradient-boosted trees are fitted on a
   bounded sample of spans: those that the base rules accept and rewritten forms of them (plus sign
   dropped, at sign spelt out) against the rest.
4. The trees are compiled to CASE expressions and summed inside the scan, so no rows are shuffled
   and nothing leaves the JVM. A threshold calibrated for precision on spans kept from the fit
   selects additional spans; base spans always stay.

Offsets count code points, ends are exclusive. Edge cases: a null text is an empty one and has no
spans; ties are ordered by start, kind and end; repeated rows stay; with too few spans to learn from
only base spans are returned; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and the guards in front change no match: a match starts where its run of
# characters starts, or where the last match ended. They keep long runs linear and the stack flat.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?[\[(](?:at|AT)[\])] ?| at )[A-Za-z0-9-]{1,63}+(?:(?:\.| dot )[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.:][0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?:\+|\b00|(?<![0-9A-Za-z]))[0-9(](?:[\x20().-]{0,6}+[0-9]){5,21}+",
}
SAMPLE_DOCS = 4000  # documents with candidates that the trees are fitted on, at most
SAMPLE_CHARS = 20000  # longer documents aren't used for training (all are searched)
SAMPLE_SPANS = 20000
PRECISION = 0.99
RUN = 256  # spans of one text that are placed and compared together


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(items: Column) -> Column:
    """``items`` in runs of ``RUN``: what a fold copies or compares for each item then stays small however many there are."""
    last = F.greatest((F.size(items) - 1) / RUN, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * RUN + 1, F.lit(RUN)))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,span>> of all matches; offsets from the pieces between them, summed by runs."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def total(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), lambda n, pair: n + F.length(pair["piece"]) + F.length(pair["span"]))

    def onto(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["span"])
        item = F.array(F.struct(start.alias("start"), end.alias("end"), pair["span"].alias("span")))
        return F.struct(end.alias("at"), F.concat(acc["out"], item).alias("out"))

    def placed(run: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,span:string>>").alias("out"))
        return F.aggregate(run, zero, step, lambda acc: acc["out"])

    def by_runs(runs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(F.transform(runs, total), zero, onto, lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, starts, placed))

    pairs = _let(found, lambda f: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(f)).alias("piece"), f.alias("span")))
    return _let(_let(pairs, _runs), by_runs)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") >= 5, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _accepted(kind: str, span: Column) -> Column:
    digits = _digits(span)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPANS = "array<struct<start:int,kind:int,end:int,span:string>>"


def _typed(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["span"].alias("span"))).cast(_SPANS)


def _keeps(kind: str):
    return lambda s: _accepted(kind, s["span"])


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def _base_spans(text: Column) -> Column:
    """All base spans of a text, ordered by start and kind."""
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.filter(_matches(text, BASE[kind]), _keeps(kind))
        likely = F.col("_digit") if _NEEDS[kind] is None else (F.contains(text, F.lit(_NEEDS[kind])) & (F.lit(True) if kind == "email" else F.col("_digit")))
        parts.append(F.when(likely, _typed(found, k)).otherwise(F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*parts))


def _may_hold_email(text: Column) -> Column:
    """Holds for every text with a match of the e-mail candidates: one of their at signs is in it."""
    signs = [F.contains(text, F.lit(a)) for a in ("@", " at ", "(at", "[at", "(AT", "[AT")]
    return reduce(or_, signs)


def _candidate_spans(text: Column) -> Column:
    parts = [_typed(_matches(text, CANDIDATES[kind]), k) for k, kind in enumerate(KINDS)]
    parts[0] = F.when(_may_hold_email(text), parts[0]).otherwise(F.array().cast(_SPANS))
    for k in (1, 2, 3):
        parts[k] = F.when(F.col("_digit"), parts[k]).otherwise(F.array().cast(_SPANS))
    def with_context(window: Column, first: Column):
        """24 characters before and 12 after each span, out of the text from ``first`` on."""
        return lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["span"].alias("span"),
            F.substring(window, F.greatest(s["start"] - 23, F.lit(1)) - first, F.least(s["start"], F.lit(24))).alias("before"),
            F.substring(window, s["end"] + 1 - first, F.lit(12)).alias("after"))

    def around(run: Column) -> Column:
        """The text around a run is cut once, so that no span counts characters from the text's start."""
        first = F.greatest(F.get(run, F.lit(0))["start"] - 24, F.lit(0))
        window = F.substring(text, first + 1, F.element_at(run, -1)["end"] + 12 - first)
        cut_out = F.struct(first.alias("first"), window.alias("window"))
        return F.when(F.size(run) > 0, _let(cut_out, lambda w: F.transform(run, with_context(w["window"], w["first"]))))

    of_kinds = [_let(part, lambda spans: F.flatten(F.filter(F.transform(_runs(spans), around), lambda run: run.isNotNull()))) for part in parts]
    return F.concat(*of_kinds).cast("array<struct<start:int,kind:int,end:int,span:string,before:string,after:string>>")


FEATURES = ("kind", "length", "digits", "dots", "dashes", "spaces", "brackets", "plus", "at", "spelt_at", "letters", "groups", "luhn", "octets", "tail_letters",
            "edge_before", "edge_after", "label_before", "digit_before", "digit_after")


def _features(s: Column) -> list[Column]:
    """Format and context of one candidate; the order is that of FEATURES."""
    span, before, after = s["span"], s["before"], s["after"]
    digits = _digits(span)

    def count(pattern: str) -> Column:
        return F.length(span) - F.length(F.regexp_replace(span, pattern, ""))

    label = F.regexp_like(F.lower(before), F.lit(r"(phone|tel|call|fax|mobile|mail|contact|card|visa|account|ip|host|addr)[a-z]*[^a-z]{0,3}$"))
    values = [s["kind"], F.length(span), F.length(digits), count(r"\."), count("-"), count(r"\s"), count(r"[()]"), F.startswith(span, F.lit("+")).cast("int"),
              count("@"), F.regexp_like(span, F.lit(r"(?i)[\[(]at[\])]| at ")).cast("int"), count("[A-Za-z]"), F.size(F.split(span, r"[^0-9]+")),
              F.when(F.length(digits).between(12, 19), _luhn(digits).cast("int")).otherwise(0),
              F.when(s["kind"] == 1, F.forall(F.split(span, r"[.:]"), lambda p: p.cast("double") <= 255).cast("int")).otherwise(0),
              F.length(F.regexp_extract(span, r"\.([A-Za-z]+)$", 1)), F.regexp_like(before, F.lit(r"[A-Za-z0-9]$")).cast("int"),
              F.regexp_like(after, F.lit(r"^[A-Za-z0-9]")).cast("int"), label.cast("int"), F.regexp_like(before, F.lit(r"[0-9][^A-Za-z]{0,3}$")).cast("int"),
              F.regexp_like(after, F.lit(r"^[^A-Za-z]{0,3}[0-9]")).cast("int")]
    return [v.cast("double") for v in values]


@dataclass(frozen=True)
class SpanModel:
    """Weighted trees as nested (feature, threshold, left, right) or leaf values, and the threshold."""

    trees: tuple[tuple[float, object], ...]
    threshold: float

    def margin(self, features: list[Column]) -> Column:
        def compiled(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, limit, left, right = node
            return F.when(features[at] <= limit, compiled(left)).otherwise(compiled(right))

        return sum((F.lit(w) * compiled(t) for w, t in self.trees[1:]), F.lit(self.trees[0][0]) * compiled(self.trees[0][1]))


def _read_tree(node) -> object:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _read_tree(node.leftChild()), _read_tree(node.rightChild()))


def _apart_from(base: Column, spans: Column) -> Column:
    """``spans`` that share no character with a span of ``base``; each run meets those in its own range alone."""

    def apart(run: Column) -> Column:
        low, high = F.array_min(F.transform(run, lambda s: s["start"])), F.array_max(F.transform(run, lambda s: s["end"]))
        near = _let(F.struct(low.alias("low"), high.alias("high")), lambda r: F.filter(base, lambda b: (b["start"] < r["high"]) & (r["low"] < b["end"])))
        return _let(near, lambda few: F.filter(run, lambda s: ~F.exists(few, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    return _let(spans, lambda all_: F.flatten(F.transform(_runs(all_), apart)))


def _prepared(docs: DataFrame) -> DataFrame:
    base = docs.select("doc_id", text_or_empty().alias("text"))
    return base.withColumn("_digit", F.regexp_like(F.col("text"), F.lit("[0-9]")))


def train(docs: DataFrame) -> SpanModel | None:
    """Fit the trees on a bounded sample of documents, by least hash of their ids."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _prepared(docs).where(F.length("text") <= SAMPLE_CHARS).where(F.col("_digit") | F.contains("text", F.lit("@")))
    ids = rows.select(F.xxhash64("doc_id", "text").alias("key")).distinct().orderBy("key").limit(SAMPLE_DOCS)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text")).join(F.broadcast(ids), "key")
    found = rows.select("key", _base_spans(F.col("text")).alias("base"), F.explode(_candidate_spans(F.col("text"))).alias("s"))
    hit = F.exists("base", lambda b: (b["start"] == F.col("s.start")) & (b["end"] == F.col("s.end")) | (b["kind"] == F.col("s.kind")) & (b["start"] <= F.col("s.start") + 1) & (b["end"] == F.col("s.end")))
    spans = found.select("key", "s", hit.cast("double").alias("label"))
    spans = cut(spans.orderBy(F.xxhash64("key", "s.start", "s.kind"), "key", "s").limit(SAMPLE_SPANS))
    again = spans.where("label = 1").select("key", F.col("label"), F.struct(
        "s.start", "s.kind", "s.end",
        F.when(F.col("s.kind") == 3, F.regexp_replace("s.span", r"^\+[0-9]{1,2} ?", "")).when(F.col("s.kind") == 0, F.regexp_replace("s.span", "@", " at ")).otherwise(F.col("s.span")).alias("span"),
        "s.before", "s.after").cast(spans.schema["s"].dataType).alias("s"))
    data = spans.unionByName(again.where(F.col("s.kind").isin(0, 3)))
    columns = _features(F.col("s"))
    fold = F.pmod(F.xxhash64("key"), F.lit(4))
    data = cut(data.select("label", fold.alias("fold"), *[c.alias(n) for c, n in zip(columns, FEATURES)]).coalesce(4))
    fit_rows = data.where("fold > 0")
    seen = {r.label: r["count"] for r in fit_rows.groupBy("label").count().collect()}
    if min(seen.get(0.0, 0), seen.get(1.0, 0)) < 20:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=7).fit(vectors.transform(fit_rows))
    trees = tuple((float(w), _read_tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees))
    fitted = SpanModel(trees, 0.0)
    held = data.where("fold = 0").select("label", fitted.margin([F.col(n) for n in FEATURES]).alias("m")).orderBy(F.col("m").desc()).collect()
    right, threshold = 0, float("inf")
    for n, row in enumerate(held, 1):
        right += row.label
        if right / n >= PRECISION:
            threshold = row.m
    return SpanModel(trees, threshold) if threshold < float("inf") else None


def find_spans(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """doc_id, text, base and spans (array<struct<start,kind,end,span>>, ordered) of every row."""
    text = F.col("text")
    rows = _prepared(docs).withColumn("base", F.when(F.col("_digit") | F.contains(text, F.lit("@")), _base_spans(text)).otherwise(F.array().cast(_SPANS)))
    if model is None:
        return rows.select("doc_id", "text", "base", F.col("base").alias("spans"))
    asked = F.col("_digit") | _may_hold_email(text)
    rows = rows.withColumn("_scored", F.when(asked, F.transform(_candidate_spans(text), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["span"].alias("span"), model.margin(_features(s)).alias("margin"))
                                                                           ).cast("array<struct<start:int,kind:int,end:int,span:string,margin:double>>")))
    chosen = F.filter("_scored", lambda s: s["margin"] >= model.threshold)
    extra = F.transform(_apart_from(F.col("base"), chosen), lambda s: F.struct(s["start"], s["kind"], s["end"], s["span"])).cast(_SPANS)
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", F.coalesce(extra, F.array().cast(_SPANS)))).alias("spans"))


def _listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: base counts, the digest of its base spans, and all spans."""
    found = find_spans(docs, train(docs))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``doc_id`` and ``text`` with every selected span replaced by its kind."""
    found = find_spans(docs, train(docs))
    kinds = F.array(*[F.lit(mask.format(k)) for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(kinds, s["kind"])).alias("out")))
    done = F.aggregate("spans", zero, step)
    return found.withColumn("_done", done).select("doc_id", F.concat("_done.out", F.substring(F.col("text"), F.col("_done.at") + 1, F.length("text"))).alias("text"))
