"""Facts in the JSON that pages carry: structured data, state of the page, and streams of pushed chunks.

A page's JSON has no fixed shape, so its tree is walked in Arrow batches, a page at a time; which parts
of the page are JSON, and which reader goes first, is said by expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources.html import NUTRIENTS, open_graph

# Nutrients as pages' own state names them (signs and case aside), their ceilings, and other keys.
LOOSE = {"calories": "kcal", "energy": "kcal", "kcal": "kcal", "protein": "protein", "carbs": "carbs", "carbohydrates": "carbs", "totalcarbohydrates": "carbs", "fat": "fat", "totalfat": "fat",
         "sugar": "sugar", "sugars": "sugar", "totalsugars": "sugar", "saturatedfat": "sat_fat", "satfat": "sat_fat", "transfat": "trans_fat", "transfattyacid": "trans_fat",
         "cholesterol": "cholesterol", "sodium": "sodium", "fiber": "fiber", "dietaryfiber": "fiber"}
CEILINGS = {"kcal": 5000.0, "protein": 250.0, "carbs": 500.0, "fat": 400.0, "sugar": 500.0, "sat_fat": 200.0, "trans_fat": 100.0, "cholesterol": 5000.0, "sodium": 30000.0, "fiber": 200.0}
ALLERGENS = ("allergen", "allergens", "itemallergen", "containsallergens")
INGREDIENTS = ("ingredients", "ingredientstatement", "itemingredientstatement")
LEAST_NUTRIENTS = 2
ITEM_KINDS = ("product", "menuitem", "recipe", "fooditem")
LD_SCRIPT = r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'
STATE = (r'(?s)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>', r"(?s)data-wp-context='(\{.*?\})'", r'(?s)("nutrition"\s*:\s*\[.*?\])')
CHUNK = r'self\.__next_f\.push\(\[1,\s*"((?:[^"\\]|\\.)*)"\]\)'
NAME_REACH = 800  # a label's name stands at most so many signs before it
_FIELDS = tuple(CEILINGS)
_TEXTS = ("name", "photo", "allergens", "ingredients")
FACTS = T.StructType([*[T.StructField(n, T.StringType()) for n in _TEXTS], *[T.StructField(n, T.DoubleType()) for n in _FIELDS]])


def _amount(field: str, value) -> float | None:
    """A number, or the digits of a text, where the nutrient can be that much."""
    if isinstance(value, (int, float)):
        number = float(value)
    else:
        try:
            number = float(re.sub(r"[^0-9.]", "", str(value)))
        except ValueError:
            return None
    return number if 0 <= number <= CEILINGS[field] else None


def _tree(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _nodes(tree) -> Iterator[dict]:
    """All objects of a tree, outer ones first, in their order."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        inner = node if isinstance(node, list) else list(node.values()) if isinstance(node, dict) else []
        if isinstance(node, dict):
            yield node
        waiting += inner[::-1]


def _take(found: dict, key: str, value) -> None:
    if value is not None and key not in found:
        found[key] = value


def item_facts(scripts: list[str]) -> dict:
    """Facts of item-like nodes; of several nodes the first that has a field gives it."""
    found: dict = {}
    for node in (n for s in scripts if (t := _tree(s.strip())) is not None for n in _nodes(t)):
        kinds = node.get("@type")
        if not any(str(k).lower() in ITEM_KINDS for k in (kinds if isinstance(kinds, list) else [kinds])):
            continue
        if node.get("name"):
            _take(found, "name", unescape(str(node["name"])).strip())
        image = node.get("image")
        image = image.get("url") if isinstance(image, dict) else image
        image = next((i for i in image if isinstance(i, str)), None) if isinstance(image, list) else image
        _take(found, "photo", image if isinstance(image, str) else None)
        if isinstance(node.get("nutrition"), dict):
            told = {k.lower(): v for k, v in node["nutrition"].items()}
            for key, field in NUTRIENTS.items():
                if key in told:
                    _take(found, field, _amount(field, told[key]))
    return found


def _block(node: dict) -> dict[str, float]:
    """The nutrients that one object states: as rows, as an object, or as its own keys."""
    stated = []
    rows = node.get("nutrition")
    if isinstance(rows, list):
        stated += [(r.get("key") or r.get("label") or r.get("name") or "", r["value"] if "value" in r else r.get("amount")) for r in rows if isinstance(r, dict)]
    elif isinstance(rows, dict):
        stated += rows.items()
    stated += [(k, v) for k, v in node.items() if isinstance(v, (int, float, str))]
    block: dict[str, float] = {}
    for key, value in stated:
        field = LOOSE.get(re.sub("[^a-z]", "", str(key).lower()))
        if field and value is not None:
            _take(block, field, _amount(field, value))
    return block


def state_facts(blobs: list[str]) -> dict:
    """Facts of pages' own state: only objects with ``LEAST_NUTRIENTS`` nutrients or more count."""
    found: dict = {}
    for blob in blobs:
        text = unescape(blob.strip())
        for node in _nodes(_tree(text if text.startswith("{") else "{" + text + "}")):
            for key, value in node.items():
                plain = re.sub("[^a-z]", "", str(key).lower())
                kind = "allergens" if plain in ALLERGENS else "ingredients" if plain in INGREDIENTS else None
                if kind and isinstance(value, str) and value.strip():
                    _take(found, kind, value.strip())
            block = _block(node)
            if len(block) >= LEAST_NUTRIENTS:
                for field, value in block.items():
                    _take(found, field, value)
    return found


def _reader(facts):
    @F.pandas_udf(FACTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [facts(list(t)) if t is not None else {} for t in texts]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object if n in _TEXTS else "float64") for n in FACTS.names})

    return run


def _found(html: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns])


def page_ladder(pages: DataFrame) -> DataFrame:
    """page_id, all facts and ``shapes``: structured data, then the page's state, then Open Graph.

    Each reader adds what those before it did not find. Pages that are null or hold no JSON that can be
    read have nulls and no shapes.
    """
    html = F.col("html")
    read = pages.select("page_id", _reader(item_facts)(_found(html, (LD_SCRIPT,))).alias("a"), _reader(state_facts)(_found(html, STATE)).alias("b"),
                        open_graph(html, "title").alias("title"), open_graph(html, "image").alias("image"))
    graph = {"name": F.col("title"), "photo": F.col("image")}
    def any_of(side: str) -> Column:
        return F.coalesce(*[F.col(f"{side}.{n}").cast("string") for n in FACTS.names]).isNotNull()

    shapes = F.array_compact(F.array(F.when(any_of("a"), "json-ld"), F.when(any_of("b"), "embedded-json"), F.when(F.coalesce("title", "image").isNotNull(), "open-graph")))
    return read.select("page_id", *[F.coalesce(f"a.{n}", f"b.{n}", *([graph[n]] if n in graph else [])).alias(n) for n in FACTS.names], F.array_join(shapes, ",").alias("shapes"))


def stream(html: str) -> str:
    """The pushed chunks of a page put together; chunks that can't be read are left out."""
    parts = (_tree(f'"{c}"') for c in re.findall(CHUNK, html))
    return "".join(p for p in parts if isinstance(p, str))


def objects(text: str) -> list[tuple[int, int]]:
    """Where objects start and end, inner ones first, by depth of brackets outside strings, in one pass.

    Lines are read on their own, as raw line ends don't stand inside JSON; an object that isn't closed
    in its line, as at the end of a stream that was cut off, is none.
    """
    found, line_start = [], 0
    for line in text.split("\n"):
        open_at, in_string, skip = [], False, False
        for m in re.finditer(r'[{}"\\]', line):
            sign, at = m[0], m.start()
            if skip and at == skip:
                skip = False
                continue
            if in_string:
                if sign == "\\":
                    skip = at + 1
                elif sign == '"':
                    in_string = False
            elif sign == '"':
                in_string = True
            elif sign == "{":
                open_at.append(at)
            elif sign == "}" and open_at:
                found.append((line_start + open_at.pop(), line_start + at + 1))
        line_start += len(line) + 1
    return found


def marked_objects(text: str, marker: str) -> list[dict]:
    """The innermost readable object around each place of ``marker``, once each, in order."""
    spans, found = sorted(objects(text), key=lambda s: s[1] - s[0]), {}
    for hit in re.finditer(re.escape(marker), text):
        for start, end in spans:
            if start <= hit.start() < end and isinstance(tree := _tree(text[start:end]), dict):
                found.setdefault(start, tree)
                break
    return [found[s] for s in sorted(found)]


def label(html: str, name: str | None) -> dict[str, float]:
    """The label whose nearest name before it is ``name``, case aside; without a name the first; else nothing."""
    text = stream(html) or html
    for start, end in sorted(objects(text)):
        if not re.search(r'"nutrition"\s*:\s*$', text[max(0, start - 30):start]):
            continue
        tree = _tree(text[start:end]) or {}
        told = {k.lower(): v for k, v in tree.items()}
        values = {}
        for key, field in NUTRIENTS.items():
            amount = re.search(r"[0-9]+(?:\.[0-9]+)?", str(told.get(key, "")))
            if amount:
                values[field] = round(float(amount[0]), 1)
        names = re.findall(r'"name":"((?:[^"\\]|\\.)*)"', text[max(0, start - NAME_REACH):start])
        if values.get("kcal") and (name is None or names and names[-1].strip().lower() == name.strip().lower()):
            return values
    return {}


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in _FIELDS]))
def stream_label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """``label`` of pages (html, name); null html has none."""
    for pages, names in batches:
        rows = [label(h, n) if h is not None else {} for h, n in zip(pages, names, strict=True)]
        yield pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype="float64") for f in _FIELDS})
