"""Breadth-first walk over stored links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.checkpoints import cut


def walk(starts: DataFrame, links: DataFrame, items: DataFrame, keys: list[str], max_depth: int = 2) -> DataFrame:
    """keys, page, depth and is_item of every page that is reached from the starts in ``max_depth`` steps.

    ``starts`` and ``items`` have keys and page, ``links`` keys, page and target, inside one site by its
    keys. A page is read once, at its least depth; links of an item's page are not followed, those of
    start pages always are. Cycles, repeated links and links to oneself end at the pages already seen,
    which are kept in the shared folder, so a step costs one join of the last pages with their links.
    """
    page = [*keys, "page"]
    edges = links.select(*keys, "page", "target").dropna().distinct()
    seen = cut(starts.select(*page).dropna().distinct().withColumn("depth", F.lit(0)))
    marked = items.select(*page).dropna().distinct().withColumn("is_item", F.lit(True))
    last, out = seen, None
    for depth in range(1, max_depth + 1):
        reached = last.select(*page).join(edges, page).select(*keys, F.col("target").alias("page")).distinct()
        new = cut(reached.join(seen, page, "left_anti").join(marked, page, "left").select(*page, F.lit(depth).alias("depth"), F.coalesce("is_item", F.lit(False)).alias("is_item")))
        out = new if out is None else out.unionByName(new)
        if depth == max_depth or new.isEmpty():
            break
        seen = seen.unionByName(new.drop("is_item"))
        last = new.where(~F.col("is_item"))
    return out
