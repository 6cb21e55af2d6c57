"""Cross-site boilerplate lines by distinct-site spread (operator 2).

A line is spread if it stands on at least ``min_sites`` different sites. Lines of copied documents are
spread too, so a second count takes the sites of documents alone that have a line of their own, one
that isn't spread: a spread line on ``min_sites`` sites of such documents is boilerplate. However short
a page, its notice goes, and blocks of several lines go as a whole. Texts that are copied as a whole
have no line of their own and are left to document deduplication. A body that ``min_sites`` sites print
below lines of their own is boilerplate by this rule and goes from all of them.
Both counts: one HyperLogLog sketch of sites per line hash merges by aggregation, and lines whose
estimate is near the threshold get an exact distinct count, so results equal the exact rule.
Every occurrence of a boilerplate line is taken out of its document.

Edge cases: lines are compared without outer spaces and empty lines stay; a null text is an empty
one; a null source is a site of its own; documents that lose all lines stay with an empty text;
repeated rows stay; an empty table gives an empty table; other columns are kept as they are: where
``docs`` has n_lines or n_removed already, the counts get the names of ``count_names``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, fresh, text_or_empty

MIN_SITES = 10
LG_K = 10
NEAR = 0.25  # relative distance from the threshold within which counts are exact; over seven standard errors
INLINE_LINES = 50_000  # up to so many boilerplate lines are kept in the plan, more are joined
BROADCAST_LINES = 200_000  # up to so many spread lines (a long each) are broadcast


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that count lines and removed lines: n_lines and n_removed unless taken."""
    return fresh(docs, "n_lines"), fresh(docs, "n_removed")


def _hashes(text):
    return F.transform(F.split(text, "\n"), lambda line: F.when(F.trim(line) != "", F.xxhash64(F.trim(line))))


def _occurrences(docs: DataFrame) -> DataFrame:
    """key (of the text), site and h of every line that isn't empty."""
    hashed = docs.select(F.xxhash64(text_or_empty()).alias("key"), F.coalesce(F.xxhash64("source"), F.lit(0)).alias("site"), F.explode(_hashes(text_or_empty())).alias("h"))
    return hashed.where("h is not null")


def _on_sites(lines: DataFrame, min_sites: int) -> DataFrame:
    """h of the lines on ``min_sites`` sites or more; ``lines`` must be cheap to read again."""
    spread = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    possible = spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - NEAR)))
    possible = cut(possible.select("h", (F.col("sites") >= min_sites * (1 + NEAR)).alias("sure")))
    near = possible.where(~F.col("sure")).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(possible.where("sure").select("h").unionAll(exact.select("h")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """h (xxhash64 of the trimmed line) of every boilerplate line."""
    lines = cut(_occurrences(docs))
    spread = _on_sites(lines, min_sites)
    small = F.broadcast(spread) if spread.count() <= broadcast_lines else spread
    marked = lines.join(small.withColumn("spread", F.lit(1)), "h", "left")
    own = marked.groupBy("key").agg(F.count("spread").alias("spread"), F.count("*").alias("n")).where("spread > 0 AND spread < n").select("key")
    return _on_sites(cut(lines.join(small, "h", "left_semi").join(own, "key", "left_semi").select("h", "site")), min_sites)


def remove_lines(docs: DataFrame, lines: DataFrame, inline_lines: int = INLINE_LINES) -> DataFrame:
    """``docs`` with the given line hashes taken out of ``text``, and counts named by ``count_names``.

    Few hashes are held in the plan as a set; more reach their documents by joins.
    """
    taken = fresh(docs, "line_hashes")
    some = lines.limit(inline_lines + 1).collect()
    kept_name = fresh(docs, "kept_lines")
    if len(some) <= inline_lines:
        values = [r.h for r in some]
        kept = F.filter(F.split(text_or_empty(), "\n"), lambda line: ~F.xxhash64(F.trim(line)).isin(values)) if values else F.split(text_or_empty(), "\n")
        marked = docs.withColumn(kept_name, kept)
    else:
        key = fresh(docs, "row_key")
        keyed = docs.withColumn(key, F.xxhash64(text_or_empty()))  # equal texts lose the same lines
        found = (keyed.select(key, text_or_empty().alias("t")).select(key, F.explode(F.array_distinct(_hashes(F.col("t")))).alias("h"))
                 .distinct().join(lines, "h", "left_semi").groupBy(key).agg(F.collect_set("h").alias(taken)))
        joined = keyed.join(found, key, "left")
        kept = F.filter(F.split(text_or_empty(), "\n"), lambda line: ~F.array_contains(F.coalesce(F.col(taken), F.array().cast("array<bigint>")), F.xxhash64(F.trim(line))))
        marked = joined.withColumn(kept_name, kept).drop(key, taken)
    total = F.size(F.split(text_or_empty(), "\n"))
    lines_name, removed_name = count_names(docs)
    return (marked.withColumn(lines_name, total).withColumn(removed_name, total - F.size(kept_name))
            .withColumn("text", F.when(F.col(removed_name) > 0, F.array_join(kept_name, "\n")).otherwise(F.col("text"))).drop(kept_name))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines, and n_lines and n_removed."""
    return remove_lines(docs, boilerplate(docs, min_sites))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, source IS NULL AS nosite, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, site, nosite, i, trim(ls[i], ' ') AS l, ls[i] AS raw FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
c AS (SELECT l FROM o WHERE l <> '' GROUP BY l HAVING count(DISTINCT (site, nosite)) >= {MIN_SITES}),
own AS (SELECT doc_id FROM o LEFT JOIN c USING (l) WHERE l <> '' GROUP BY doc_id HAVING count(c.l) < count(*)),
b AS (SELECT l FROM o WHERE l IN (SELECT l FROM c) AND doc_id IN (SELECT doc_id FROM own) GROUP BY l HAVING count(DISTINCT (site, nosite)) >= {MIN_SITES})
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE b.l IS NOT NULL) AS INTEGER) AS n_removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE b.l IS NULL), '')) AS text_md5
FROM o LEFT JOIN b ON o.l = b.l GROUP BY doc_id
"""
