"""Smaller steps of curation: unique names, routes, buckets, audits, links and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import slug


def qualified_names(items: DataFrame) -> DataFrame:
    """Names made unique in their chain: by section, then by serving; of what is left the first stays.

    Adds ``qualified`` and ``ambiguous`` (whether the row would have to go).
    """
    def repeated(name: str) -> Column:
        return F.count("*").over(Window.partitionBy("chain", slug(F.col(name)))) > 1

    first = items.withColumn("_dup", repeated("name")).withColumn("_n1", F.when(F.col("_dup") & F.col("category").isNotNull(), F.concat_ws(", ", "name", "category")).otherwise(F.col("name")))
    second = first.withColumn("_dup", repeated("_n1")).withColumn("qualified", F.when(F.col("_dup") & F.col("serving").isNotNull(), F.concat("_n1", F.lit(" ("), "serving", F.lit(")"))).otherwise(F.col("_n1")))
    order = Window.partitionBy("chain", slug(F.col("qualified"))).orderBy("item_id")
    return second.withColumn("ambiguous", F.row_number().over(order) > 1).drop("_dup", "_n1")


def route(kind: Column, photos: Column) -> Column:
    """Steps of a refresh by the kind of source: numbers, presence and photos, in this order."""
    return F.array_compact(F.array(
        F.when(kind.isin("site", "api", "table", "guide"), F.lit("numbers")), F.when(kind.isin("site", "api"), F.lit("presence")), F.when(photos.isNotNull(), F.lit("photos"))))


def buckets(rows: DataFrame, state: str, name: str, shown: int = 6) -> DataFrame:
    """Per state: how many rows, the first names, and how many more there are."""
    order = Window.partitionBy(state).orderBy(name)
    first = rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= shown)
    names = first.groupBy(state).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))
    counts = rows.groupBy(state).agg(F.count("*").alias("n"))
    return counts.join(names, state).withColumn("more", F.greatest(F.col("n") - shown, F.lit(0).cast("bigint")))


def audit_fields(fields: list[str], was: str = "was", now: str = "now", share: float = 0.30) -> Column:
    """array<struct<field, large>> of all that differ; large by share alone, and always from zero."""
    found = []
    for f in fields:
        a, b = F.col(f"{was}.{f}"), F.col(f"{now}.{f}")
        large = F.when(a == 0, True).otherwise(F.abs(b - a) / a > share)
        found.append(F.when(a != b, F.struct(F.lit(f).alias("field"), large.alias("large"))))
    return F.array_compact(F.array(*found))


def stale_links(links: DataFrame, titles: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (key, title, file) whose title is still offered but for which the rule now gives another file."""
    live = links.join(titles.select("title").distinct(), "title", "left_semi")
    return live.join(chosen.select("key", F.col("file").alias("now")), "key").where(~F.col("file").eqNullSafe(F.col("now")))


def largest_image(urls: Column) -> Column:
    """The url of the greatest w= parameter; urls without one count as zero, the last of equals wins."""
    sized = F.transform(urls, lambda u: F.struct(F.coalesce(F.regexp_extract(u, r"[?&]w=([0-9]+)", 1).try_cast("int"), F.lit(0)).alias("width"), u.alias("url")))
    return F.array_max(sized)["url"]


def domain_candidates(name: Column) -> Column:
    """Hosts that a name may have: words together, hyphenated, without a leading 'the', the first word."""
    words = F.filter(F.split(slug(F.regexp_replace(name, "['’]", "")), "-"), lambda w: w != "")
    bare = F.when((F.size(words) > 1) & (F.get(words, F.lit(0)) == "the"), F.slice(words, F.lit(2), F.size(words) - 1)).otherwise(words)
    hosts = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(bare, ""), F.array_join(bare, "-"), F.get(bare, F.lit(0)))
    return F.transform(F.array_distinct(F.array_compact(hosts)), lambda h: F.concat(h, F.lit(".com")))


def guide_rows(lines: DataFrame, numbers: int) -> DataFrame:
    """guide, line_no, section, name and cells of lines that end in ``numbers`` numbers.

    A line without digits opens a section, which is carried over the lines after it.
    """
    tail = r"^(.*\S)((?:\s+<?[0-9][0-9.,]*){" + str(numbers) + r"})\s*$"
    name = F.nullif(F.regexp_extract("line", tail, 1), F.lit(""))
    heading = F.when(~F.regexp_like("line", F.lit("[0-9]")) & (F.trim("line") != ""), F.trim("line"))
    order = Window.partitionBy("guide").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = lines.withColumn("section", F.last(heading, ignorenulls=True).over(order)).withColumn("name", name).where("name is not null")
    return told.select("guide", "line_no", "section", "name", F.split(F.trim(F.regexp_extract("line", tail, 2)), r"\s+").alias("cells"))


def picture_score(tags: Column, title: Column, width: Column, wanted: Column, unwanted: list[str]) -> Column:
    """3 for a tag hit, 1 for a title hit, 1 for a wide picture, minus 6 for an unwanted word."""
    bad = F.lit(False)
    for word in unwanted:
        bad = bad | F.contains(F.lower(title), F.lit(word))
    return (F.when(F.array_contains(tags, wanted), 3).otherwise(0) + F.when(F.contains(F.lower(title), wanted), 1).otherwise(0)
            + F.when(width >= 1000, 1).otherwise(0) - F.when(bad, 6).otherwise(0))


def reusable(answered: Column, asked: Column, same: Column, seconds: int = 300) -> Column:
    """Whether an answer is still good: younger than the limit and of the same catalog."""
    age = F.unix_micros(asked.cast("timestamp")) - F.unix_micros(answered.cast("timestamp"))
    return F.coalesce((age >= 0) & (age < seconds * 1_000_000) & same, F.lit(False))
