"""Nutrition guides as ordered lines of text: items with names, servings, sections and numbers.

A guide's lines are read by their kind and what stands before them. Its state (the section, the group
inside it, the last line that was no item) is carried by windows over the guide's lines, so a guide is
one window partition, as large as one printed document; guides are read in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.checkpoints import cut
from larder.functions.text import slug
from larder.operators.nearest import nearest

# Signs of cells, marks, headings and servings in a guide's lines.
VALUE = r"(?:<?[0-9]+(?:[.,][0-9]+)?|[-–—]|[Nn]/?[Aa])"
FLAG_SIGNS = "#xX*•·\\-–—✓✔◆●○□■"
FOOTNOTES = "*†‡§ "
PAGE_MARK = r"(?i)^(?:page\s*)?[-–—\s]*[0-9]{1,3}[-–—\s]*$"
PAGE_OF = r"(?i)\s*\(\s*page\s+[0-9]+\s+of\s+[0-9]+\s*\)\s*$"
EXPLANATION = r"(?i)\s+(?:Values?\s+(?:include|are)|Double\s+values|Amount\s+on)\b.*$"
PARENTHESIS = r"\s*\([^)]*\)\s*$"
LONGEST_HEADING = 48
SERVING = r"[0-9]+(?:/[0-9]+)?(?:\.[0-9]+)?\s+[A-Za-z][\w.'’-]*(?:\s+[A-Za-z][\w.'’-]*){0,2}"
WORD_FIRST = r"(?:approx(?:imately)?|about|serves)\.?\s+[0-9]+(?:\.[0-9]+)?"
SIZE_ONLY = r"(?i)^(?:small|medium|large|regular|sack|kids?|jr\.?|single|double|triple)(?:\s*\([^)]*\))?$"
DESCRIPTION = r"(?s)^(.+?)\s+[-–—]\s+[a-z(].*$"
# Bounds that tell a wrong guide, and the geometry of pages.
LEAST_SODIUM, MOST_DRIFT, MOST_AMBIGUOUS, LEAST_KCAL = 50.0, 0.10, 0.10, 50.0
INDENT, PROXIMITY = 60.0, 15.0


@dataclass(frozen=True)
class Layout:
    """Columns of a guide's numbers in order; None where a column isn't kept."""

    columns: tuple[str | None, ...]
    serving_in_name: bool = False
    name_from_heading: bool = False


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), f"[{FOOTNOTES}]+$", "")


def split_line(line: Column, count: int) -> Column:
    """struct(name, cells) of a line that ends in ``count`` cells or more, the first of which count; else null.

    Marks of allergens at the end are no cells. The name may be empty here.
    """
    body = F.regexp_replace(F.trim(line), rf"(?:(?:^|\s+)[{FLAG_SIGNS}]+)+$", "")
    tail = F.regexp_extract(body, rf"(?:^|(?<=\s))({VALUE}(?:\s+{VALUE})*)$", 1)
    cells = F.split(tail, r"\s+")
    name = _bare(F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - F.length(tail)), r"\s+", " "))
    return F.when((tail != "") & (F.size(cells) >= count), F.struct(name.alias("name"), F.slice(cells, 1, count).alias("cells")))


def outer_heading(line: Column) -> Column:
    """The text of a heading in capitals, else null."""
    text = _bare(F.regexp_replace(F.trim(line), EXPLANATION, ""))
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return F.when((F.length(text) <= LONGEST_HEADING) & (F.length(letters) >= 4) & ~F.regexp_like(letters, F.lit(r"[^\p{Lu}]")), text)


def inner_heading(line: Column) -> Column:
    """The text of a group's heading: short, with a capital, without a full stop; else null."""
    text = _bare(F.regexp_replace(F.regexp_replace(F.trim(line), EXPLANATION, ""), PARENTHESIS, ""))
    return F.when((F.length(text) <= LONGEST_HEADING) & F.regexp_like(text, F.lit(r"(?s)^\p{Lu}.*(?<![.:,])$")), F.regexp_replace(text, PAGE_OF, ""))


def cell_number(cell: Column) -> Column:
    """The number of a cell; less than something, a dash or NA are unknown."""
    return F.when(~F.startswith(cell, F.lit("<")), F.replace(cell, F.lit(","), F.lit(".")).try_cast("double"))


def _values(layout: Layout) -> list[Column]:
    return [cell_number(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(layout.columns) if c is not None]


def _served(name: Column, layout: Layout) -> tuple[Column, Column]:
    """A serving at the end of the name, and the name without it."""
    found = F.nullif(F.regexp_extract(name, rf"\s+({SERVING})$", 1), F.lit("")) if layout.serving_in_name else F.lit(None).cast("string")
    return found, F.when(found.isNull(), name).otherwise(F.coalesce(F.nullif(F.trim(F.regexp_replace(name, rf"\s+({SERVING})$", "")), F.lit("")), name))


def parse(lines: DataFrame, layout: Layout) -> DataFrame:
    """guide, line_no, name, serving, section, category and the layout's numbers, an item a row.

    ``lines`` has guide, line_no (one row each) and line. A line of cells is an item; its name may be a
    mere size or serving, and then the last line without cells is the name: such a line looks like a
    heading, so the group it seemed to open is taken back from that item on. Empty lines, page marks
    and rows without a guide, number or text are left out.
    """
    rows = lines.select("guide", "line_no", "line").dropna().where(F.trim("line") != "")
    pulled = F.lit(None).cast("string")
    if layout.serving_in_name:
        pattern = rf"(?is)^(.*?)\s+({WORD_FIRST})(?=\s+[0-9])(.*)$"
        pulled = F.nullif(F.trim(F.regexp_extract("line", pattern, 2)), F.lit(""))
        rows = rows.withColumn("pulled", pulled).withColumn("line", F.when(F.col("pulled").isNotNull(), F.regexp_replace("line", pattern, "$1$3")).otherwise(F.col("line")))
    else:
        rows = rows.withColumn("pulled", pulled)
    rows = rows.withColumn("cut", split_line(F.col("line"), len(layout.columns)))
    is_item = F.coalesce(F.col("cut.name") != "", F.lit(False))
    rows = rows.withColumn("item", is_item).withColumn("told", F.col("item") | ~F.regexp_like(F.trim("line"), F.lit(PAGE_MARK)))
    note = ~F.col("item")
    outer = F.when(note, outer_heading(F.col("line")))
    rows = rows.withColumns({"outer": outer, "note": F.when(note, F.regexp_replace(F.trim("line"), PAGE_OF, ""))})
    rows = rows.withColumn("heading", F.when(note & F.col("outer").isNull(), inner_heading(F.col("line"))))
    # Lines are read once, wherever they lie; only what they told goes to the one task of a guide.
    tail, short = _served(F.col("cut.name"), layout)
    name = F.col("cut.name")
    plain = lambda c: F.trim(F.regexp_replace(c, DESCRIPTION, "$1"))
    deferred = F.lit(layout.name_from_heading) | F.regexp_like(name, F.lit(SIZE_ONLY)) | (F.lit(layout.serving_in_name) & F.regexp_like(name, F.lit(f"^{SERVING}$")))
    rows = rows.withColumns({"tail": tail, "deferred": F.col("item") & deferred, "own": plain(F.when(F.col("pulled").isNotNull(), name).otherwise(short))})
    rows = cut(rows.select("guide", "line_no", "pulled", "cut", "item", "told", "outer", "note", "heading", "tail", "deferred", "own")).where("told")
    note = ~F.col("item")
    upto = Window.partitionBy("guide").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"section": F.last("outer", True).over(upto), "pending": F.last("note", True).over(upto), "run": F.count_if(note).over(upto)})
    run = Window.partitionBy("guide", "run")
    so_far = run.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    takes = F.col("item") & F.col("pulled").isNull() & F.col("tail").isNull() & F.coalesce(F.col("pending") != "", F.lit(False)) & F.col("deferred")
    rows = rows.withColumn("takes", takes).withColumn("opened", F.first("heading").over(so_far))
    spent = F.col("takes") & F.coalesce(F.col("opened") == F.col("pending"), F.lit(False))
    rows = rows.withColumns({"spent": F.bool_or(spent).over(run), "spent_yet": F.bool_or(spent).over(so_far)})
    kept = F.last(F.when(~F.col("spent"), F.col("heading")), True).over(upto)
    rows = rows.withColumn("category", F.when(F.col("spent") & ~F.col("spent_yet"), F.coalesce("opened", kept)).otherwise(kept))
    found = rows.where("item").select("guide", "line_no", F.when(F.col("takes"), plain(F.col("pending"))).otherwise(F.col("own")).alias("name"),
                                      F.coalesce("pulled", "tail", F.when(F.col("takes"), F.col("cut.name"))).alias("serving"), "section", "category", F.col("cut.cells").alias("cells"))
    return found.select("guide", "line_no", "name", "serving", "section", "category", *_values(layout))


def parse_positioned(lines: DataFrame, layout: Layout) -> DataFrame:
    """The same of lines with places: guide, page, line_no, top, x0, line.

    Lines of cells that start far from the page's left edge have their name in the lines nearest above
    or below, at most ``PROXIMITY`` away; a name line goes to its nearest line of cells, the higher one
    of two. Lines farther off are headings, and so are all in capitals. What was open at the end of a
    page is open on the next one.
    """
    page = ["guide", "page"]
    rows = lines.select(*page, "line_no", "top", "x0", "line").dropna().withColumn("cut", split_line(F.col("line"), len(layout.columns)))
    left_edge = F.min("x0").over(Window.partitionBy(*page)) + INDENT
    named = F.coalesce(F.col("cut.name") != "", F.lit(False))
    rows = rows.withColumn("kind", F.when(named & (F.col("x0") < left_edge), "whole").when(F.col("cut").isNotNull() & (F.col("x0") >= left_edge), "cells")
                           .when(F.col("cut").isNull() & ~F.regexp_like(F.trim("line"), F.lit(PAGE_MARK)), "words")).where("kind is not null")
    words = nearest(rows.where("kind = 'words'"), rows.where("kind = 'cells'"), page, "top", "top", "line_no", PROXIMITY)
    words = words.withColumn("outer", outer_heading(F.col("line"))).withColumn("inner", F.when(F.col("near").isNull(), inner_heading(F.col("line"))))
    names = words.where("outer is null and near is not null").groupBy(*page, F.col("near.tie").alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "line_no", "line"))), lambda x: x["line"]), " ").alias("words"))
    body = rows.where("kind <> 'words'").join(names, [*page, "line_no"], "left")
    own = F.coalesce(F.nullif(F.col("cut.name"), F.lit("")), F.lit(""))
    joined = F.when(F.col("kind") == "whole", own).otherwise(F.concat_ws(" ", F.coalesce("words", F.lit("")), F.when(F.lit(layout.serving_in_name), own)))
    body = body.select(*page, "line_no", "top", F.trim(F.regexp_replace(F.trim(joined), r"\s*[-–—]\s*$", "")).alias("name"), F.col("cut.cells").alias("cells"))
    heads = words.where("outer is not null or inner is not null").select(*page, "line_no", "top", F.struct(F.col("outer").alias("section"), F.col("inner").alias("category")).alias("head"))
    state = Window.partitionBy("guide").orderBy("page", "top", F.col("head").isNotNull(), "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = body.unionByName(heads, allowMissingColumns=True)
    told = both.withColumns({"section": F.last(F.col("head.section"), True).over(state),
                             "group": F.last(F.when(F.col("head").isNotNull(), F.struct(F.when(F.col("head.section").isNull(), F.col("head.category")).alias("text"))), True).over(state)})
    serving, short = _served(F.col("name"), layout)
    found = told.where(F.col("head").isNull() & (F.col("name") != ""))
    return found.select(*page, "line_no", short.alias("name"), serving.alias("serving"), "section", F.col("group.text").alias("category"), *_values(layout))


def checks(items: DataFrame, by: str = "guide") -> DataFrame:
    """by, n_rows, sodium (median), drift (median) and reason: why a guide can't be used, or null.

    Salt in grams instead of sodium in milligrams tells a foreign guide; macros that don't give the
    calories tell shifted columns.
    """
    expected = 4 * F.col("protein") + 4 * F.col("carbs") + 9 * F.col("fat")
    drift = F.when(F.col("kcal") >= LEAST_KCAL, F.abs(expected - F.col("kcal")) / F.col("kcal"))
    told = items.groupBy(by).agg(F.count("*").alias("n_rows"), F.median("sodium").alias("sodium"), F.median(drift).alias("drift"))
    return told.withColumn("reason", F.when(F.col("sodium").isNull(), "no sodium").when(F.col("sodium") < LEAST_SODIUM, "salt, not sodium")
                           .when(F.col("drift").isNull(), "no macros").when(F.col("drift") > MOST_DRIFT, "columns shifted"))


def titled(text: Column) -> Column:
    """Each run of letters with a capital first letter and small others."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def qualified(items: DataFrame, by: str = "guide") -> DataFrame:
    """Items with ``qualified`` names, told apart by section, group and serving in turn, and ``held``.

    Rows equal in everything count once. A pass only touches names whose key stands more than once in
    its guide. Rows that three passes can't tell apart are dropped; where they are more than a tenth of
    a guide, ``held`` marks its rows: the guide isn't understood, and nothing of it should be used.
    """
    rows = items.drop("line_no", "page").distinct().withColumn("qualified", F.col("name"))
    passes = ((F.col("section"), F.concat("qualified", F.lit(", "), titled(F.col("section")))), (F.col("category"), F.concat("qualified", F.lit(" ("), "category", F.lit(")"))),
              (F.col("serving"), F.concat("qualified", F.lit(", "), "serving")))
    several = F.count("*").over(Window.partitionBy(by, "_key")) > 1
    for told_by, longer in passes:
        rows = rows.withColumn("_key", slug(F.col("qualified"))).withColumn("_several", several)
        rows = rows.withColumn("qualified", F.when(F.col("_several") & F.coalesce(told_by != "", F.lit(False)), longer).otherwise(F.col("qualified")))
    rows = rows.withColumn("_key", slug(F.col("qualified"))).withColumn("_several", several)
    shares = rows.groupBy(by).agg((F.count_if("_several") / F.count("*") > MOST_AMBIGUOUS).alias("held"))
    return rows.where(~F.col("_several")).drop("_key", "_several").join(shares, by)


def usable(lines: DataFrame, layout: Layout, positioned: bool = False) -> DataFrame:
    """Qualified items of the guides that pass ``checks`` and aren't held."""
    items = cut(parse_positioned(lines, layout) if positioned else parse(lines, layout))  # checks and names both read it
    good = checks(items).where("reason is null").select("guide")
    return qualified(items.join(good, "guide", "left_semi")).where(~F.col("held")).drop("held")
