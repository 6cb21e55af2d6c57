"""Greedy one-to-one assignment by rounds on Spark.

The greedy rule takes pairs by ratio, then equal keys, then the greater live key, then the greater
stored key; each side is used once. Pairs depend on the forms of names, so rounds work on classes (all
items of one form) and their distinct pairs of forms, and items are never multiplied into pairs:

* A pair of classes is *on top* for a class if no living pair of that class has a higher ratio.
* Where one class and its partners have all their top pairs with each other alone (a star), the greedy
  rule can be carried out for all their items at once: equal keys first, then both sides counted down
  from the greatest key and joined by number. Equal forms always are such a star.
* Any other pair of classes gives its best pair of items, where that is the best of both classes.

The best pair of all that live is accepted in every round, so rounds end; each accepts only pairs that
the greedy rule would.

Both sides of the joins grow with the items, and there are many in each round, so they are merge joins:
adaptive execution would send every side of a few MB through the driver, round after round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.checkpoints import cut


def numbered(rows: DataFrame, group: list[str], key: str, name: str) -> DataFrame:
    """``name`` counts each group's rows from the greatest key on, without a window over a group.

    Rows are sorted over all tasks by group and key, so a large group is spread; a row's number is its
    place in the sorted rows less the place of its group's first.
    """
    sorted_rows = cut(rows.orderBy(*group, F.desc(key)))
    place = F.monotonically_increasing_id()
    placed = sorted_rows.select("*", F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_row"))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    offsets = [0]
    for part in range(max(sizes, default=0)):
        offsets.append(offsets[-1] + sizes.get(part, 0))
    at = placed.withColumn("_at", F.element_at(F.array(*map(F.lit, offsets)), F.col("_part") + 1) + F.col("_row")).drop("_part", "_row")
    first = at.groupBy(*group).agg(F.min("_at").alias("_first"))
    return at.join(first.hint("merge"), group).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


def zipped(own: DataFrame, other: DataFrame, group: list[str]) -> DataFrame:
    """group, live_key, stored_key: equal keys of a group first, then both sides from their greatest keys on."""
    alike = own.join(other.withColumnRenamed("stored_key", "live_key").hint("merge"), [*group, "live_key"], "left_semi").select(*group, "live_key")
    alike = alike.withColumn("stored_key", F.col("live_key"))
    left = numbered(own.join(alike.hint("merge"), [*group, "live_key"], "left_anti"), group, "live_key", "_n")
    right = numbered(other.join(alike.hint("merge"), [*group, "stored_key"], "left_anti"), group, "stored_key", "_n")
    return alike.unionByName(left.join(right.hint("merge"), [*group, "_n"]).select(*group, "live_key", "stored_key"))


def _accepted(own: DataFrame, other: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, live_key, stored_key, ratio accepted in one round."""
    of_live, of_stored = [*keys, "live_form"], [*keys, "stored_form"]
    alike = own.join(other.withColumnRenamed("stored_key", "live_key").hint("merge"), [*keys, "live_key"]).groupBy(*keys, "live_form", "stored_form").agg(F.max("live_key").alias("same_key"))
    living = (pairs.join(own.groupBy(*of_live).agg(F.max("live_key").alias("live_top")).hint("merge"), of_live)
              .join(other.groupBy(*of_stored).agg(F.max("stored_key").alias("stored_top")).hint("merge"), of_stored).join(alike.hint("merge"), [*keys, "live_form", "stored_form"], "left"))
    best = F.struct("ratio", F.col("same_key").isNotNull().alias("alike"), F.coalesce("same_key", "live_top").alias("live_key"), F.coalesce("same_key", "stored_top").alias("stored_key"))
    by_live, by_stored = Window.partitionBy(*of_live), Window.partitionBy(*of_stored)
    top = living.withColumn("best", best).withColumns({
        "l_top": F.col("ratio") == F.max("ratio").over(by_live), "s_top": F.col("ratio") == F.max("ratio").over(by_stored),
        "l_best": F.col("best") == F.max("best").over(by_live), "s_best": F.col("best") == F.max("best").over(by_stored)})
    both = F.col("l_top") & F.col("s_top")
    counted = top.withColumns({"l_n": F.count_if("l_top").over(by_live), "s_n": F.count_if("s_top").over(by_stored),
                               "l_both": F.count_if(both).over(by_live), "s_both": F.count_if(both).over(by_stored)})
    ringed = counted.where(both).withColumns({"l_most": F.max("s_n").over(by_live), "s_most": F.max("l_n").over(by_stored)})
    star = cut(ringed.withColumn("center", F.when((F.col("l_n") == F.col("l_both")) & (F.col("l_most") == 1), F.concat(F.lit("l"), F.col("live_form")))
                                 .when((F.col("s_n") == F.col("s_both")) & (F.col("s_most") == 1), F.concat(F.lit("s"), F.col("stored_form")))))
    stars = star.where("center is not null")
    group = [*keys, "center"]
    left = own.join(stars.select(*of_live, "center").distinct().hint("merge"), of_live).select(*group, "live_key")
    right = other.join(stars.select(*of_stored, "center").distinct().hint("merge"), of_stored).select(*group, "stored_key")
    levels = stars.groupBy(*group).agg(F.first("ratio").alias("ratio"))  # one ratio a star
    many = zipped(left, right, group).join(levels.hint("merge"), group).select(*keys, "live_key", "stored_key", "ratio")
    one = star.where(F.col("center").isNull() & F.col("l_best") & F.col("s_best")).select(*keys, "best.live_key", "best.stored_key", "ratio")
    return many.unionByName(one)


def greedy(own: DataFrame, other: DataFrame, pairs, keys: list[str]) -> DataFrame:
    """keys, live_key, stored_key and ratio of the greedy assignment.

    ``own`` has keys, live_key, live_form; ``other`` keys, stored_key, stored_form; a key stands once
    under equal ``keys``. ``pairs(own, other)`` gives the distinct pairs of forms with their ratio; it is
    asked after equal forms are served, for what is left.
    """
    own, other = cut(own), cut(other)
    form = [*keys, "form"]
    exact = zipped(own.withColumnRenamed("live_form", "form"), other.withColumnRenamed("stored_form", "form"), form)
    done = cut(exact.select(*keys, "live_key", "stored_key", F.lit(1.0).alias("ratio")))
    out, edges = done, None
    while True:
        own = cut(own.join(done.hint("merge"), [*keys, "live_key"], "left_anti"))
        other = cut(other.join(done.hint("merge"), [*keys, "stored_key"], "left_anti"))
        if edges is None:
            edges = cut(pairs(own, other))
        done = cut(_accepted(own, other, edges, keys))
        if done.isEmpty():
            return out
        out = out.unionByName(done)
