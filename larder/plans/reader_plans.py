"""Queries of the readers: guides, nearest lines, tiles, embedded JSON, streams and walks.

Lines and pages are written from the catalog's own rows, and the SQL tells what must be read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.checkpoints import cut
from larder.io import table
from larder.operators import nearest as n
from larder.operators import tiles, walk
from larder.plans.items import SQL_ITEMS, items
from larder.plans.registry import query
from larder.sources import embedded, guides, packs

LAYOUT = guides.Layout(("kcal", "sodium", None, "protein", "carbs", "fat"))
PLACED = guides.Layout(LAYOUT.columns, serving_in_name=True)


@query("""WITH a AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) AS at FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) AS at FROM events WHERE event_type = 'error'),
j AS (SELECT a.event_id, b.event_id AS near_id, abs(b.at - a.at) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.at - a.at), b.at, b.event_id) AS rn FROM a LEFT JOIN b ON a.user_id = b.user_id AND abs(b.at - a.at) <= 7200000000)
SELECT event_id, near_id, distance FROM j WHERE rn = 1""")
def nearest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's nearest error of the same user, two hours off at most."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    found = n.nearest(events.where("event_type = 'purchase'"), events.where("event_type = 'error'"), ["user_id"], "at", "at", "event_id", 7200e6)
    return found.select("event_id", F.col("near.tie").alias("near_id"), F.col("near.distance").alias("distance"))


def _cells(kcal: str = "kcal") -> str:
    return f"concat_ws(' ', cast(cast({kcal} AS bigint) AS string), coalesce(cast(cast(sodium AS bigint) AS string), '-'), '7', cast(cast(protein AS bigint) AS string), cast(cast(carbs AS bigint) AS string), cast(cast(fat AS bigint) AS string))"


# Every second chain's calories follow from its macros, so that guides of both kinds are there.
_KCAL = "CASE WHEN chain IN ('Brand#11', 'Brand#13', 'Brand#21', 'Brand#1', 'Brand#3', 'Brand#5') THEN 4 * protein + 4 * carbs + 9 * fat ELSE kcal END"


def guide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """guide, line_no, line: a guide a chain; headings, and items of which every third has its name on a line of its own."""
    rows = items(spark, sf_dir).withColumn("kcal", F.expr(_KCAL))
    lines = F.array(F.expr("CASE WHEN item_id % 15 = 0 THEN upper(category) END"), F.expr("CASE WHEN item_id % 5 = 0 THEN concat('Group ', chr(65 + item_id % 7)) END"),
                    F.expr("CASE WHEN item_id % 3 = 0 THEN concat('The ', name) END"),
                    F.expr(f"concat(CASE WHEN item_id % 3 <> 0 THEN name WHEN item_id % 2 = 0 THEN 'Small' ELSE 'Large' END, ' ', {_cells()})"))
    told = rows.select(F.col("chain").alias("guide"), "item_id", F.posexplode(lines).alias("k", "line")).where("line is not null")
    return told.select("guide", (F.col("item_id") * 4 + F.col("k")).alias("line_no"), "line")


_GUIDE = f"""{SQL_ITEMS}, g AS (SELECT chain AS guide, CASE WHEN item_id % 3 = 0 THEN concat('The ', name) ELSE name END AS name, CASE WHEN item_id % 3 <> 0 THEN NULL WHEN item_id % 2 = 0 THEN 'Small' ELSE 'Large' END AS serving,
  last_value(CASE WHEN item_id % 15 = 0 THEN upper(category) END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN item_id % 5 = 0 THEN concat('Group ', chr(CAST(65 + item_id % 7 AS INTEGER))) END IGNORE NULLS) OVER w AS category,
  {_KCAL} AS kcal, sodium, protein, carbs, fat, item_id FROM items WINDOW w AS (PARTITION BY chain ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_GUIDE} SELECT guide, CAST(item_id * 4 + 3 AS BIGINT) AS line_no, name, serving, section, category, kcal, sodium, protein, carbs, fat FROM g")
def guide_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guides.parse(guide_lines(spark, sf_dir), LAYOUT)


_CHECKED = f"""{_GUIDE}, m AS (SELECT guide, count(*) AS n_rows, median(sodium) AS sodium, median(CASE WHEN kcal >= 50 THEN abs(4 * protein + 4 * carbs + 9 * fat - kcal) / kcal END) AS drift FROM g GROUP BY guide),
  k AS (SELECT *, CASE WHEN sodium IS NULL THEN 'no sodium' WHEN sodium < 50 THEN 'salt, not sodium' WHEN drift IS NULL THEN 'no macros' WHEN drift > 0.10 THEN 'columns shifted' END AS reason FROM m)"""


@query(f"WITH {_CHECKED} SELECT * FROM k")
def guide_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guides.checks(guides.parse(guide_lines(spark, sf_dir), LAYOUT))


def _slug(name: str) -> str:
    return f"regexp_replace(regexp_replace(lower({name}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_TITLE = "array_to_string(list_transform(regexp_extract_all(section, '[A-Za-z]+|[^A-Za-z]+'), lambda w: concat(upper(w[1]), lower(w[2:]))), '')"


@query(f"""WITH {_CHECKED}, a AS (SELECT DISTINCT * EXCLUDE (item_id) FROM g SEMI JOIN (SELECT guide FROM k WHERE reason IS NULL) USING (guide)),
p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY guide, {_slug('name')}) > 1 AND section <> '' THEN concat(name, ', ', {_TITLE}) ELSE name END AS q1 FROM a),
q AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY guide, {_slug('q1')}) > 1 AND category <> '' THEN concat(q1, ' (', category, ')') ELSE q1 END AS q2 FROM p),
r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY guide, {_slug('q2')}) > 1 AND serving <> '' THEN concat(q2, ', ', serving) ELSE q2 END AS qualified FROM q),
s AS (SELECT *, count(*) OVER (PARTITION BY guide, {_slug('qualified')}) > 1 AS several FROM r), h AS (SELECT guide, count(*) FILTER (several) * 1.0 / count(*) > 0.10 AS held FROM s GROUP BY guide)
SELECT guide, name, qualified, serving, section, category, kcal, sodium, protein, carbs, fat, held FROM s JOIN h USING (guide) WHERE NOT several""")
def qualified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the guides that pass, with names told apart; guides with too many alike are marked."""
    found = cut(guides.parse(guide_lines(spark, sf_dir), LAYOUT))
    return guides.qualified(found.join(guides.checks(found).where("reason is null"), "guide", "left_semi"))


@query(f"""WITH {SQL_ITEMS}, s AS (SELECT chain AS guide, CAST(item_id // 20 AS BIGINT) AS page, CAST(item_id * 5 + 4 AS BIGINT) AS line_no, concat('The ', name) AS name, '1 Bowl' AS serving,
  last_value(CASE WHEN item_id % 20 = 0 THEN upper(category) END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN item_id % 20 = 0 THEN concat('Group ', chr(CAST(65 + item_id % 7 AS INTEGER))) END IGNORE NULLS) OVER w AS category,
  kcal, sodium, protein, carbs, fat FROM items WINDOW w AS (PARTITION BY chain ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT * FROM s""")
def placed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides whose names stand on two lines above and below their cells."""
    line = lambda k, top, x0, text: F.struct(F.lit(k).alias("k"), F.lit(float(top)).alias("off"), F.lit(float(x0)).alias("x0"), F.expr(text).alias("line"))
    lines = F.array(line(0, -40, 20, "CASE WHEN item_id % 20 = 0 THEN upper(category) END"), line(1, -20, 22, "CASE WHEN item_id % 20 = 0 THEN concat('Group ', chr(65 + item_id % 7)) END"),
                    line(2, -5, 20, "concat('The ', split_part(name, ' ', 1))"), line(3, 8, 20, "substring(name, instr(name, ' ') + 1)"), line(4, 0, 200, f"concat('1 Bowl ', {_cells()})"))
    told = items(spark, sf_dir).select(F.col("chain").alias("guide"), "item_id", F.inline(lines)).where("line is not null")
    placed = told.select("guide", F.floor(F.col("item_id") / 20).alias("page"), (F.col("item_id") * 5 + F.col("k")).alias("line_no"), (100 + (F.col("item_id") % 20) * 40 + F.col("off")).alias("top"), "x0", "line")
    return guides.parse_positioned(placed, PLACED)


@query()
def tile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of two thirds of the catalog, named as files are: words run together, cut or with words of the shot."""
    rows = items(spark, sf_dir).select("chain", F.col("item_id").cast("string").alias("ext_key"), "item_id", "name")
    told = F.when(F.col("item_id") % 3 == 0, F.regexp_replace("name", "^([a-z]+) ([a-z]+) ", "$1$2 ")).otherwise(F.concat(F.lit("Hero "), F.regexp_replace("name", "^[a-z]+ ", "")))
    shots = rows.where("item_id % 9 < 6").select("chain", F.concat(F.lit("t"), "ext_key").alias("tile_key"), F.col("item_id").alias("place"), told.alias("name"))
    return tiles.match_tiles(rows.drop("item_id"), shots)


@query(f"""WITH {SQL_ITEMS}, p AS (SELECT *, item_id % 7 <> 0 AND (kcal <= 5000 OR coalesce(sodium <= 30000, false)) AS told FROM items)
SELECT item_id AS page_id, name, CASE WHEN told AND kcal <= 5000 THEN kcal END AS kcal, CASE WHEN told THEN fat END AS fat, CASE WHEN told AND sodium <= 30000 THEN sodium END AS sodium,
CASE WHEN item_id % 2 = 0 THEN protein END AS protein, CASE WHEN item_id % 2 = 0 THEN 'json-ld,' ELSE '' END || CASE WHEN told THEN 'embedded-json,' ELSE '' END || 'open-graph' AS shapes FROM p""")
def embedded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of pages with state that also holds numbers of other things, structured data and Open Graph."""
    html = F.expr("""concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"calories":', cast(item_id AS string), '},"items":[{"nutrition":{',
        CASE WHEN item_id % 7 <> 0 THEN concat('"Calories":"', cast(cast(kcal AS bigint) AS string), ' kcal","total_fat":', cast(fat AS string), CASE WHEN sodium IS NULL THEN '' ELSE concat(',"sodium":"', cast(cast(sodium AS bigint) AS string), ' mg"') END)
             ELSE '"protein":3' END, '}},{"energy":', cast(item_id AS string), '}]}</script>',
        CASE WHEN item_id % 2 = 0 THEN concat('<script type="application/ld+json">[{"@type":["Thing","MenuItem"],"nutrition":{"proteinContent":"', cast(cast(protein AS bigint) AS string), ' g"}}]</script>') ELSE '' END,
        '<meta property="og:title" content="', name, ' | Site">')""")
    return embedded.page_ladder(items(spark, sf_dir).select(F.col("item_id").alias("page_id"), html.alias("html"))).select("page_id", "name", "kcal", "fat", "sodium", "protein", "shapes")


@query(f"WITH {SQL_ITEMS} SELECT item_id, CASE WHEN item_id % 6 <> 0 AND kcal > 0 THEN kcal END AS kcal, CASE WHEN item_id % 6 <> 0 AND kcal > 0 THEN fat END AS fat FROM items")
def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by name out of pushed chunks that hold another product's label first."""
    html = F.expr(r"""concat('<script>self.__next_f.push([1,"1:[{\\"name\\":\\"Other } one\\",\\"nutrition\\":{\\"calories\\":\\"9999\\"}},"])</script><script>self.__next_f.push([1,"{\\"name\\":\\"', upper(name),
        '\\","])</script><script>self.__next_f.push([1,"\\"nutrition\\":{\\"@type\\":\\"NutritionInformation\\",\\"calories\\":\\"', cast(cast(kcal AS bigint) AS string), ' calories\\",\\"fatContent\\":\\"', cast(cast(fat AS bigint) AS string), 'g\\"}}]\\n2:{\\"cut"])</script>')""")
    asked = F.when(F.col("item_id") % 6 == 0, "Missing").otherwise(F.col("name"))
    return items(spark, sf_dir).select("item_id", embedded.stream_label(html, asked).alias("label")).select("item_id", "label.kcal", "label.fat")


@query("""WITH RECURSIVE n AS (SELECT p_brand AS site, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS page FROM part), c AS (SELECT site, max(page) AS last FROM n GROUP BY site),
e AS (SELECT site, page, unnest([page * 2, page * 3, page, 1, page * 2]) AS target FROM n), w AS (SELECT site, page, 0 AS depth FROM n WHERE page = 1
  UNION SELECT w.site, e.target, w.depth + 1 FROM w JOIN e ON w.site = e.site AND w.page = e.page JOIN c ON c.site = w.site WHERE (w.page % 4 <> 0 OR w.depth = 0) AND w.depth < 4 AND e.target <= c.last)
SELECT site, CAST(page AS INTEGER) AS page, CAST(min(depth) AS INTEGER) AS depth, page % 4 = 0 AS is_item FROM w WHERE page <> 1 GROUP BY site, page""")
def walked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk of four steps over each brand's parts, numbered in order; every fourth is an item."""
    by_key = Window.partitionBy("site").orderBy("p_partkey")
    pages = table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), "p_partkey").withColumn("page", F.row_number().over(by_key))
    pages = pages.withColumn("last", F.max("page").over(Window.partitionBy("site")))
    page = F.col("page")
    links = pages.select("site", "page", "last", F.explode(F.array(page * 2, page * 3, page, F.lit(1), page * 2)).alias("target")).where("target <= last")
    return walk.walk(pages.where("page = 1"), links, pages.where("page % 4 = 0"), ["site"], 4)


@query(f"""WITH {SQL_ITEMS}, c AS (SELECT chain, count(*) AS n, ascii(right(chain, 1)) % 5 AS kind FROM items GROUP BY chain), b AS (SELECT chain, count(*) AS n FROM items WHERE item_id % 2 = 0 GROUP BY chain)
SELECT chain, CASE WHEN kind < 3 OR b.n IS NULL THEN 'seed' ELSE 'download' END AS origin, CASE WHEN kind < 3 OR b.n IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN kind < 3 OR b.n IS NULL THEN c.n ELSE b.n END AS n_items,
CASE WHEN kind < 2 AND b.n IS NOT NULL THEN 'download' ELSE '' END AS damaged FROM c LEFT JOIN b USING (chain)""")
def best_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chain's seed and download the one to use; some downloads are cut, changed, or no newer."""
    rows = items(spark, sf_dir).select("chain", F.col("item_id").cast("string").alias("key"), "item_id", "name", "kcal", "protein", "carbs", "fat")
    kind = F.ascii(F.right("chain", F.lit(1))) % 5
    seed = packs.build_packs(rows.drop("item_id"), 1).select("chain", F.lit("seed").alias("origin"), "sha256", "deflated")
    half = rows.where("item_id % 2 = 0").drop("item_id")
    newer, same = packs.build_packs(half, 2), packs.build_packs(half, 1)
    cut = F.when(kind == 0, F.substring("deflated", 1, 40)).otherwise(F.col("deflated"))
    digest = F.when(kind == 1, F.sha2(F.lit("other"), 256)).when(kind == 0, F.sha2(cut, 256)).otherwise(F.col("sha256"))
    offered = newer.where(kind != 2).unionByName(same.where(kind == 2)).select("chain", F.lit("download").alias("origin"), digest.alias("sha256"), cut.alias("deflated"))
    return packs.best_of(seed.unionByName(offered)).select("chain", "origin", "version", F.size("items").cast("bigint").alias("n_items"), "damaged")
