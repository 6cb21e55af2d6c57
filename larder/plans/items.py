"""A menu-shaped catalog derived from the ``part`` table, for the registered queries.

Each column is an expression that Spark and DuckDB read alike, so that the queries and their SQL
start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.checkpoints import spread
from larder.io import table

_DISHES = ("Cheeseburger", "Chicken Sandwich", "Iced Latte", "Garden Salad", "Chicken Nuggets", "French Fries", "Apple Pie", "Coca Cola", "Egg Muffin", "Beef Taco", "Tomato Soup", "Ranch Dressing", "Buffalo Wings")
_SECTIONS = ("Burgers", "Sandwiches", "Beverages", "Salads", "Entrees", "Fried Potatoes", "Desserts", "Beverages", "Baked Goods", "Entrees", "Soup", "Toppings & Ingredients", "Specials")
_TAILS = ("", ", Small", ", Medium", ", Large", " w/ Cheese", ", 12 oz", ", Family Box", "")


def _case(key: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


COLUMNS = {
    "chain": "p_brand",
    "item_id": "p_partkey",
    "name": f"concat(CASE WHEN p_partkey % 11 = 3 THEN '10 ' ELSE '' END, p_name, ' ', {_case('p_partkey', _DISHES)}, {_case('p_size', _TAILS)})",
    "category": f"CASE WHEN p_partkey % 29 = 5 THEN NULL ELSE {_case('p_partkey', _SECTIONS)} END",
    "serving": "CASE p_size % 4 WHEN 0 THEN concat(CAST(p_size AS VARCHAR(10)), ' oz') WHEN 1 THEN concat(CAST(p_size * 10 AS VARCHAR(10)), ' g') WHEN 2 THEN '1 Bowl' ELSE NULL END",
    "kcal": "CAST((p_partkey * 37) % 900 + p_size * (CASE WHEN p_partkey % 97 = 0 THEN 200 ELSE 1 END) AS DOUBLE)",
    "protein": "CAST((p_partkey * 7) % 60 AS DOUBLE)",
    "carbs": "CAST((p_partkey * 11) % 120 AS DOUBLE)",
    "fat": "CAST((p_partkey * 13) % 45 AS DOUBLE)",
    "sat_fat": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST((p_partkey * 5) % 30 AS DOUBLE) END",
    "trans_fat": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST((p_partkey * 3) % 4 AS DOUBLE) / 4 END",
    "cholesterol": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST((p_partkey * 301) % 5400 AS DOUBLE) END",
    "sodium": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST((p_partkey * 1009) % 31000 AS DOUBLE) END",
    "sugar": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST((p_partkey * 17) % 90 AS DOUBLE) END",
    "fiber": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST((p_partkey * 19) % 25 AS DOUBLE) END",
    "off_menu": "(p_partkey % 13 = 7)",
    "has_photo": "(p_partkey % 5 < 3)",
    "fresh": "(p_partkey % 17 <> 4)",
}
SQL_ITEMS = "items AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM part)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt over all cores: the table has few bytes a row, so few tasks read it, and the queries compute much on each row."""
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(*[F.expr(e.replace("VARCHAR(10)", "STRING")).alias(n) for n, e in COLUMNS.items()])
