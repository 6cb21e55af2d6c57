"""Places of a map search as venues of chains.

Places have place_id, place (a name), lat, lng and address. A place belongs to the chain whose words
begin its name, the longest of them; places of no chain are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import geo


def place_venues(places: DataFrame, chains: DataFrame) -> DataFrame:
    """``places`` with chain and venue_key, which is made of the coordinates; a null address is an empty one."""
    named = geo.longest_prefix(places.dropDuplicates(["place_id"]), chains)
    key = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.concat(F.lit("map:"), F.col("lat").cast("string"), F.lit(","), F.col("lng").cast("string")))
    return places.join(named, "place_id").withColumn("venue_key", key).withColumn("address", F.coalesce("address", F.lit("")))


def verified_venues(answers: DataFrame, chains: DataFrame, asked: str) -> DataFrame:
    """First venue rows of answers whose chain is the one asked for.

    ``answers`` are places with the asked chain. Of the rows of one chain and venue_key that of smallest
    place_id stays; rows without coordinates can't be told apart and are left out.
    """
    own = place_venues(answers, chains).where((F.col("chain") == F.col(asked)) & F.col("venue_key").isNotNull())
    row = F.struct("place_id", *[c for c in own.columns if c not in ("place_id", "chain", "venue_key")])
    first = own.groupBy("chain", "venue_key").agg(F.min_by(row, "place_id").alias("first"))
    return first.select("chain", "venue_key", "first.*")


def by_address(venues: DataFrame) -> DataFrame:
    """``venues`` with place_no, their order within the chain where no one's position is known: address, then key."""
    return venues.withColumn("place_no", F.row_number().over(Window.partitionBy("chain").orderBy("address", "venue_key")))
