"""Distances on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_METERS = 6371000.0
METERS_PER_DEGREE = 111320.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return EARTH_METERS * 2 * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)))


def within(venues: DataFrame, lat: float, lng: float, radius: float, limit: int) -> DataFrame:
    """Venues in a radius (100 to 20000 m), nearest first, at most ``limit`` (1 to 100).

    A box in latitude and longitude goes before the distance, so that scans can skip by it.
    """
    radius, limit = min(max(radius, 100.0), 20000.0), min(max(limit, 1), 100)
    dlat = radius / METERS_PER_DEGREE
    dlng = dlat / max(math.cos(math.radians(lat)), 0.01)
    boxed = venues.where(F.col("lat").between(lat - dlat, lat + dlat) & F.col("lng").between(lng - dlng, lng + dlng))
    far = haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return boxed.withColumn("distance", far).where(F.col("distance") <= radius).orderBy("distance", "venue_id").limit(limit)


def nearest_per_group(venues: DataFrame, group: str) -> DataFrame:
    """Per group: its nearest venue, the distance and the number of venues."""
    return venues.groupBy(group).agg(F.min_by("venue_id", F.struct("distance", "venue_id")).alias("venue_id"), F.min("distance").alias("distance"), F.count("*").alias("venues"))


def longest_prefix(places: DataFrame, chains: DataFrame) -> DataFrame:
    """place_id and the longest chain whose words begin the place's name.

    Places give all their word prefixes, so that it is an equality join, not a theta join.
    """
    parts = F.split("place", " ")
    prefixes = places.select("place_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))).alias("chain"))
    hits = prefixes.join(chains.select("chain").distinct(), "chain")
    order = Window.partitionBy("place_id").orderBy(F.desc(F.length("chain")))
    return hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("place_id", "chain")
