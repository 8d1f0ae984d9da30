"""Exact nearest neighbour in a reference list, by equi-joins only.

Points and references are placed in cubes of a pyramid of 3-D grids (sizes
1/4, 1/2, 1, ... km through the globe), so there is no trouble at poles or the
date line. For a base cube the smallest level is found at which one of the 27
cubes around it holds a reference. That reference is at most 2*sqrt(3) = 3.46
cube sides away, so the nearest one lies in the 27 cubes two levels up, whose
sides are 4 times longer. The pyramid is walked once per occupied cube, not per
listing, and the minimum is a plain aggregate. References at one point are one
reference, that of the lowest ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.functions.geo import EARTH_KM, haversine_km, sphere_xyz
from listinglens.functions.listing import settlement_class
from listinglens.operators.skew import broadcast_if_small, spread
from listinglens.settings import DEFAULTS, Settings

BASE_KM = 0.25
FACTOR = 2
UP = 2  # levels from a hit to cubes that must hold the nearest reference
LEVELS = 17  # 2**16 / 4 km exceed the globe's diameter, so the last level always hits
CUBE = ["cx", "cy", "cz"]


def _cubes(lat: Column, lng: Column) -> list[Column]:
    return [F.floor(v / BASE_KM).cast("long") for v in sphere_xyz(lat, lng, EARTH_KM)]


def _parent(cube: str, level: Column) -> Column:
    side = F.pow(F.lit(float(FACTOR)), level)
    return F.floor(F.col(cube) / side).cast("long")


def _around(df: DataFrame) -> DataFrame:
    """The 27 cubes around each row's cube."""
    step = F.sequence(F.lit(-1), F.lit(1))
    for name in CUBE:
        df = df.withColumn("_step", F.explode(step)).withColumn(
            name, F.col(name) + F.col("_step")
        )
    return df.drop("_step")


def _at_all_levels(df: DataFrame, *keep: str, prefix: str = "") -> DataFrame:
    """One row per pyramid level with the parent cube of that level."""
    levelled = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    return levelled.select(
        *keep, "level", *[_parent(f"{prefix}{c}", F.col("level")).alias(c) for c in CUBE]
    )


def candidates(cubes: DataFrame, dim: DataFrame) -> DataFrame:
    """References that can be nearest to some point of each base cube."""
    based = dim.select(
        "ord",
        F.col("lat").alias("r_lat"),
        F.col("lng").alias("r_lng"),
        *[c.alias(n) for c, n in zip(_cubes(F.col("lat"), F.col("lng")), CUBE)],
    )
    refs = _at_all_levels(based, "ord", "r_lat", "r_lng")
    # Distinct before the neighbours are listed: high levels have few cubes.
    reached = _around(refs.select("level", *CUBE).distinct())
    base = [f"b_{c}" for c in CUBE]
    named = cubes.select(*[F.col(c).alias(b) for c, b in zip(CUBE, base)])
    reach = (
        _at_all_levels(named, *base, prefix="b_")
        .join(reached, ["level", *CUBE], "left_semi")
        .groupBy(*base)
        .agg(F.least(F.min("level") + UP, F.lit(LEVELS - 1)).alias("level"))
    )
    wanted = _around(
        reach.select(*base, "level", *[_parent(b, F.col("level")).alias(c) for c, b in zip(CUBE, base)])
    )
    return wanted.join(refs, ["level", *CUBE]).select(
        *[F.col(b).alias(c) for c, b in zip(CUBE, base)], "ord", "r_lat", "r_lng"
    )


def nearest(points: DataFrame, dim: DataFrame) -> DataFrame:
    """(lat, lng, ord, km) of distinct located points; ties go to the lowest ord."""
    spots = (
        points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .select("lat", "lng")
        .distinct()
        .select("*", *[c.alias(n) for c, n in zip(_cubes(F.col("lat"), F.col("lng")), CUBE)])
    )
    sites = dim.groupBy("lat", "lng").agg(F.min("ord").alias("ord"))
    # Few bytes, but each row meets many: spread by work, not by size.
    pool = candidates(spread(spots.select(*CUBE).distinct()), spread(sites))
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    return (
        spots.join(pool, CUBE)
        .select("lat", "lng", F.struct(km.alias("km"), F.col("ord")).alias("_at"))
        .groupBy("lat", "lng")
        .agg(F.min("_at").alias("_at"))
        .select("lat", "lng", "_at.ord", "_at.km")
    )


def nearest_station(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds nearest_station_name / nearest_station_km; nulls without coordinates."""
    names = broadcast_if_small(stations.select("ord", F.col("name").alias("nearest_station_name")))
    found = nearest(points, stations).join(names, "ord").select(
        "lat", "lng", "nearest_station_name", F.col("km").alias("nearest_station_km")
    )
    return points.join(found, ["lat", "lng"], "left")


def place_info(
    points: DataFrame, places: DataFrame, name: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Adds population and settlement_class.

    A name that says Praha is the capital, except the two districts around it;
    everything else takes the nearest settlement.
    """
    named = F.coalesce(name, F.lit(""))
    district = named.rlike(r"(?i)praha[\s -]*(v[ýyÝ]chod|z[áaÁ]pad)")
    capital = named.rlike("(?i)praha") & ~district
    flagged = points.withColumn("_capital", capital)
    facts = broadcast_if_small(places.select("ord", "pop", "type"))
    found = (
        nearest(flagged.filter(~F.col("_capital")), places)
        .join(facts, "ord")
        .select("lat", "lng", "pop", settlement_class(F.col("pop"), F.col("type")).alias("_class"))
    )
    return (
        flagged.join(found, ["lat", "lng"], "left")
        .withColumn(
            "population",
            F.when(F.col("_capital"), F.lit(settings.capital_population)).otherwise(F.col("pop")),
        )
        .withColumn(
            "settlement_class",
            F.when(F.col("_capital"), F.lit("Big city")).otherwise(F.col("_class")),
        )
        .drop("_capital", "_class", "pop")
    )
