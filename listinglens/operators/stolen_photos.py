"""Galleries that recur on a distant listing of another cluster.

Only the existence of a far match matters, so no pair of listings is built.
Per photo value the places that show it (or a similar one) are summarised by
the bounding box and the outermost place in each direction. Most photos are
settled by one row of that summary: a far outermost place of another cluster
proves a match, a small box excludes one. What is left open is compared place
by place. Values that only one cluster shows, with all values similar to them,
need no summary: which clusters show a value is two numbers.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.functions.geo import geodesic_m
from listinglens.operators.hamming import lookalike_groups, similar_values
from listinglens.session import cut_lineage
from listinglens.settings import DEFAULTS, Settings

NO_CLUSTER = -(2**63)
SIDES = ["south", "north", "west", "east"]


def _score(side: str, place: str = "") -> Column:
    lat, lng = F.col(f"{place}lat"), F.col(f"{place}lng")
    return {"south": -lat, "north": lat, "west": -lng, "east": lng}[side]


def photo_places(listings: DataFrame, hashes: DataFrame) -> DataFrame:
    """Hash rows with the point, cluster and state of their listing (located ones only)."""
    located = listings.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        F.col("id").alias("listing_id"),
        "lat",
        "lng",
        "is_active",
        F.coalesce("cluster_id", F.lit(NO_CLUSTER)).alias("cluster"),
    )
    return hashes.select("listing_id", "position", "dhash").join(located, "listing_id")


def _outermost(spots: DataFrame) -> DataFrame:
    """Per photo value its outermost places; (lo, hi) are two of a place's clusters."""
    place = F.struct("lat", "lng", "lo", "hi")
    return spots.groupBy("dhash").agg(
        *[F.max_by(place, _score(side)).alias(side) for side in SIDES]
    )


def _merged(reaches: DataFrame, *keys: str) -> DataFrame:
    """Outermost places over rows that carry outermost places themselves."""
    return reaches.groupBy(*keys).agg(
        *[F.max_by(side, _score(side, f"{side}.")).alias(side) for side in SIDES]
    )


def _outermost_of(spots: DataFrame, *values: DataFrame) -> DataFrame:
    """Outermost places of the ``values`` (dhash) alone."""
    wanted = values[0]
    for more in values[1:]:
        wanted = wanted.unionByName(more)
    return cut_lineage(_outermost(spots.join(wanted.distinct(), "dhash", "left_semi")))


def _crowd_reach(spots: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """Outermost places over a value and the near-copies it shares a group with.

    Only of values that several clusters show, alone or together with their groups.
    """
    groups = cut_lineage(lookalike_groups(held, settings, having=F.min("lo") != F.max("hi")))
    outermost = _outermost_of(spots, groups.select("dhash"), held.filter("lo <> hi").select("dhash"))
    reach = _merged(groups.join(outermost, "dhash"), "part", "code")
    around = groups.join(reach, ["part", "code"]).select("dhash", *SIDES)
    return _merged(outermost.select("dhash", *SIDES).unionByName(around), "dhash")


def _across_clusters(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) but for those that one and the same cluster shows alone."""
    a, b = (held.select(F.col("dhash").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("lo", "hi")]) for x in "ab")
    one = (F.col("a_lo") == F.col("a_hi")) & (F.col("b_lo") == F.col("b_hi")) & (F.col("a_lo") == F.col("b_lo"))
    return pairs.join(b, "b").join(a, "a").filter(~one).select("a", "b")


def _reach(pairs: DataFrame, spots: DataFrame, held: DataFrame) -> DataFrame:
    """Outermost places over a value and all values paired with it, of values that several clusters show so."""
    ends = [pairs.select(F.col(c).alias("dhash")) for c in "ab"]
    outermost = _outermost_of(spots, *ends, held.filter("lo <> hi").select("dhash"))
    others = pairs.join(outermost.withColumnRenamed("dhash", "b"), "b").select(
        F.col("a").alias("dhash"), *SIDES
    )
    return _merged(outermost.select("dhash", *SIDES).unionByName(others), "dhash")


def _is_far(place: Column, settings: Settings) -> Column:
    metres = geodesic_m(F.col("lat"), F.col("lng"), place["lat"], place["lng"])
    other = (place["lo"] != F.col("cluster")) | (place["hi"] != F.col("cluster"))
    return other & (metres > settings.far_metres)


def _verdict(settings: Settings) -> Column:
    """True or false when the summary settles it, else null."""
    # Spelled out, so that it is compiled; a function over an array is not.
    proven = reduce(or_, [_is_far(F.col(side), settings) for side in SIDES])
    south, north = F.col("south.lat"), F.col("north.lat")
    west, east = F.col("west.lng"), F.col("east.lng")
    corners = F.array(
        *[F.struct(y.alias("lat"), x.alias("lng")) for y in (south, north) for x in (west, east)]
    )
    within = settings.far_metres * 0.99
    excluded = (north - south < 1) & (east - west < 1) & ~F.exists(
        corners, lambda c: geodesic_m(F.col("lat"), F.col("lng"), c["lat"], c["lng"]) >= within
    )
    # A degree is shorter than this everywhere: mostly no distance has to be computed.
    lat, lng = F.col("lat"), F.col("lng")
    bound = 111_700 * F.greatest(north - lat, lat - south) + 111_400 * F.greatest(east - lng, lng - west)
    return (
        F.when(F.col("south").isNull(), None)
        .when(bound < within, False)
        .when(proven, True)
        .when(excluded, False)
    )


def _judged(rows: DataFrame, reach: DataFrame, settings: Settings, how: str = "inner") -> DataFrame:
    """Photo rows with ``far``: settled true or false, or null when left open."""
    return rows.join(reach, "dhash", how).select(
        "listing_id", "position", "dhash", "lat", "lng", "cluster", _verdict(settings).alias("far")
    )


def far_shared_photos(
    listings: DataFrame, hashes: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """(listing_id, shared): positions of an active listing seen on a far listing."""
    shown = photo_places(listings, hashes)
    spots = cut_lineage(
        shown.groupBy("dhash", "lat", "lng").agg(
            F.min("cluster").alias("lo"), F.max("cluster").alias("hi")
        )
    )
    held = cut_lineage(spots.groupBy("dhash").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))

    # First pass: near-copies in groups. A far place found there is proof enough,
    # so a crowd of near-copies spread over the map never reaches the pair search.
    actives = shown.filter("is_active")
    first = cut_lineage(_judged(actives, _crowd_reach(spots, held, settings), settings, "left"))
    left = first.filter(~F.coalesce("far", F.lit(False))).drop("far")
    similar = similar_values(left.select("dhash"), held, settings)
    pairs = cut_lineage(_across_clusters(similar, held))

    # What one cluster shows alone is not far; of the rest, proven and open rows go on.
    judged = _judged(left, _reach(pairs, spots, held), settings)
    judged = cut_lineage(judged.filter(F.coalesce("far", F.lit(True))))
    proven = first.filter("far").unionByName(judged.filter("far")).select("listing_id", "position")

    open_rows = judged.filter(F.col("far").isNull())
    open_spots = open_rows.select("dhash", "lat", "lng", "cluster").distinct()
    views = pairs.select(F.col("a").alias("dhash"), "b").unionByName(
        open_spots.select("dhash", F.col("dhash").alias("b")).distinct()
    )
    seen = spots.select(F.col("dhash").alias("b"), F.struct("lat", "lng", "lo", "hi").alias("_p"))
    settled = (
        open_spots.join(views, "dhash")
        .join(seen, "b")
        .filter(_is_far(F.col("_p"), settings))
        .select("dhash", "lat", "lng", "cluster")
        .distinct()
    )
    found = open_rows.join(settled, ["dhash", "lat", "lng", "cluster"], "left_semi").select(
        "listing_id", "position"
    )
    return (
        proven.unionByName(found)
        .groupBy("listing_id")
        .agg(F.countDistinct("position").alias("shared"))
    )


def stolen_photo_listings(
    listings: DataFrame, hashes: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Listings with three or more photos that recur far away."""
    return far_shared_photos(listings, hashes, settings).filter(
        F.col("shared") >= settings.stolen_min_shared
    )
