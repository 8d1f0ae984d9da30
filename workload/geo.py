"""Distances and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.functions.geo import geodesic_m, haversine_km
from listinglens.functions.listing import distance_to_centre_km, settlement_class
from listinglens.operators.nearest import nearest_station, place_info
from listinglens.session import scratch_path
from listinglens.sources.tables import load_places, load_stations
from workload import fixtures as X
from workload.base import block, query


def haversine_sql(lat1, lng1, lat2, lng2) -> str:
    h = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"(6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def lambert_sql(lat1, lng1, lat2, lng2) -> str:
    """Lambert's formula on WGS84, written with the reduced latitudes inline."""
    b = lambda lat: f"atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians({lat})))"
    return f"""(SELECT CASE WHEN s = 0 THEN 0.0 ELSE 6378137.0 * (s - (1 / 298.257223563::DOUBLE) / 2 * (
        (s - sin(s)) * pow(sin(p) * cos(q) / cos(s / 2), 2)
        + (s + sin(s)) * pow(cos(p) * sin(q) / sin(s / 2), 2))) END
      FROM (SELECT 2 * asin(sqrt(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2)
               * pow(sin(radians({lng2} - {lng1}) / 2), 2))) AS s,
              (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q
            FROM (SELECT {b(lat1)} AS b1, {b(lat2)} AS b2)))"""


def midlat_sql(lat1, lng1, lat2, lng2) -> str:
    """Short distances on WGS84: radii of curvature at the mean latitude."""
    e2 = "CAST(0.0066943799901413165 AS DOUBLE)"
    return f"""(SELECT 6378137.0 * sqrt(pow((1 - {e2}) / pow(1 - {e2} * pow(sin(mid), 2), 1.5) * dphi, 2)
        + pow(cos(mid) / sqrt(1 - {e2} * pow(sin(mid), 2)) * dlam, 2))
      FROM (SELECT radians(({lat1} + {lat2}) / 2) AS mid, radians({lat2} - {lat1}) AS dphi,
                   radians({lng2} - {lng1}) AS dlam))"""


block(
    "spot",
    "SELECT DISTINCT lat, lng FROM lst WHERE lat IS NOT NULL AND lng IS NOT NULL",
)


@query(
    "haversine_km",
    f"SELECT id, round({haversine_sql('lat', 'lng', 49.9, 14.9)}, 6) AS km FROM lst",
)
def _(spark, sf):
    df = X.listings(spark, sf)
    return df.select("id", F.round(haversine_km(F.col("lat"), F.col("lng"), 49.9, 14.9), 6).alias("km"))


@query(
    "distance_to_centre",
    f"SELECT id, round({haversine_sql('lat', 'lng', 50.0875, 14.4213)}, 6) AS prague_km FROM lst",
)
def _(spark, sf):
    return X.listings(spark, sf).select(
        "id", F.round(distance_to_centre_km(F.col("lat"), F.col("lng")), 6).alias("prague_km")
    )


@query(
    "geodesic_to_anchor",
    f"""SELECT id, round({lambert_sql('lat', 'lng', '49.0', '17.0')}, 3) AS metres
        FROM lst""",
)
def _(spark, sf):
    df = X.listings(spark, sf)
    return df.select("id", F.round(geodesic_m(F.col("lat"), F.col("lng"), 49.0, 17.0), 3).alias("metres"))


@query(
    "geodesic_short",
    f"""SELECT a.id, round({midlat_sql('a.lat', 'a.lng', 'a.lat + 0.001', 'a.lng + 0.002')}, 3) AS metres
        FROM lst a""",
)
def _(spark, sf):
    df = X.listings(spark, sf)
    lat, lng = F.col("lat"), F.col("lng")
    return df.select("id", F.round(geodesic_m(lat, lng, lat + 0.001, lng + 0.002), 3).alias("metres"))


block(
    "near_station",
    f"""SELECT lat, lng, n.name AS nearest_station_name, n.km AS nearest_station_km FROM (
      SELECT spot.lat, spot.lng, min({{'km': {haversine_sql('spot.lat', 'spot.lng', 's.lat', 's.lng')},
        'ord': s.ord, 'name': s.name}}) AS n
      FROM spot, station s GROUP BY spot.lat, spot.lng)""",
)
block(
    "near_place",
    f"""SELECT lat, lng, n.pop AS pop, n.type AS type FROM (
      SELECT spot.lat, spot.lng, min({{'km': {haversine_sql('spot.lat', 'spot.lng', 's.lat', 's.lng')},
        'ord': s.ord, 'pop': s.pop, 'type': s.type}}) AS n
      FROM spot, place s GROUP BY spot.lat, spot.lng)""",
)
CLASS_SQL = """CASE WHEN pop < 500 THEN 'Hamlet' WHEN pop < 2000 THEN 'Village' WHEN pop < 25000 THEN 'Town'
      WHEN pop < 100000 THEN 'City' WHEN pop IS NOT NULL THEN 'Big city'
      WHEN type = 'city' THEN 'Big city' WHEN type = 'town' THEN 'Town'
      WHEN type = 'hamlet' THEN 'Hamlet' ELSE 'Village' END"""


@query(
    "nearest_station",
    """SELECT id, nearest_station_name, round(nearest_station_km, 6) AS nearest_station_km
       FROM lst LEFT JOIN near_station USING (lat, lng)""",
)
def _(spark, sf):
    found = nearest_station(X.listings(spark, sf).select("id", "lat", "lng"), X.stations(spark, sf))
    return found.select(
        "id", "nearest_station_name", F.round("nearest_station_km", 6).alias("nearest_station_km")
    )


NAMED_SQL = """CASE WHEN g % 23 = 0 THEN 'Praha 5 – Stodůlky' WHEN g % 29 = 0 THEN 'Praha-východ'
      ELSE locality_text END"""


@query(
    "place_info",
    f"""SELECT id,
         CASE WHEN named LIKE 'Praha %' THEN 1357000 ELSE pop END AS population,
         CASE WHEN named LIKE 'Praha %' THEN 'Big city' WHEN lat IS NULL THEN NULL ELSE {CLASS_SQL} END
           AS settlement_class
       FROM (SELECT id, lat, lng, {NAMED_SQL} AS named FROM lst) LEFT JOIN near_place USING (lat, lng)""",
)
def _(spark, sf):
    named = X.listings(spark, sf).select(
        "id",
        "lat",
        "lng",
        F.expr(
            "case when (id div 3) % 23 = 0 then 'Praha 5 – Stodůlky' "
            "when (id div 3) % 29 = 0 then 'Praha-východ' else locality_text end"
        ).alias("named"),
    )
    return place_info(named, X.places(spark, sf), F.col("named")).select(
        "id", "population", "settlement_class"
    )


@query("settlement_class", f"SELECT ord, {CLASS_SQL} AS settlement_class FROM place")
def _(spark, sf):
    return X.places(spark, sf).select(
        "ord", settlement_class(F.col("pop"), F.col("type")).alias("settlement_class")
    )


def static_lists(df, name, fields):
    """``df`` (ord, ...) written as JSON arrays of 50 entries, one per file; the path."""
    path = scratch_path(df.sparkSession, name)
    chunks = (
        df.withColumn("chunk", F.expr("lpad(cast(ord div 50 as string), 8, '0')"))
        .groupBy("chunk")
        .agg(F.sort_array(F.collect_list(F.struct("ord", *fields))).alias("entries"))
    )
    plain = F.transform("entries", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    chunks.select("chunk", F.to_json(plain).alias("value")).write.partitionBy("chunk").text(path)
    return path


@query(
    "load_stations",
    "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, name, lat, lng FROM station",
)
def _(spark, sf):
    """Stations written as JSON and read back as the static list."""
    return load_stations(spark, static_lists(X.stations(spark, sf), "stations", ["name", "lat", "lng"]))


@query(
    "load_places",
    "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, name, lat, lng, pop, type FROM place",
)
def _(spark, sf):
    fields = ["name", "lat", "lng", "pop", "type"]
    return load_places(spark, static_lists(X.places(spark, sf), "places", fields))
