"""Area and size-band assignment.

Areas are cut into grid cells once. Each (cell, area) keeps only the edges a
ray from that cell can meet, so a listing is tested against a few edges. The
cell index is joined by an equi-join with the distinct places of the listings; it is
broadcast only after its edges have been counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.functions.geo import inside, ring_edges
from listinglens.functions.listing import size_band
from listinglens.operators.skew import broadcast_if_small

CELL_DEGREES = 0.05
MAX_BROADCAST_EDGES = 2_000_000


def _cell(value: Column, cell: float) -> Column:
    return F.floor(value / cell).cast("long")


def area_cells(areas: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """(cx, cy, code, name, edges): the part of each area that matters in a cell."""
    edged = areas.select("code", "name", F.flatten(ring_edges(F.col("rings"))).alias("edges"))
    xs = F.transform("edges", lambda e: e["x1"])
    ys = F.transform("edges", lambda e: e["y1"])
    columns = edged.filter(F.size("edges") > 0).select(
        "*",
        F.explode(F.sequence(_cell(F.array_min(xs), cell), _cell(F.array_max(xs), cell))).alias("cx"),
        _cell(F.array_min(ys), cell).alias("_cy0"),
        _cell(F.array_max(ys), cell).alias("_cy1"),
    )
    cells = columns.withColumn("cy", F.explode(F.sequence("_cy0", "_cy1")))
    # One cell of slack covers rounding at the cell borders.
    south, north = (F.col("cy") - 1) * cell, (F.col("cy") + 2) * cell
    west = (F.col("cx") - 1) * cell

    def reachable(e: Column) -> Column:
        return (
            (F.greatest(e["y1"], e["y2"]) >= south)
            & (F.least(e["y1"], e["y2"]) <= north)
            & (F.greatest(e["x1"], e["x2"]) >= west)
        )

    kept = cells.select("cx", "cy", "code", "name", F.filter("edges", reachable).alias("edges"))
    return kept.filter(F.size("edges") > 0)


def locate(points: DataFrame, areas: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """(lat, lng, code, name) of distinct points; of several areas the lowest code."""
    index = broadcast_if_small(
        area_cells(areas, cell), MAX_BROADCAST_EDGES, weight=F.size("edges").cast("long")
    )
    spots = (
        points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .select("lat", "lng")
        .distinct()
        .select("*", _cell(F.col("lng"), cell).alias("cx"), _cell(F.col("lat"), cell).alias("cy"))
    )
    hits = spots.join(index, ["cx", "cy"]).filter(inside(F.col("edges"), F.col("lng"), F.col("lat")))
    return hits.groupBy("lat", "lng").agg(F.min(F.struct("code", "name")).alias("_area")).select(
        "lat", "lng", "_area.code", "_area.name"
    )


def assign_area(listings: DataFrame, areas: DataFrame) -> DataFrame:
    """Polygon first, else the portal's locality text; active listings only."""
    found = locate(listings.filter("is_active"), areas).select(
        "lat", "lng", F.col("code").alias("_code"), F.col("name").alias("_name")
    )
    joined = listings.join(found, ["lat", "lng"], "left")
    active, hit = F.col("is_active"), F.col("_code").isNotNull()
    place = F.col("locality_text")
    return joined.withColumns(
        {
            "cadastral_code": F.when(
                active, F.coalesce(F.col("_code"), F.concat(F.lit("loc:"), place))
            ).otherwise(F.col("cadastral_code")),
            "cadastral_name": F.when(
                active, F.when(hit, F.col("_name")).otherwise(place)
            ).otherwise(F.col("cadastral_name")),
            "bucket_source": F.when(
                active, F.when(hit, "polygon").when(place.isNotNull(), "locality")
            ).otherwise(F.col("bucket_source")),
        }
    ).select(*listings.columns)


def assign_bucket(listings: DataFrame, areas: DataFrame) -> DataFrame:
    """Area plus size band."""
    banded = F.when(
        F.col("is_active"), size_band(F.col("usable_area_m2"), F.col("size_band"))
    ).otherwise(F.col("size_band"))
    return assign_area(listings, areas).withColumn("size_band", banded)


def bucket_summary(listings: DataFrame) -> DataFrame:
    active = listings.filter("is_active")
    return active.agg(
        F.count_if(F.col("bucket_source") == "polygon").alias("polygon"),
        F.count_if(F.col("bucket_source") == "locality").alias("locality"),
        F.count_if(F.col("usable_area_m2").isNotNull()).alias("banded"),
    )
