"""Area boundaries from GeoJSON FeatureCollections (WGS84)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglens.functions import variant as V
from listinglens.schemas import AREAS, RINGS, conform

# Property names tried in this order.
NAME_KEYS = ["NAZEV", "nazev", "name", "NAZ_KU", "NAZ_OBEC", "TEXT", "NÁZEV"]
CODE_KEYS = ["KOD", "kod", "code", "KATUZE_KOD", "KOD_KU", "KOD_OBEC", "ICOB", "id"]


def _pick(properties: Column, keys: list[str]) -> Column:
    values = [V.as_text(V.field(properties, key)) for key in keys]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def _rings(geometry: Column) -> Column:
    """Polygon or MultiPolygon coordinates as polygon -> ring -> point."""
    shape = V.text(V.field(geometry, "type"))
    coordinates = V.field(geometry, "coordinates")
    many = F.try_variant_get(coordinates, "$", "array<array<array<array<double>>>>")
    single = F.array(F.try_variant_get(coordinates, "$", "array<array<array<double>>>"))
    point = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))

    def points(polygons: Column) -> Column:
        return F.transform(
            polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point))
        ).cast(RINGS)

    return F.when(shape == "MultiPolygon", points(many)).when(shape == "Polygon", points(single))


def areas_from_collections(collections: DataFrame) -> DataFrame:
    """Rows (payload, kind, region, load_no) of GeoJSON text -> areas.

    Features without geometry are skipped. A code met again replaces name and
    shape but keeps kind and region of its first load.
    """
    features = V.items(V.field(V.parse(F.col("payload")), "features"))
    rows = collections.select(
        "kind", "region", "load_no", F.posexplode(features).alias("index", "f")
    )
    f = F.col("f")
    properties, geometry = V.field(f, "properties"), V.field(f, "geometry")
    named = rows.filter(geometry.isNotNull()).withColumn(
        "name",
        F.coalesce(
            _pick(properties, NAME_KEYS),
            F.concat_ws("-", "region", F.col("index").cast("string")),
        ),
    )
    coded = named.select(
        "kind",
        "region",
        "name",
        F.struct("load_no", "index").alias("at"),
        F.coalesce(
            _pick(properties, CODE_KEYS),
            V.as_text(V.field(f, "id")),
            F.concat_ws(":", "region", "name", F.col("index").cast("string")),
        ).alias("code"),
        _rings(geometry).alias("rings"),
    )
    merged = coded.groupBy("code").agg(
        F.max_by(F.struct("name", "rings"), "at").alias("last"),
        F.min_by(F.struct("kind", "region"), "at").alias("first"),
    )
    return conform(
        merged.select("code", "last.name", "first.kind", "first.region", "last.rings"), AREAS
    )


def load_areas(
    spark: SparkSession, path: str, kind: str, region: str, srid: int = 4326
) -> DataFrame:
    """Areas of a GeoJSON file or of a folder of files, which load in order of their names."""
    if srid != 4326:
        raise ValueError("boundaries must be WGS84 (EPSG:4326)")
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return areas_from_collections(
        text.select(
            F.col("value").alias("payload"),
            F.lit(kind).alias("kind"),
            F.lit(region).alias("region"),
            F.input_file_name().alias("load_no"),
        )
    )
