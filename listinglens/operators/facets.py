"""Facets and counts around the feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.operators.feed import with_status
from listinglens.settings import DEFAULTS, Settings


def area_facets(listings: DataFrame) -> DataFrame:
    """Active listings per area, most first."""
    return (
        listings.filter(F.col("is_active") & F.col("cadastral_code").isNotNull())
        .groupBy(F.col("cadastral_code").alias("code"), F.col("cadastral_name").alias("name"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "name", "code")
    )


def price_max(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("is_active") & (F.col("price") > 0)).agg(
        F.max("price").cast("double").alias("price_max")
    )


def facet_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, count) for each column, one pass over ``df``."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.explode(pairs).alias("_f"))
        .groupBy("_f.facet", "_f.value")
        .agg(F.count("*").alias("count"))
    )


def status_counts(cards: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return with_status(cards, settings).groupBy("status_tone").agg(F.count("*").alias("count"))


def app_config(listings: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(area facets, one row of anchor / price_max / feed_window_hours)."""
    anchor = settings.anchor
    head = price_max(listings).select(
        F.lit(anchor.lat if anchor else None).cast("double").alias("anchor_lat"),
        F.lit(anchor.lng if anchor else None).cast("double").alias("anchor_lng"),
        F.lit(anchor.label if anchor else None).cast("string").alias("anchor_label"),
        "price_max",
        F.lit(settings.feed_window_hours).cast("long").alias("feed_window_hours"),
    )
    return area_facets(listings), head
