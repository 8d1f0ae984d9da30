"""Which photos still need a hash, and hashing of decoded rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.functions.hashing import dhash_from_pixels
from listinglens.settings import DEFAULTS, Settings


def pending_images(
    listings: DataFrame, hashes: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Photos of active listings that have no hash at all, up to the limit set."""
    limit = settings.max_images_per_listing
    photos = F.slice("photos", 1, limit) if limit else F.col("photos")
    due = (
        listings.filter(F.col("is_active") & (F.size("photos") > 0))
        .select("id", photos.alias("photos"))
        .join(hashes.select(F.col("listing_id").alias("id")), "id", "left_anti")
    )
    return due.select(
        F.col("id").alias("listing_id"), F.posexplode("photos").alias("position", "url")
    )


def hash_images(rasters: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Hash rows of readable rasters, one for each (listing, position).

    Of several rasters of one position that of the lowest url counts; pairs
    already stored are kept as they are.
    """
    hashed = rasters.select(
        "listing_id", "position", "url", dhash_from_pixels(F.col("px")).alias("dhash")
    ).filter(F.col("dhash").isNotNull())
    hashed = hashed.groupBy("listing_id", "position").agg(
        F.min(F.struct("url", "dhash")).alias("first")
    ).select("listing_id", "position", "first.url", "first.dhash")
    if existing is None:
        return hashed
    return hashed.join(existing.select("listing_id", "position"), ["listing_id", "position"], "left_anti")


def hash_summary(new_hashes: DataFrame, pending: DataFrame) -> DataFrame:
    listings = pending.agg(F.countDistinct("listing_id")).scalar()
    return new_hashes.agg(F.count("*").alias("hashes")).select(
        listings.alias("listings"), "hashes"
    )
