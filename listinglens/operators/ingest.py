"""Incremental ingest: scope, upsert, price history, enrichment, lifecycle.

A run's adverts arrive as one batch. A key seen several times in a run behaves
as if its adverts were applied one after the other in (page_no, pos) order:
that fold is an aggregate, so it combines before the shuffle. Only price
changes need neighbouring rows; those use the two-level lag of
:mod:`listinglens.operators.skew`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.operators.skew import broadcast_if_small, chunked_rank, nearest_non_null
from listinglens.schemas import LISTINGS, conform
from listinglens.session import cut_lineage
from listinglens.settings import DEFAULTS, Settings

KEY = ["source", "source_id"]

# What an advert may change on a listing that is already stored.
REFRESHED_IF_PRESENT = ["price", "lat", "lng", "locality_text", "property_kind", "url"]
SET_ON_INSERT = [
    "usable_area_m2",
    "built_up_area_m2",
    "land_area_m2",
    "disposition",
    "seller_type",
    "seller_name",
    "has_ico",
    "description",
    "labels",
]
PATCHABLE = [
    "price",
    "usable_area_m2",
    "built_up_area_m2",
    "land_area_m2",
    "disposition",
    "lat",
    "lng",
    "locality_text",
    "seller_type",
    "seller_name",
    "has_ico",
    "description",
    "photos",
    "labels",
    "posted_at",
]
PAGES_PER_CHUNK = 64


def in_scope(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop recreational homes and adverts located outside the region."""
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    in_box = F.col("lat").between(*settings.bbox_lat) & F.col("lng").between(*settings.bbox_lng)
    return raw.filter(
        ~F.col("property_kind").eqNullSafe("recreational") & (~located | in_box)
    )


def fold_batch(batch: DataFrame) -> DataFrame:
    """One row per key: the net effect of all its adverts in the run."""
    at = F.struct("page_no", "pos")

    def latest(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), at)).alias(name)

    folded = batch.groupBy(*KEY).agg(
        *[latest(c) for c in REFRESHED_IF_PRESENT],
        F.max_by(F.struct("photos"), at).alias("_last"),
        F.min_by(F.struct(*SET_ON_INSERT), at).alias("_first"),
        F.min(at).alias("_at"),
    )
    empty = F.array().cast("array<string>")
    return folded.select(
        *KEY,
        *REFRESHED_IF_PRESENT,
        F.coalesce("_last.photos", empty).alias("photos"),
        *[F.col(f"_first.{c}").alias(c) for c in SET_ON_INSERT if c != "labels"],
        F.coalesce("_first.labels", empty).alias("labels"),
        F.col("_at.page_no").alias("page_no"),
        F.col("_at.pos").alias("pos"),
    )


def stored_keys(current: DataFrame, folded: DataFrame) -> DataFrame:
    """Stored id, price and floor area of the batch's keys.

    Only the batch side is ever broadcast (after a count), so the stored table
    is scanned for four columns and not shuffled while the batch is small.
    """
    wanted = broadcast_if_small(folded.select(*KEY))
    return current.select(*KEY, "id", "price", "usable_area_m2").join(wanted, KEY, "left_semi")


def assign_new_ids(fresh: DataFrame, current: DataFrame) -> DataFrame:
    """Ids above the maximum of ``current``, in order of source and first appearance."""
    top = current.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ranked = chunked_rank(
        fresh.withColumn("_block", F.floor(F.col("page_no") / PAGES_PER_CHUNK).cast("long")),
        chunk=["source", "_block"],
        order=[F.col("page_no"), F.col("pos"), F.col("source_id")],
        name="_rank",
    )
    return ranked.withColumn("id", F.col("_rank") + top).drop("_rank", "_block")


def _inserted(fresh: DataFrame, current: DataFrame, run_ts: Column) -> DataFrame:
    return conform(
        assign_new_ids(fresh, current).withColumns(
            {
                "deal_type": F.lit("sell"),
                "currency": F.lit("CZK"),
                "first_seen_at": run_ts,
                "last_seen_at": run_ts,
                "is_active": F.lit(True),
            }
        ),
        LISTINGS,
    )


def _updated(current: DataFrame, folded: DataFrame, run_ts: Column) -> DataFrame:
    changed = [*REFRESHED_IF_PRESENT, "photos"]
    news = broadcast_if_small(
        folded.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(1).alias("_hit"))
    )
    hit = F.col("_hit").isNotNull()
    joined = current.join(news, KEY, "left")
    return joined.withColumns(
        {
            **{c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in changed},
            "last_seen_at": F.when(hit, run_ts).otherwise(F.col("last_seen_at")),
            "is_active": hit | F.col("is_active"),
        }
    ).select(*current.columns)


def price_steps(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Every priced advert with the price the listing had just before it."""
    priced = batch.filter(F.col("price").isNotNull()).select(
        *KEY,
        "page_no",
        "pos",
        F.col("price").alias("new_price"),
        F.floor(F.col("page_no") / PAGES_PER_CHUNK).cast("long").alias("_block"),
    )
    stepped = nearest_non_null(
        priced, KEY, "_block", ["page_no", "pos"], "new_price", "_earlier"
    )
    known = stored.select(*KEY, F.col("price").alias("_stored"))
    return (
        stepped.join(known, KEY, "left")
        .withColumn("old_price", F.coalesce("_earlier", "_stored"))
        .drop("_earlier", "_stored", "_block")
    )


def price_changes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Prices to append to the history: first prices and every change, in order."""
    steps = price_steps(batch, stored_keys(current, batch.select(*KEY).distinct()))
    return steps.filter(~F.col("new_price").eqNullSafe(F.col("old_price")))


@dataclass(frozen=True)
class IngestResult:
    listings: DataFrame
    price_history: DataFrame  # rows to append
    enrich_requests: DataFrame  # key, requests
    counts: DataFrame  # seen, inserted, updated


def upsert_listings(
    current: DataFrame,
    raw: DataFrame,
    run_ts: Column,
    settings: Settings = DEFAULTS,
    all_ids: DataFrame | None = None,
) -> IngestResult:
    """Apply one run's adverts to the stored listings.

    ``current`` may be a part of the table that has all keys of the run; new ids
    are then taken above those of ``all_ids`` (id), the ids of the whole table.
    """
    batch = in_scope(raw, settings)
    # Read by five consumers below, so it is written once to the shared folder.
    folded = cut_lineage(fold_batch(batch))
    stored = cut_lineage(stored_keys(current, folded))
    fresh = cut_lineage(
        _inserted(
            folded.join(stored.select(*KEY), KEY, "left_anti"),
            current if all_ids is None else all_ids,
            run_ts,
        )
    )
    listings = _updated(conform(current, LISTINGS), folded, run_ts).unionByName(fresh)

    changes = price_steps(batch, stored).filter(
        ~F.col("new_price").eqNullSafe(F.col("old_price"))
    )
    ids = stored.select(*KEY, "id").unionByName(fresh.select(*KEY, "id"))
    history = changes.join(ids, KEY).select(
        F.col("id").alias("listing_id"), F.col("new_price").alias("price"), run_ts.alias("seen_at")
    )
    return IngestResult(
        listings=listings,
        price_history=history,
        enrich_requests=enrich_candidates(batch, folded, stored, changes),
        counts=ingest_counts(batch, folded, stored),
    )


def enrich_candidates(
    batch: DataFrame, folded: DataFrame, stored: DataFrame, changes: DataFrame
) -> DataFrame:
    """Keys whose detail page is wanted, with the number of requests made for each.

    An advert asks for details when its listing is new, when it changes the
    price, or when the stored floor area is missing.
    """
    adverts = batch.groupBy(*KEY).agg(F.count("*").alias("adverts"))
    changed = changes.groupBy(*KEY).agg(
        F.count("*").alias("changed"),
        F.min(F.struct("page_no", "pos")).alias("_first_change"),
    )
    seen = (
        folded.select(
            *KEY,
            F.struct("page_no", "pos").alias("_first"),
            F.col("usable_area_m2").alias("_area_new"),
        )
        .join(
            stored.select(
                *KEY, F.lit(True).alias("_stored"), F.col("usable_area_m2").alias("_area_old")
            ),
            KEY,
            "left",
        )
        .join(adverts, KEY)
        .join(changed, KEY, "left")
    )
    is_new = F.col("_stored").isNull()
    area = F.when(is_new, F.col("_area_new")).otherwise(F.col("_area_old"))
    n_changed = F.coalesce("changed", F.lit(0))
    # The inserting advert asks once, whether or not it also sets a price.
    insert_only = (is_new & ~F.col("_first_change").eqNullSafe(F.col("_first"))).cast("int")
    requests = F.when(area.isNull(), F.col("adverts")).otherwise(n_changed + insert_only)
    return seen.withColumn("requests", requests.cast("long")).filter("requests > 0").select(
        *KEY, is_new.alias("is_new"), "requests"
    )


def ingest_counts(batch: DataFrame, folded: DataFrame, stored: DataFrame) -> DataFrame:
    seen = batch.agg(F.count("*")).scalar()
    keys = folded.agg(F.count("*")).scalar()
    return stored.agg(F.count("*").alias("known")).select(
        seen.alias("seen"),
        (keys - F.col("known")).alias("inserted"),
        (seen - keys + F.col("known")).alias("updated"),
    )


def apply_enrichment(listings: DataFrame, patch: DataFrame) -> DataFrame:
    """Overwrite the fields a detail page resolved; unresolved ones stay.

    ``patch`` has one row per key. A patched price leaves no history row.
    """
    fields = [c for c in PATCHABLE if c in patch.columns]
    side = broadcast_if_small(patch.select(*KEY, *[F.col(c).alias(f"_p_{c}") for c in fields]))
    joined = listings.join(side, KEY, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(f"_p_{c}"), F.col(c)) for c in fields}
    ).select(*listings.columns)


def non_empty_patches(patch: DataFrame) -> DataFrame:
    fields = [c for c in PATCHABLE if c in patch.columns]
    resolved = F.lit(False)
    for name in fields:
        resolved = resolved | F.col(name).isNotNull()
    return patch.filter(resolved)


def missing_listings(
    listings: DataFrame, batch: DataFrame, completeness: DataFrame, run_ts: Column
) -> DataFrame:
    """Keys of active listings that a complete pass of their source did not show."""
    done = broadcast_if_small(completeness.filter("completed").select("source").distinct())
    stale = listings.filter(F.col("is_active") & (F.col("last_seen_at") < run_ts)).select(*KEY)
    return stale.join(done, "source", "left_semi").join(batch.select(*KEY).distinct(), KEY, "left_anti")


def deactivate_missing(listings: DataFrame, completeness: DataFrame, run_ts: Column) -> DataFrame:
    """Deactivate what a complete listing pass of its source no longer showed."""
    done = broadcast_if_small(
        completeness.filter("completed").select("source", F.lit(True).alias("_completed"))
    )
    gone = (
        F.col("_completed").isNotNull() & F.col("is_active") & (F.col("last_seen_at") < run_ts)
    )
    return (
        listings.join(done, "source", "left")
        .withColumn("is_active", F.col("is_active") & ~gone)
        .select(*listings.columns)
    )


def ingest_summary(
    counts: DataFrame, enrich_requests: DataFrame, patch: DataFrame, before: DataFrame, after: DataFrame
) -> DataFrame:
    """seen, inserted, updated, enriched, deactivated of one run.

    ``before``/``after`` are the listings around :func:`deactivate_missing`.
    """
    enriched = (
        enrich_requests.join(non_empty_patches(patch).select(*KEY), KEY, "left_semi")
        .agg(F.coalesce(F.sum("requests"), F.lit(0)))
        .scalar()
    )
    active_before = before.agg(F.count_if("is_active")).scalar()
    active_after = after.agg(F.count_if("is_active")).scalar()
    return counts.select(
        "seen",
        "inserted",
        "updated",
        enriched.alias("enriched"),
        (active_before - active_after).alias("deactivated"),
    )
