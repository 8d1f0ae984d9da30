"""The feed: filtered, ordered cluster cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.functions.geo import geodesic_m
from listinglens.functions.listing import distance_to_centre_km, marker_tone, status
from listinglens.operators.nearest import nearest_station, place_info
from listinglens.operators.skew import broadcast_if_small
from listinglens.session import cut_lineage
from listinglens.settings import DEFAULTS, Settings

# What a request may name, and what a card shows of its listing.
VERDICTS = ("deal", "fair", "overpriced")
SORTS = ("newest", "priceAsc", "priceDesc", "bestDeal", "distance", "prague", "train")

REPRESENTATIVE_COLUMNS = [
    "source",
    "source_id",
    "url",
    "price",
    "property_kind",
    "usable_area_m2",
    "land_area_m2",
    "disposition",
    "lat",
    "lng",
    "locality_text",
    "cadastral_name",
    "price_per_usable_m2",
    "price_per_land_m2",
    "percentile",
    "percentile_confidence",
    "sample_size",
    "deal_verdict",
    "is_good_deal",
    "scam_score",
    "scam_reasons",
    "deal_reasons",
    "price_drop_pct",
    "photos",
    "description",
    "first_seen_at",
    "seller_name",
    "seller_type",
]


@dataclass(frozen=True)
class FeedFilters:
    max_price: float | None = None
    min_usable: float | None = None
    max_usable: float | None = None
    min_land: float | None = None
    areas: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    verdict: str | None = None
    good_deals_only: bool = False
    fresh_only: bool = False
    near_train: bool = False
    max_prague_km: float | None = None
    kind: str | None = None
    added_after_ms: float | None = None
    sort: str = "newest"
    limit: int = DEFAULTS.feed_limit


def _finite(text: str | None) -> float | None:
    """JavaScript ``Number(text)``, only when finite."""
    if text is None or text == "":
        return None
    text = text.strip()
    if text == "":
        return 0.0
    try:
        lowered = text.lower()
        if lowered[:2] in ("0x", "0o", "0b"):
            return float(int(lowered, 0))
        if "_" in text or lowered.strip("+-") in ("inf", "infinity", "nan"):
            return None
        value = float(text)
    except ValueError:
        return None
    return value if abs(value) != float("inf") else None


def parse_feed_params(
    params: Mapping[str, Sequence[str]],
) -> tuple[FeedFilters, tuple[int, ...]]:
    """Query parameters -> (filters, cluster ids); ids given means by-id mode.

    Unreadable numbers, verdicts and sorts are ignored; flags count only as "1".
    """

    def one(key: str) -> str | None:
        values = params.get(key) or ()
        return values[0] if values else None

    ids = []
    for raw in params.get("id") or ():
        value = 0.0 if raw.strip() == "" else _finite(raw)
        if value is not None and value == int(value):
            ids.append(int(value))
    verdict, sort = one("verdict"), one("sort")
    filters = FeedFilters(
        max_price=_finite(one("maxPrice")),
        min_usable=_finite(one("minUsable")),
        max_usable=_finite(one("maxUsable")),
        min_land=_finite(one("minLand")),
        areas=tuple(params.get("area") or ()),
        sources=tuple(params.get("source") or ()),
        verdict=verdict if verdict in VERDICTS else None,
        good_deals_only=one("goodDeals") == "1",
        fresh_only=one("fresh") == "1",
        near_train=one("nearTrain") == "1",
        max_prague_km=_finite(one("maxPrague")),
        kind=one("kind"),
        added_after_ms=_finite(one("addedAfter")),
        sort=sort if sort in SORTS else "newest",
    )
    return filters, tuple(ids)


def is_new(first_seen: Column, run_ts: Column, settings: Settings = DEFAULTS) -> Column:
    window = F.make_dt_interval(hours=F.lit(settings.feed_window_hours))
    return first_seen > run_ts - window


def with_representatives(clusters: DataFrame, listings: DataFrame) -> DataFrame:
    """Cluster rows joined to their representative listing."""
    reps = listings.drop("cluster_id").withColumnRenamed("id", "representative_listing_id")
    return clusters.join(reps, "representative_listing_id")


def with_source_member(clusters: DataFrame, listings: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Clusters with any member from one of ``sources``."""
    carrying = listings.filter(
        F.col("source").isin(*sources) & F.col("cluster_id").isNotNull()
    ).select("cluster_id").distinct()
    return clusters.join(carrying, "cluster_id", "left_semi")


def filter_conditions(filters: FeedFilters, run_ts: Column, settings: Settings = DEFAULTS) -> Column:
    """Conditions on the representative. A numeric 0 is the same as not set."""
    keep = F.col("is_active")
    if filters.max_price:
        keep = keep & (F.col("price") > 0) & (F.col("price") <= filters.max_price)
    if filters.min_usable:
        keep = keep & (F.col("usable_area_m2") >= filters.min_usable)
    if filters.max_usable:
        keep = keep & (F.col("usable_area_m2") <= filters.max_usable)
    if filters.min_land:
        keep = keep & (F.col("land_area_m2") >= filters.min_land)
    if filters.areas:
        keep = keep & F.col("cadastral_code").isin(*filters.areas)
    if filters.verdict:
        keep = keep & (F.col("deal_verdict") == filters.verdict)
    if filters.good_deals_only:
        keep = keep & F.col("is_good_deal")
    if filters.kind:
        keep = keep & (F.col("property_kind") == filters.kind)
    if filters.fresh_only:
        keep = keep & is_new(F.col("first_seen_at"), run_ts, settings)
    if filters.added_after_ms is not None:
        micros = F.lit(int(filters.added_after_ms * 1000)).cast("long")
        keep = keep & (F.col("first_seen_at") > F.timestamp_micros(micros))
    return keep


def anchor_distance_km(settings: Settings = DEFAULTS) -> Column:
    if settings.anchor is None:
        return F.lit(None).cast("double")
    metres = geodesic_m(F.col("lat"), F.col("lng"), settings.anchor.lat, settings.anchor.lng)
    return metres / 1000.0


def feed_order(sort: str) -> list[Column]:
    """Order before the limit; ties go to the lower cluster id."""
    lead = {
        "priceAsc": F.col("price").asc_nulls_last(),
        "priceDesc": F.col("price").desc_nulls_last(),
        "bestDeal": F.col("percentile").asc_nulls_last(),
        "distance": F.col("distance_km").asc_nulls_last(),
    }.get(sort, F.col("first_seen_at").desc_nulls_first())
    return [lead, F.col("cluster_id").asc()]


def final_order(sort: str) -> list[Column]:
    """Order after the limit: the two proximity sorts re-sort the page."""
    lead = {"prague": "prague_km", "train": "nearest_station_km"}.get(sort)
    return ([F.col(lead).asc_nulls_last()] if lead else []) + feed_order(sort)


def _base_cards(
    clusters: DataFrame, listings: DataFrame, keep: Column, run_ts: Column, settings: Settings
) -> DataFrame:
    cards = with_representatives(clusters, listings.filter(keep))
    return cards.select(
        "cluster_id",
        F.col("representative_listing_id").alias("listing_id"),
        *REPRESENTATIVE_COLUMNS,
        "min_price",
        "max_price",
        "member_count",
        F.get("photos", F.lit(0)).alias("photo"),
        is_new(F.col("first_seen_at"), run_ts, settings).alias("is_new"),
        anchor_distance_km(settings).alias("distance_km"),
        distance_to_centre_km(F.col("lat"), F.col("lng"), settings).alias("prague_km"),
    )


def _whole_cards(
    ids: DataFrame,
    clusters: DataFrame,
    listings: DataFrame,
    run_ts: Column,
    settings: Settings,
) -> DataFrame:
    """Cards of the clusters named by ``ids`` (cluster_id, listing_id), kept once.

    A page has few ids: where they are small they are broadcast and no listing shuffles.
    """
    few = broadcast_if_small(ids)
    wanted = clusters.join(few, "cluster_id", "left_semi")
    shown = listings.join(few, F.col("id") == F.col("listing_id"), "left_semi")
    return cut_lineage(_base_cards(wanted, shown, F.lit(True), run_ts, settings))


def _page(
    clusters: DataFrame,
    listings: DataFrame,
    stations: DataFrame,
    filters: FeedFilters,
    run_ts: Column,
    settings: Settings,
    proximity: bool,
) -> DataFrame:
    """(cluster_id, listing_id) of one page, found on the columns that filters and order read."""
    keys = ["price", "percentile", "first_seen_at", "lat", "lng"]
    reps = listings.filter(filter_conditions(filters, run_ts, settings)).select(
        F.col("id").alias("listing_id"), *keys
    )
    found = clusters.select("cluster_id", F.col("representative_listing_id").alias("listing_id")).join(
        reps, "listing_id"
    )
    order = final_order(filters.sort) if proximity else feed_order(filters.sort)
    if filters.sort == "distance":
        found = found.withColumn("distance_km", anchor_distance_km(settings))
    if proximity:
        found = found.withColumn("prague_km", distance_to_centre_km(F.col("lat"), F.col("lng"), settings))
        if filters.max_prague_km is not None:
            found = found.filter(F.col("prague_km") <= filters.max_prague_km)
        if filters.near_train or filters.sort == "train":
            # Points are read by the search and by the join with its result: keep the keys once.
            found = nearest_station(cut_lineage(found), stations)
        if filters.near_train:
            found = found.filter(F.col("nearest_station_km") <= settings.near_train_km)
    top = found.orderBy(*order).limit(filters.limit)
    return cut_lineage(top.select("cluster_id", "listing_id"))


def _with_proximity(
    cards: DataFrame, stations: DataFrame, places: DataFrame, settings: Settings
) -> DataFrame:
    located = nearest_station(cards, stations)
    return place_info(located, places, F.coalesce("cadastral_name", "locality_text"), settings)


def _proximity_filter(cards: DataFrame, filters: FeedFilters, settings: Settings) -> DataFrame:
    if filters.near_train:
        cards = cards.filter(F.col("nearest_station_km") <= settings.near_train_km)
    if filters.max_prague_km is not None:
        cards = cards.filter(F.col("prague_km") <= filters.max_prague_km)
    return cards


def cluster_members(listings: DataFrame) -> DataFrame:
    """Members of every cluster as rows: the unbounded form of the card's list."""
    return listings.filter(F.col("cluster_id").isNotNull()).select(
        "cluster_id", "source", "source_id", "url", "price", "id"
    )


def nest_members(cards: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds ``members`` (cheapest first, unpriced last) to the cards of one page.

    Meant for a limited page: the members of all other clusters never shuffle.
    """
    wanted = broadcast_if_small(cards.select("cluster_id"))
    member = F.struct(
        F.col("price").isNull().alias("_unpriced"), "price", "id", "source", "source_id", "url"
    )
    nested = (
        cluster_members(listings)
        .join(wanted, "cluster_id", "left_semi")
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .withColumn(
            "members",
            F.transform(
                "members",
                lambda m: F.struct(
                    m["source"].alias("source"),
                    m["source_id"].alias("source_id"),
                    m["url"].alias("url"),
                    m["price"].alias("price"),
                ),
            ),
        )
    )
    return cards.join(nested, "cluster_id", "left")


def _numbered(cards: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``position``; the page is bounded by its limit."""
    return cards.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def with_status(cards: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    label, tone = status(F.col("scam_score"), F.col("is_good_deal"), F.col("deal_verdict"), settings)
    return cards.withColumns(
        {
            "status_label": label,
            "status_tone": tone,
            "marker_tone": marker_tone(F.col("scam_score"), F.col("percentile"), settings),
        }
    )


def needs_proximity(filters: FeedFilters) -> bool:
    """Whether a filter or the sort looks at what only the neighbours tell."""
    return bool(filters.near_train or filters.max_prague_km is not None or filters.sort in ("train", "prague"))


def get_clusters(
    listings: DataFrame,
    clusters: DataFrame,
    stations: DataFrame,
    places: DataFrame,
    filters: FeedFilters,
    run_ts: Column,
    settings: Settings = DEFAULTS,
    exact: bool = True,
) -> DataFrame:
    """One feed page of cluster cards, ordered by ``position``.

    Proximity filters and sorts work on all matching clusters; ``exact=False``
    applies them to the page left by the limit only, as the original does.
    The page is found on a few columns; whole listings are read for it alone.
    """
    wanted = clusters
    if filters.sources:
        wanted = with_source_member(clusters, listings, filters.sources)
    proximity = exact and needs_proximity(filters)
    ids = _page(wanted, listings, stations, filters, run_ts, settings, proximity)
    page = _with_proximity(_whole_cards(ids, clusters, listings, run_ts, settings), stations, places, settings)
    if not exact:
        page = _proximity_filter(page, filters, settings)
    page = _numbered(nest_members(page, listings), final_order(filters.sort))
    return with_status(page, settings).orderBy("position")


def get_clusters_by_id(
    listings: DataFrame,
    clusters: DataFrame,
    stations: DataFrame,
    places: DataFrame,
    ids: DataFrame,
    run_ts: Column,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Cards of given cluster ids, newest first, whatever their state or the filters."""
    wanted = clusters.join(ids.select("cluster_id").distinct(), "cluster_id", "left_semi")
    named = cut_lineage(wanted.select("cluster_id", F.col("representative_listing_id").alias("listing_id")))
    cards = _whole_cards(named, clusters, listings, run_ts, settings)
    cards = nest_members(_with_proximity(cards, stations, places, settings), listings)
    return with_status(cards, settings).orderBy(*feed_order("newest"))


def answer_request(
    params: Mapping[str, Sequence[str]],
    listings: DataFrame,
    clusters: DataFrame,
    stations: DataFrame,
    places: DataFrame,
    run_ts: Column,
    settings: Settings = DEFAULTS,
    exact: bool = True,
) -> DataFrame:
    """The cards that query parameters ask for: those of the given ids, else a feed page."""
    filters, ids = parse_feed_params(params)
    if not ids:
        return get_clusters(listings, clusters, stations, places, filters, run_ts, settings, exact)
    named = listings.sparkSession.createDataFrame([(i,) for i in ids], "cluster_id long")
    return get_clusters_by_id(listings, clusters, stations, places, named, run_ts, settings)


def paginate(df: DataFrame, page: int, size: int, order: Sequence[Column]) -> DataFrame:
    """Rows of a zero-based page, with ``total`` and ``pages``; ``order`` must be unique."""
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset(page * size).limit(size)
    return rows.withColumn("total", total).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("long")
    )
