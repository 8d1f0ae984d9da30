"""Feed pages, by-id cards, counts, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.functions.listing import (
    date_range_filter,
    marker_tone,
    percentile_tone,
    since_label,
    status,
)
from listinglens.operators import facets
from listinglens.operators import feed as Q
from listinglens.operators.duplicates import build_clusters
from listinglens.settings import Anchor, Settings
from workload import fixtures as X
from workload.base import ORACLES, block, query, staged
from workload.geo import CLASS_SQL, haversine_sql, lambert_sql

ANCHOR = Settings(anchor=Anchor(49.2, 16.6, "Office"))

block(
    "card",
    f"""SELECT c.cluster_id, s.id AS listing_id, s.source, s.source_id, s.url, s.price,
    c.min_price, c.max_price, c.member_count, s.property_kind, s.usable_area_m2, s.land_area_m2,
    s.lat, s.lng, s.locality_text, s.cadastral_name, s.cadastral_code, s.price_per_usable_m2, s.percentile,
    s.deal_verdict, s.is_good_deal, s.scam_score, s.first_seen_at,
    CASE WHEN s.id % 11 > 0 THEN 'https://img.example/' || CAST(s.id AS VARCHAR) || '/0' END AS photo,
    s.first_seen_at > TIMESTAMP '{X.RUN_TS}' - INTERVAL 48 HOUR AS is_new,
    {lambert_sql('s.lat', 's.lng', '49.2', '16.6')} / 1000 AS distance_km,
    {haversine_sql('s.lat', 's.lng', 50.0875, 14.4213)} AS prague_km,
    CASE WHEN s.scam_score >= 30 THEN 'Caution · risk ' || CAST(s.scam_score AS VARCHAR) || '/100'
         WHEN s.is_good_deal THEN 'Good deal' WHEN s.deal_verdict = 'overpriced' THEN 'Overpriced'
         WHEN s.deal_verdict = 'deal' THEN 'Below average' END AS status_label,
    CASE WHEN s.scam_score >= 30 THEN 'caution' WHEN s.is_good_deal THEN 'deal'
         WHEN s.deal_verdict = 'overpriced' THEN 'overpriced'
         WHEN s.deal_verdict = 'deal' THEN 'deal' END AS status_tone,
    CASE WHEN s.scam_score >= 30 THEN 'caution' WHEN s.percentile <= 25 THEN 'deal'
         WHEN s.percentile >= 80 THEN 'overpriced' ELSE 'fair' END AS marker_tone
  FROM house_cluster c JOIN scored s ON s.id = c.representative_listing_id""",
)
block(
    "member_text",
    """SELECT cluster_id, string_agg(source || '|' || source_id || '|' || coalesce(CAST(price AS VARCHAR), '-'),
      ', ' ORDER BY price NULLS LAST, id) AS members
  FROM scored GROUP BY cluster_id""",
)

CARD_COLUMNS = """cluster_id, listing_id, source, source_id, price, min_price, max_price, member_count,
    usable_area_m2, round(percentile, 6) AS percentile, deal_verdict, is_good_deal, scam_score, photo, is_new,
    round(distance_km, 4) AS distance_km, round(prague_km, 6) AS prague_km,
    nearest_station_name, round(nearest_station_km, 6) AS nearest_station_km,
    pop_shown AS population, class_shown AS settlement_class, members, status_label, status_tone, marker_tone"""


def feed_sql(
    where: str = "TRUE",
    order: str = "first_seen_at DESC",
    limit: int = 500,
    post: str = "TRUE",
    final: str | None = None,
    exact: bool = True,
) -> str:
    """A feed page in SQL; ``exact`` has the proximity step before the limit."""
    exact = exact and (post != "TRUE" or final is not None)
    near = f"""SELECT f.*, st.nearest_station_name, st.nearest_station_km,
          CASE WHEN coalesce(cadastral_name, locality_text) LIKE 'Praha%' THEN 1357000 ELSE pl.pop END AS pop_shown,
          CASE WHEN f.lat IS NOT NULL THEN {CLASS_SQL} END AS class_shown
        FROM {{src}} f LEFT JOIN near_station st USING (lat, lng) LEFT JOIN near_place pl USING (lat, lng)"""
    ordered = f"{final + ', ' if final else ''}{order}, cluster_id"
    if exact:
        inner = f"""SELECT * FROM ({near.format(src=f"(SELECT * FROM card WHERE {where})")})
          WHERE {post} ORDER BY {ordered} LIMIT {limit}"""
    else:
        page = f"(SELECT * FROM card WHERE {where} ORDER BY {order}, cluster_id LIMIT {limit})"
        inner = f"SELECT * FROM ({near.format(src=page)}) WHERE {post}"
    return f"""SELECT row_number() OVER (ORDER BY {ordered}) AS position, {CARD_COLUMNS}
      FROM ({inner}) LEFT JOIN member_text USING (cluster_id)"""


def member_line(m):
    return F.concat_ws("|", m["source"], m["source_id"], F.coalesce(m["price"].cast("string"), F.lit("-")))


def shown(cards):
    return cards.select(
        "position",
        "cluster_id",
        "listing_id",
        "source",
        "source_id",
        "price",
        "min_price",
        "max_price",
        "member_count",
        "usable_area_m2",
        F.round("percentile", 6).alias("percentile"),
        "deal_verdict",
        "is_good_deal",
        "scam_score",
        "photo",
        "is_new",
        F.round("distance_km", 4).alias("distance_km"),
        F.round("prague_km", 6).alias("prague_km"),
        "nearest_station_name",
        F.round("nearest_station_km", 6).alias("nearest_station_km"),
        "population",
        "settlement_class",
        F.array_join(F.transform("members", member_line), ", ").alias("members"),
        "status_label",
        "status_tone",
        "marker_tone",
    )


def homes_and_clusters(spark, sf):
    homes = staged(spark, sf, "scored", lambda: X.scored_houses(spark, sf))
    components = homes.select("id", F.col("cluster_id").alias("component"))
    clusters = staged(spark, sf, "clusters", lambda: build_clusters(homes, components))
    return homes, clusters


def feed(spark, sf, filters, exact=True):
    homes, clusters = homes_and_clusters(spark, sf)
    return shown(
        Q.get_clusters(
            homes,
            clusters,
            X.stations(spark, sf),
            X.places(spark, sf),
            filters,
            X.run_ts(),
            ANCHOR,
            exact=exact,
        )
    )


def feed_query(name: str, filters: Q.FeedFilters, exact: bool = True, **sql) -> None:
    query(name, feed_sql(exact=exact, **sql))(lambda spark, sf: feed(spark, sf, filters, exact))


feed_query("feed_newest", Q.FeedFilters())
feed_query("feed_price_asc", Q.FeedFilters(sort="priceAsc"), order="price ASC NULLS LAST")
feed_query("feed_price_desc", Q.FeedFilters(sort="priceDesc"), order="price DESC NULLS LAST")
feed_query("feed_best_deal", Q.FeedFilters(sort="bestDeal"), order="percentile ASC NULLS LAST")
feed_query("feed_distance", Q.FeedFilters(sort="distance"), order="distance_km ASC NULLS LAST")
feed_query("feed_prague", Q.FeedFilters(sort="prague"), final="prague_km ASC NULLS LAST")
feed_query(
    "feed_train",
    Q.FeedFilters(sort="train", near_train=True),
    post="nearest_station_km <= 1.5",
    final="nearest_station_km ASC NULLS LAST",
)
feed_query(
    "feed_train_page",
    Q.FeedFilters(sort="train", near_train=True),
    exact=False,
    post="nearest_station_km <= 1.5",
    final="nearest_station_km ASC NULLS LAST",
)
feed_query(
    "feed_train_exact",
    Q.FeedFilters(sort="train", near_train=True, max_prague_km=40.0),
    post="nearest_station_km <= 1.5 AND prague_km <= 40",
    final="nearest_station_km ASC NULLS LAST",
)
feed_query(
    "feed_filtered",
    Q.FeedFilters(
        max_price=4_000_000,
        min_usable=60,
        max_usable=180,
        min_land=200,
        sources=("beta", "gamma"),
        kind="rodinny_dum",
        sort="priceDesc",
    ),
    where="""price > 0 AND price <= 4000000 AND usable_area_m2 BETWEEN 60 AND 180 AND land_area_m2 >= 200
        AND property_kind = 'rodinny_dum'
        AND cluster_id IN (SELECT cluster_id FROM scored WHERE source IN ('beta', 'gamma'))""",
    order="price DESC NULLS LAST",
)
feed_query(
    "feed_good_deals",
    Q.FeedFilters(areas=("A1", "A7", "A12", "A18"), verdict="deal", good_deals_only=True),
    where="cadastral_code IN ('A1', 'A7', 'A12', 'A18') AND deal_verdict = 'deal' AND is_good_deal",
)
feed_query("feed_fresh", Q.FeedFilters(fresh_only=True), where="is_new")
feed_query(
    "feed_added_after",
    Q.FeedFilters(added_after_ms=978307200000.0, max_prague_km=30.0),
    where="first_seen_at > TIMESTAMP '2001-01-01 00:00:00'",
    post="prague_km <= 30",
)


@query(
    "representatives",
    "SELECT cluster_id, listing_id, price, member_count FROM card",
)
def _(spark, sf):
    homes, clusters = homes_and_clusters(spark, sf)
    return Q.with_representatives(clusters, homes).select(
        "cluster_id",
        F.col("representative_listing_id").alias("listing_id"),
        "price",
        "member_count",
    )


@query(
    "source_membership",
    """SELECT cluster_id, member_count FROM house_cluster
       WHERE cluster_id IN (SELECT cluster_id FROM house WHERE source = 'beta' AND is_active)""",
)
def _(spark, sf):
    homes = X.housed(X.listings(spark, sf))
    clusters = build_clusters(homes, X.house_components(X.listings(spark, sf)))
    return Q.with_source_member(clusters, homes, ["beta"]).select("cluster_id", "member_count")


@query(
    "clusters_by_id",
    """SELECT cluster_id, listing_id, price, round(prague_km, 6) AS prague_km,
         nearest_station_name, status_tone, members
       FROM card LEFT JOIN near_station USING (lat, lng) LEFT JOIN member_text USING (cluster_id)
       WHERE cluster_id IN (SELECT CAST(round(value * 7) AS BIGINT) FROM events)""",
)
def _(spark, sf):
    """Cards of the cluster ids named by the events table."""
    homes, clusters = homes_and_clusters(spark, sf)
    ids = X.table(spark, sf, "events").select(F.expr("cast(round(value * 7) as bigint) as cluster_id"))
    cards = Q.get_clusters_by_id(
        homes, clusters, X.stations(spark, sf), X.places(spark, sf), ids, X.run_ts(), ANCHOR
    )
    return cards.select(
        "cluster_id",
        "listing_id",
        "price",
        F.round("prague_km", 6).alias("prague_km"),
        "nearest_station_name",
        "status_tone",
        F.array_join(F.transform("members", member_line), ", ").alias("members"),
    )


#: What the parameters of "feed_filtered" look like in a request; what cannot be read is passed over.
REQUEST = {
    "maxPrice": ["4e6"],
    "minUsable": ["60"],
    "maxUsable": [" 180 "],
    "minLand": ["0xC8"],
    "maxPrague": ["far"],
    "source": ["beta", "gamma"],
    "kind": ["rodinny_dum"],
    "verdict": ["bargain"],
    "fresh": ["yes"],
    "sort": ["priceDesc"],
}


def request(spark, sf, params):
    homes, clusters = homes_and_clusters(spark, sf)
    return Q.answer_request(
        params, homes, clusters, X.stations(spark, sf), X.places(spark, sf), X.run_ts(), ANCHOR
    )


@query("feed_request", ORACLES["feed_filtered"])
def _(spark, sf):
    return shown(request(spark, sf, REQUEST))


@query(
    "feed_request_ids",
    """SELECT cluster_id, listing_id, price, member_count FROM card
       WHERE cluster_id % 7 = 0 AND cluster_id BETWEEN 0 AND 700""",
)
def _(spark, sf):
    """Ids in a request come before its filters; odd ones are passed over."""
    ids = [*[str(i) for i in range(0, 701, 7)], "x", "7.5", "1e400"]
    cards = request(spark, sf, {**REQUEST, "id": ids})
    return cards.select("cluster_id", "listing_id", "price", "member_count")


@query(
    "cluster_members",
    "SELECT cluster_id, source, source_id, url, price, id FROM house WHERE cluster_id IS NOT NULL",
)
def _(spark, sf):
    return Q.cluster_members(X.housed(X.listings(spark, sf)))


@query(
    "facet_counts",
    """SELECT facet, value, count(*) AS "count" FROM (
         SELECT unnest([{'facet': 'source', 'value': source}, {'facet': 'property_kind', 'value': property_kind},
           {'facet': 'seller_type', 'value': seller_type},
           {'facet': 'has_ico', 'value': CAST(has_ico AS VARCHAR)}], recursive := true) FROM lst)
       GROUP BY facet, value""",
)
def _(spark, sf):
    return facets.facet_counts(
        X.listings(spark, sf), ["source", "property_kind", "seller_type", "has_ico"]
    )


@query("status_counts", """SELECT status_tone, count(*) AS "count" FROM card GROUP BY status_tone""")
def _(spark, sf):
    homes, clusters = homes_and_clusters(spark, sf)
    return facets.status_counts(Q.with_representatives(clusters, homes))


@query(
    "status_tones",
    """SELECT cluster_id, status_label, status_tone, marker_tone,
         CASE WHEN percentile <= 25 THEN 'deal' WHEN percentile >= 80 THEN 'overpriced' ELSE 'fair' END
           AS percentile_tone
       FROM card""",
)
def _(spark, sf):
    homes, clusters = homes_and_clusters(spark, sf)
    cards = Q.with_representatives(clusters, homes)
    label, tone = status(F.col("scam_score"), F.col("is_good_deal"), F.col("deal_verdict"))
    return cards.select(
        "cluster_id",
        label.alias("status_label"),
        tone.alias("status_tone"),
        marker_tone(F.col("scam_score"), F.col("percentile")).alias("marker_tone"),
        percentile_tone(F.col("percentile")).alias("percentile_tone"),
    )


@query(
    "is_new",
    f"""SELECT id, first_seen_at > TIMESTAMP '{X.RUN_TS}' - INTERVAL 48 HOUR AS is_new FROM lst""",
)
def _(spark, sf):
    return X.listings(spark, sf).select(
        "id", Q.is_new(F.col("first_seen_at"), X.run_ts()).alias("is_new")
    )


@query(
    "paginate",
    """SELECT id, price, (SELECT count(*) FROM lst) AS total,
         CAST(ceil((SELECT count(*) FROM lst) / 50.0) AS BIGINT) AS pages
       FROM lst ORDER BY price DESC NULLS LAST, id LIMIT 50 OFFSET 150""",
)
def _(spark, sf):
    rows = X.listings(spark, sf).select("id", "price")
    return Q.paginate(rows, 3, 50, [F.col("price").desc_nulls_last(), F.col("id").asc()])


@query(
    "since_label",
    f"""SELECT event_id, CASE WHEN days <= 0 THEN 'earlier today' WHEN days = 1 THEN 'yesterday'
         WHEN days < 7 THEN dayname(ts) ELSE strftime(ts, '%b ') || CAST(day(ts) AS VARCHAR) END AS label
       FROM (SELECT event_id, ts, date_diff('day', CAST(ts AS DATE),
               CAST((SELECT max(ts) FROM events) AS DATE)) AS days FROM events)""",
)
def _(spark, sf):
    events = X.table(spark, sf, "events")
    latest = events.agg(F.max("ts")).scalar()
    return events.select("event_id", since_label(F.col("ts"), latest).alias("label"))


@query(
    "date_range_filter",
    """SELECT id FROM lst WHERE CAST(posted_at AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-06-30'""",
)
def _(spark, sf):
    return (
        X.listings(spark, sf)
        .filter(date_range_filter(F.col("posted_at"), "1997-03-01", "1998-06-30"))
        .select("id")
    )
