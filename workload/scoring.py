"""Buckets, percentiles and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.functions.listing import size_band
from listinglens.functions.text import red_phrase
from listinglens.operators import areas as A
from listinglens.operators import facets, scoring
from listinglens.operators.percentile import (
    bucket_stats,
    mid_rank_percentile,
    price_percentiles,
    with_percentiles,
)
from listinglens.sources.tables import scan_active
from workload import fixtures as X
from workload.base import query


def reasons_text(name: str):
    """Reasons as one line of text: code:label:weight, in order."""
    return F.array_join(
        F.transform(
            name,
            lambda r: F.concat_ws(
                ":", r["code"], r["label"], F.format_string("%.6f", F.round(r["weight"], 6))
            ),
        ),
        "; ",
    )


@query("size_band", f"SELECT id, {X.BAND_SQL} AS size_band FROM lst")
def _(spark, sf):
    return X.listings(spark, sf).select("id", size_band(F.col("usable_area_m2")).alias("size_band"))


@query(
    "scan_active",
    "SELECT id, price, usable_area_m2 FROM lst WHERE is_active",
)
def _(spark, sf):
    return scan_active(X.listings(spark, sf), "id", "price", "usable_area_m2")


@query("price_metrics", "SELECT id, price_per_usable_m2, price_per_land_m2 FROM metric")
def _(spark, sf):
    return scoring.price_metrics(X.listings(spark, sf)).select(
        "id", "price_per_usable_m2", "price_per_land_m2"
    )


@query(
    "assign_area",
    "SELECT id, cadastral_code, cadastral_name, bucket_source, size_band FROM bkt",
)
def _(spark, sf):
    return X.bucketed(spark, sf).select(
        "id", "cadastral_code", "cadastral_name", "bucket_source", "size_band"
    )


@query(
    "bucket_summary",
    """SELECT count(*) FILTER (WHERE bucket_source = 'polygon') AS polygon,
         count(*) FILTER (WHERE bucket_source = 'locality') AS locality,
         count(usable_area_m2) AS banded
       FROM bkt WHERE is_active""",
)
def _(spark, sf):
    return A.bucket_summary(X.bucketed(spark, sf))


@query(
    "area_facets",
    """SELECT cadastral_code AS code, cadastral_name AS name, count(*) AS "count"
       FROM bkt WHERE is_active AND cadastral_code IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return facets.area_facets(X.bucketed(spark, sf))


@query(
    "app_config",
    """SELECT CAST(NULL AS DOUBLE) AS anchor_lat, CAST(NULL AS DOUBLE) AS anchor_lng,
         CAST(NULL AS VARCHAR) AS anchor_label,
         CAST(max(price) AS DOUBLE) AS price_max, CAST(48 AS BIGINT) AS feed_window_hours
       FROM lst WHERE is_active AND price > 0""",
)
def _(spark, sf):
    return facets.app_config(X.listings(spark, sf))[1]


@query(
    "price_max",
    "SELECT CAST(max(price) AS DOUBLE) AS price_max FROM lst WHERE is_active AND price > 0",
)
def _(spark, sf):
    return facets.price_max(X.listings(spark, sf))


@query(
    "mid_rank_percentile",
    """SELECT id, (CAST(rank() OVER (PARTITION BY size_band ORDER BY price_per_usable_m2) - 1 AS DOUBLE)
         + CAST(count(*) OVER (PARTITION BY size_band, price_per_usable_m2) AS DOUBLE) / CAST(2 AS DOUBLE))
         / CAST(count(*) OVER (PARTITION BY size_band) AS DOUBLE) * CAST(100 AS DOUBLE) AS percentile
       FROM metric WHERE is_active AND price_per_usable_m2 IS NOT NULL""",
)
def _(spark, sf):
    priced = scoring.price_metrics(X.banded(X.listings(spark, sf).filter("is_active")))
    ranked = mid_rank_percentile(
        priced.filter("price_per_usable_m2 is not null").select("id", "size_band", "price_per_usable_m2"),
        "size_band",
        "price_per_usable_m2",
        "percentile",
    )
    return ranked.select("id", "percentile")


@query(
    "bucket_percentile",
    """SELECT id, percentile, percentile_confidence, sample_size, bucket_key,
         CASE WHEN percentile >= 80 THEN 'overpriced' WHEN percentile <= 25 THEN 'deal'
           WHEN percentile IS NOT NULL THEN 'fair' END AS deal_verdict
       FROM metric LEFT JOIN pct USING (id) WHERE is_active""",
)
def _(spark, sf):
    active = scoring.price_metrics(X.bucketed(spark, sf).filter("is_active"))
    return with_percentiles(active).select(
        "id", "percentile", "percentile_confidence", "sample_size", "bucket_key", "deal_verdict"
    )


@query(
    "price_percentile_cells",
    """SELECT DISTINCT nullif(cadastral_code, '') AS code, nullif(size_band, '') AS band,
         price_per_usable_m2 AS value, percentile, bucket_key
       FROM pct JOIN metric USING (id)""",
)
def _(spark, sf):
    active = scoring.price_metrics(X.bucketed(spark, sf).filter("is_active"))
    return price_percentiles(active).select("code", "band", "value", "percentile", "bucket_key")


@query(
    "bucket_stats",
    """SELECT level, key, count(*) AS n,
         quantile_cont(CAST(v AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(v AS DOUBLE), 0.5) AS median,
         quantile_cont(CAST(v AS DOUBLE), 0.75) AS p75
       FROM (
         SELECT price_per_usable_m2 AS v, unnest([
           {'level': 'code_band', 'key': cadastral_code || '|' || size_band},
           {'level': 'code', 'key': cadastral_code},
           {'level': 'band', 'key': 'band:' || size_band},
           {'level': 'all', 'key': 'all'}], recursive := true)
         FROM metric WHERE is_active AND price_per_usable_m2 IS NOT NULL
       ) WHERE key IS NOT NULL GROUP BY level, key""",
)
def _(spark, sf):
    active = scoring.price_metrics(X.bucketed(spark, sf).filter("is_active"))
    return bucket_stats(active)


@query("max_price_by_listing", "SELECT id AS listing_id, max_price FROM top_price")
def _(spark, sf):
    return scoring.max_price_by_listing(X.price_history(spark, sf))


@query(
    "price_drop",
    """SELECT id, max_price, CASE WHEN price > 0 AND max_price > price
         THEN CAST(max_price - price AS DOUBLE) / CAST(max_price AS DOUBLE) * CAST(100 AS DOUBLE) END
         AS price_drop_pct
       FROM lst LEFT JOIN top_price USING (id)""",
)
def _(spark, sf):
    joined = scoring.with_max_price(
        X.listings(spark, sf).select("id", "price"), X.price_history(spark, sf)
    )
    return joined.select(
        "id", "max_price", scoring.price_drop(F.col("max_price"), F.col("price")).alias("price_drop_pct")
    )


@query(
    "red_phrase",
    f"""SELECT origin, id, {X.PHRASE_SQL} AS phrase FROM (
         SELECT 'listing' AS origin, id, description FROM lst
         UNION ALL SELECT 'document', doc_id, text FROM documents
         UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)""",
)
def _(spark, sf):
    texts = (
        X.listings(spark, sf)
        .select(F.lit("listing").alias("origin"), "id", "description")
        .unionByName(
            X.table(spark, sf, "documents").selectExpr(
                "'document' as origin", "doc_id as id", "text as description"
            )
        )
        .unionByName(
            X.table(spark, sf, "conversations").selectExpr(
                "'turn' as origin", "conv_id * 1000 + turn as id", "text as description"
            )
        )
    )
    return texts.select("origin", "id", red_phrase(F.col("description")).alias("phrase"))


REASON_SQL = """concat_ws('; ',
      CASE WHEN stolen = 1 THEN 'stolen_photos:Photos also appear on a distant listing:40.000000' END,
      CASE WHEN phrased = 1 THEN 'red_phrase:' || phrase || ':25.000000' END,
      CASE WHEN no_ico = 1 THEN 'private_no_ico:Private seller, no IČO:10.000000' END,
      CASE WHEN fresh = 1 THEN 'brand_new:Listed in the last few days:8.000000' END)"""
DEAL_SQL = """concat_ws('; ',
      CASE WHEN percentile <= 25 THEN 'low_percentile:Bottom ' || CAST(CAST(floor(percentile + 0.5) AS BIGINT) AS VARCHAR)
        || '% of CZK/m² for the area:' || printf('%.6f', round(1 - percentile / 100, 6)) END,
      CASE WHEN price_drop_pct >= 3 THEN 'price_drop:Price dropped '
        || CAST(CAST(floor(price_drop_pct + 0.5) AS BIGINT) AS VARCHAR) || '% since first seen:'
        || printf('%.6f', round(least(1, price_drop_pct / 20), 6)) END)"""


@query("scam_flags", f"SELECT id, {REASON_SQL} AS scam_reasons, scam_score FROM scored")
def _(spark, sf):
    return X.scored_houses(spark, sf).select(
        "id", reasons_text("scam_reasons").alias("scam_reasons"), "scam_score"
    )


@query("deal_reasons", f"SELECT id, {DEAL_SQL} AS deal_reasons, is_good_deal, deal_verdict FROM scored")
def _(spark, sf):
    return X.scored_houses(spark, sf).select(
        "id", reasons_text("deal_reasons").alias("deal_reasons"), "is_good_deal", "deal_verdict"
    )


@query(
    "score_summary",
    """SELECT count(*) AS scored, count(price_per_usable_m2) AS priced,
         count(*) FILTER (WHERE is_good_deal) AS good_deals,
         count(*) FILTER (WHERE scam_score >= 30) AS flagged
       FROM scored""",
)
def _(spark, sf):
    return scoring.score_summary(X.scored_houses(spark, sf))
