"""The score stage and the whole nightly run, stolen photos included."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.operators.facets import area_facets
from listinglens.operators.scoring import score
from listinglens.plans.nightly import Nightly
from listinglens.schemas import LISTINGS
from listinglens.session import scratch_path
from listinglens.sources.tables import append_run, write_table
from workload import fixtures as X
from workload.base import block, query
from workload.photos import clustered
from workload.scoring import DEAL_SQL, REASON_SQL, reasons_text

block("stolen_id", "SELECT listing_id AS id FROM far_shared WHERE shared >= 3")
X.scored_block("scored_full", "metric", "pct", "stolen_id")
SCORED = f"""SELECT id, price_per_usable_m2, price_per_land_m2, bucket_key, percentile, percentile_confidence,
    sample_size, deal_verdict, is_good_deal, scam_score, {REASON_SQL} AS scam_reasons,
    {DEAL_SQL} AS deal_reasons, price_drop_pct FROM scored_full"""


def shown(scored):
    return scored.select(
        "id",
        "price_per_usable_m2",
        "price_per_land_m2",
        "bucket_key",
        "percentile",
        "percentile_confidence",
        "sample_size",
        "deal_verdict",
        "is_good_deal",
        "scam_score",
        reasons_text("scam_reasons").alias("scam_reasons"),
        reasons_text("deal_reasons").alias("deal_reasons"),
        "price_drop_pct",
    )


@query("score", SCORED)
def _(spark, sf):
    from listinglens.operators.areas import assign_bucket

    listings = assign_bucket(clustered(spark, sf), X.areas(spark, sf))
    return shown(
        score(listings, X.price_history(spark, sf), X.image_hashes(spark, sf), X.run_ts())
    )


def nightly_run(spark, sf) -> Nightly:
    """Bucket, dedupe and score over stored tables of listings, hashes and history."""
    run = Nightly(spark, scratch_path(spark, "nightly"), 2, X.run_ts())
    write_table(X.listings(spark, sf), run.root, "listings", 1, partition_by=["source"])
    append_run(X.image_hashes(spark, sf), run.root, "image_hashes", 1)
    append_run(X.price_history(spark, sf), run.root, "price_history", 1)
    run.bucket(X.areas(spark, sf))
    run.dedupe()
    run.score()
    return run


@query("nightly_scores", SCORED)
def _(spark, sf):
    return shown(nightly_run(spark, sf).table("scored", LISTINGS).filter("is_active"))


@query(
    "nightly_facets",
    """SELECT cadastral_code AS code, cadastral_name AS name, count(*) AS "count",
         max(scam_score) AS max_scam
       FROM scored_full WHERE cadastral_code IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    scored = nightly_run(spark, sf).table("scored", LISTINGS)
    worst = scored.groupBy(F.col("cadastral_code").alias("code")).agg(
        F.max("scam_score").alias("max_scam")
    )
    return area_facets(scored).join(worst, "code")
