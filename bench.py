"""Time the headline stages and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each stage runs BENCH_RUNS times (2); the first run warms up, the median of the
others counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from listinglens.operators import areas, duplicates, facets, scoring, stolen_photos
from listinglens.operators import feed as Q
from listinglens.operators import ingest as I
from listinglens.operators.percentile import bucket_stats, with_percentiles
from listinglens.session import build_session, scratch_path
from listinglens.sources import portals as P
from workload import fixtures as X
from workload import ingest as WI
from workload import portals as WP
from workload import triage as WT


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "20g",
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", "16"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = set(sys.argv[1:])
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times: dict[str, float] = {}

    def stored(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def timed(name, run):
        if wanted and name not in wanted:
            return
        took = []
        for _ in range(runs):
            started = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        times[name] = round(statistics.median(took[1:] or took), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    # Stage inputs are stored tables, as between the stages of a nightly run.
    raw = stored(X.listings(spark, sf), "listings")
    hashes = stored(X.image_hashes(spark, sf), "hashes")
    history = stored(X.price_history(spark, sf), "history")
    ops = stored(WT.triage_ops(spark, sf), "ops")
    pages = stored(WP.all_pages(spark, sf), "pages")
    snapshot = stored(WI.raw_run(spark, sf, 2), "snapshot")
    first = stored(WI.after_first_run(spark, sf), "first")
    boundaries, stations, places = X.areas(spark, sf), X.stations(spark, sf), X.places(spark, sf)
    spark.range(1).count()

    timed("normalize_pages", lambda: P.normalize_pages(pages))
    timed("upsert_listings", lambda: I.upsert_listings(first, snapshot, WI.run_time(2)).listings)
    timed("assign_bucket", lambda: areas.assign_bucket(raw, boundaries))
    bucketed = stored(areas.assign_bucket(raw, boundaries), "bucketed")
    timed("duplicate_components", lambda: duplicates.duplicate_components(bucketed, hashes))
    timed("dedupe_candidates", lambda: duplicates.dedupe_candidates(bucketed))
    components = stored(duplicates.duplicate_components(bucketed, hashes), "components")
    clusters = stored(duplicates.build_clusters(bucketed, components), "clusters")
    clustered = stored(duplicates.assign_clusters(bucketed, components), "clustered")
    timed("stolen_photos", lambda: stolen_photos.stolen_photo_listings(clustered, hashes))
    stolen = stored(stolen_photos.stolen_photo_listings(clustered, hashes), "stolen")
    active = stored(scoring.price_metrics(clustered.filter("is_active")), "active")
    timed("percentiles", lambda: with_percentiles(active))
    timed("bucket_stats", lambda: bucket_stats(active))
    top = stored(scoring.max_price_by_listing(history), "top")
    timed("score", lambda: scoring.score_signals(clustered, top, stolen, X.run_ts()))
    scored = stored(scoring.score_signals(clustered, top, stolen, X.run_ts()), "scored")

    def page(**filters):
        exact = filters.pop("exact", False)
        return Q.get_clusters(
            scored, clusters, stations, places, Q.FeedFilters(**filters), X.run_ts(), exact=exact
        )

    timed("feed_newest", lambda: page())
    timed("feed_filtered", lambda: page(max_price=4e6, min_usable=60, sources=("beta",)))
    timed("feed_best_deal", lambda: page(sort="bestDeal", good_deals_only=True))
    timed("feed_train_exact", lambda: page(sort="train", near_train=True, exact=True))
    timed("area_facets", lambda: facets.area_facets(scored))
    timed("fold_triage", lambda: WT.T.fold_triage(ops))

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
                "rows": {"listings": raw.agg(F.count("*")).first()[0]},
            }
        )
    )


if __name__ == "__main__":
    main()
