"""The nightly run and the feed request over stored tables.

Each stage reads the newest version of its inputs and writes a new version of
its outputs, so a failed stage leaves the former state readable and can simply
be run again with the same version number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from listinglens.operators import feed as feed_ops
from listinglens.operators.areas import assign_bucket, bucket_summary
from listinglens.operators.duplicates import (
    assign_clusters,
    build_clusters,
    duplicate_components,
)
from listinglens.operators.images import hash_images, pending_images
from listinglens.operators.ingest import (
    KEY,
    apply_enrichment,
    deactivate_missing,
    in_scope,
    ingest_summary,
    missing_listings,
    upsert_listings,
)
from listinglens.operators.scoring import score, score_summary
from listinglens.schemas import (
    CLUSTERS,
    IMAGE_HASHES,
    LISTINGS,
    PRICE_HISTORY,
    SCORE_COLUMNS,
    conform,
)
from listinglens.session import cut_lineage
from listinglens.settings import DEFAULTS, Settings
from listinglens.sources.portals import (
    normalize_pages,
    page_stats,
    run_completeness,
    store_entries,
)
from listinglens.sources.tables import (
    BucketedTable,
    append_run,
    read_log,
    read_table,
    write_table,
)


@dataclass(frozen=True)
class Nightly:
    """One run: where the tables live, which version it writes, and its clock."""

    spark: SparkSession
    root: str
    version: int
    run_ts: Column
    settings: Settings = DEFAULTS

    def table(self, name: str, schema=None) -> DataFrame:
        return read_table(self.spark, self.root, name, schema)

    def before(self, name: str, schema) -> DataFrame:
        return read_table(self.spark, self.root, name, schema, before=self.version)

    def history(self) -> DataFrame:
        """Prices of the runs whose listings are visible."""
        return read_log(self.spark, self.root, "price_history", PRICE_HISTORY, visible_in="listings")

    def hashes(self, before: int | None = None) -> DataFrame:
        found = read_log(self.spark, self.root, "image_hashes", IMAGE_HASHES, before=before)
        return found.select(*IMAGE_HASHES.names)

    @property
    def listings(self) -> BucketedTable:
        return BucketedTable(self.spark, self.root, "listings", LISTINGS, tuple(KEY), self.settings.buckets)

    def ingest(self, raw: DataFrame, completeness: DataFrame, patches: DataFrame | None = None) -> DataFrame:
        """Upsert a run's adverts, enrich, deactivate; returns the summary row.

        Only the buckets of the run's keys, and of listings that it deactivates,
        are read whole and written; the others keep their files.
        """
        store = self.listings
        append_run(in_scope(raw, self.settings), self.root, "adverts", self.version)
        batch = self.spark.read.schema(raw.schema).parquet(f"{self.root}/adverts/run_id={self.version}")
        before = store.read(before=self.version)
        gone = missing_listings(before, batch, completeness, self.run_ts)
        touched = store.touched(batch) | store.touched(gone)
        current = store.read(before=self.version, buckets=touched)
        result = upsert_listings(current, batch, self.run_ts, self.settings, all_ids=before.select("id"))
        wanted = cut_lineage(result.enrich_requests)
        if patches is None:
            patches = self.spark.createDataFrame([], "source string, source_id string, price long")
        patch = patches.join(wanted.select(*KEY), KEY, "left_semi")
        enriched = cut_lineage(apply_enrichment(result.listings, patch))
        done = deactivate_missing(enriched, completeness, self.run_ts)
        append_run(result.price_history, self.root, "price_history", self.version)
        store.write(done, self.version, touched)
        after = store.read(version=self.version, buckets=touched)
        return ingest_summary(result.counts, wanted, patch, enriched, after)

    def ingest_pages(self, pages: DataFrame, patches: DataFrame | None = None) -> DataFrame:
        """Ingest landed portal responses; each is parsed once."""
        entries = store_entries(pages)
        completeness = run_completeness(page_stats(entries), self.settings)
        return self.ingest(normalize_pages(entries), completeness, patches)

    def images_due(self) -> DataFrame:
        """Photos to fetch and reduce to rasters before :meth:`hash`."""
        return pending_images(
            self.table("listings", LISTINGS),
            self.hashes(before=self.version),
            self.settings,
        )

    def hash(self, rasters: DataFrame) -> None:
        """Hash what is not hashed yet and append it to the log."""
        fresh = hash_images(rasters, self.hashes(before=self.version))
        append_run(fresh.select(*IMAGE_HASHES.names), self.root, "image_hashes", self.version)

    def bucket(self, areas: DataFrame) -> DataFrame:
        bucketed = assign_bucket(self.table("listings", LISTINGS), areas)
        write_table(bucketed, self.root, "bucketed", self.version)
        return bucket_summary(self.table("bucketed", LISTINGS))

    def dedupe(self) -> None:
        listings = self.table("bucketed", LISTINGS)
        hashes = self.hashes()
        components = cut_lineage(duplicate_components(listings, hashes, self.settings))
        write_table(build_clusters(listings, components), self.root, "clusters", self.version)
        write_table(assign_clusters(listings, components), self.root, "clustered", self.version)

    def score(self) -> DataFrame:
        """Scores of active listings; delisted ones keep the last they had."""
        listings = self.table("clustered", LISTINGS)
        scored = score(
            listings, self.history(), self.hashes(), self.run_ts, self.settings
        )
        last = self.before("scored", LISTINGS).select("id", *SCORE_COLUMNS)
        idle = listings.filter("not is_active").drop(*SCORE_COLUMNS).join(last, "id", "left")
        write_table(
            conform(scored, LISTINGS).unionByName(conform(idle, LISTINGS)),
            self.root,
            "scored",
            self.version,
        )
        return score_summary(self.table("scored", LISTINGS).filter("is_active"), self.settings)

    def feed(
        self, filters: feed_ops.FeedFilters, stations: DataFrame, places: DataFrame, exact: bool = True
    ) -> DataFrame:
        """One feed page over the newest scored tables."""
        return feed_ops.get_clusters(
            self.table("scored", LISTINGS),
            self.table("clusters", CLUSTERS),
            stations,
            places,
            filters,
            self.run_ts,
            self.settings,
            exact=exact,
        )

    def request(self, params: Mapping[str, Sequence[str]], stations: DataFrame, places: DataFrame) -> DataFrame:
        """The answer to a request with query parameters, over the newest scored tables."""
        return feed_ops.answer_request(
            params,
            self.table("scored", LISTINGS),
            self.table("clusters", CLUSTERS),
            stations,
            places,
            self.run_ts,
            self.settings,
        )
