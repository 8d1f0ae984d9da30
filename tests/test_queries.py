"""Registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from workload.check import TABLES, compare

SF = "/root/testdata/sf0.001"
# The quick ones; ``python -m workload.check`` runs all of them at a larger scale.
QUICK = [
    "size_band",
    "assign_area",
    "bucket_percentile",
    "bucket_stats",
    "mid_rank_percentile",
    "red_phrase",
    "scam_flags",
    "deal_reasons",
    "nearest_station",
    "hash_images",
    "pending_images",
    "dedupe_candidates",
    "build_clusters",
    "feed_newest",
    "feed_filtered",
    "facet_counts",
    "fold_triage",
    "feed_counts",
    "price_changes",
    "upsert_listings",
    "enrich_candidates",
    "ingest_summary",
    "normalize_search_json",
    "normalize_adverts_json",
    "normalize_search_html",
    "normalize_detail_html",
    "run_completeness",
    "load_areas",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, name, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_every_listing_query_has_sql():
    from workload.base import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
