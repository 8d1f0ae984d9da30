"""Stage behaviour: repeatability, versions, streams, completeness."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listinglens.operators import ingest as I
from listinglens.plans.nightly import Nightly
from listinglens.schemas import LISTINGS, PRICE_HISTORY, conform
from listinglens.session import scratch_path
from listinglens.sources.portals import normalize_pages, page_stats, run_completeness, store_entries
from listinglens.sources.tables import (
    BucketedTable,
    append_run,
    bucket_parts,
    current_version,
    read_log,
    read_table,
    write_table,
)
from listinglens.streaming.snapshots import (
    CLOSING,
    PRICE_CHANGE,
    SNAPSHOT,
    PriceSteps,
    late_adverts,
    read_closings,
    read_snapshots,
    start_stream,
    stream_ingest,
    stream_price_changes,
)
from workload import fixtures as X
from workload import ingest as W

SF = "/root/testdata/sf0.001"


def test_upsert_twice_changes_nothing(spark):
    first = W.after_first_run(spark, SF)
    again = I.upsert_listings(first, W.raw_run(spark, SF, 1), W.run_time(1))
    # In-run repeats end on the same price, so only those steps are logged again.
    assert W.shown(again.listings).exceptAll(W.shown(first)).count() == 0
    assert again.counts.first()["inserted"] == 0


def test_readers_see_only_finished_versions(spark):
    root = scratch_path(spark, "t")
    write_table(spark.range(3), root, "t", 1)
    spark.range(9).write.parquet(f"{root}/t/data/version=2")  # never logged
    assert read_table(spark, root, "t").count() == 3
    write_table(spark.range(5), root, "t", 2)
    assert read_table(spark, root, "t").count() == 5
    assert read_table(spark, root, "t", before=2).count() == 3


def _files(root):
    from pathlib import Path

    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("part-*.parquet") if "/data/" in str(p)}


def test_upsert_leaves_untouched_buckets_alone(spark):
    """A small run writes only the buckets of its keys; older versions stay readable."""
    root = scratch_path(spark, "buckets")
    none = spark.createDataFrame([], "source string, completed boolean")
    Nightly(spark, root, 1, W.run_time(1)).ingest(W.raw_run(spark, SF, 1), none)
    before = _files(root)
    store = Nightly(spark, root, 2, W.run_time(2)).listings
    few = I.in_scope(W.raw_run(spark, SF, 2)).orderBy("source_id").limit(3)
    touched = store.touched(few)
    assert 0 < len(touched) <= 3 < len(bucket_parts(spark, root, "listings", 1))
    Nightly(spark, root, 2, W.run_time(2)).ingest(few, none)
    after = _files(root)
    assert before.items() <= after.items()
    parts = bucket_parts(spark, root, "listings", 2)
    written = {b for b, v in parts.items() if v == 2}
    assert written and written <= touched
    assert {int(str(p).split("_b=")[1].split("/")[0]) for p in after.keys() - before.keys()} == written
    want = W.shown(I.upsert_listings(store.read(version=1), few, W.run_time(2)).listings).collect()
    assert sorted(W.shown(store.read()).collect(), key=str) == sorted(want, key=str)
    assert store.read(version=1).count() == W.after_first_run(spark, SF).count()
    assert store.expire(2) == len(written & bucket_parts(spark, root, "listings", 2).keys())
    assert sorted(W.shown(store.read()).collect(), key=str) == sorted(want, key=str)


def test_small_run_deactivates_in_other_buckets(spark):
    """A complete run of few adverts reaches the buckets of what it no longer shows."""
    root = scratch_path(spark, "buckets")
    none = spark.createDataFrame([], "source string, completed boolean")
    done = spark.createDataFrame([("alpha", True)], "source string, completed boolean")
    Nightly(spark, root, 1, W.run_time(1)).ingest(W.raw_run(spark, SF, 1), none)
    few = W.raw_run(spark, SF, 1).filter("source = 'alpha'").orderBy("source_id").limit(5)
    night = Nightly(spark, root, 2, W.run_time(2))
    summary = night.ingest(few, done).first()
    rows = night.listings.read()
    active = {r["source"]: r["n"] for r in rows.filter("is_active").groupBy("source").agg(F.count("*").alias("n")).collect()}
    seen = I.in_scope(few).select("source_id").distinct().count()
    every = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert active["alpha"] == seen and active["beta"] == every["beta"]
    assert summary["deactivated"] == every["alpha"] - seen


def test_prices_of_a_failed_run_do_not_show(spark):
    root = scratch_path(spark, "failed")
    night = Nightly(spark, root, 1, W.run_time(1))
    rows = spark.createDataFrame([(1, 100, None)], PRICE_HISTORY)
    append_run(rows, root, "price_history", 1)
    assert night.history().count() == 0
    write_table(spark.createDataFrame([], LISTINGS), root, "listings", 1)
    assert night.history().count() == 1


def test_version_written_again_replaces_itself(spark):
    schema = "source string, source_id string, n int"
    rows = spark.createDataFrame([("a", str(i), i) for i in range(50)], schema)
    store = BucketedTable(spark, scratch_path(spark, "again"), "t", rows.schema, buckets=8)
    store.write(rows, 1)
    one = rows.filter("n = 7")
    touched = store.touched(one)
    part = store.read(version=1, buckets=touched)
    for value in (100, 200):
        store.write(part.withColumn("n", F.when(F.col("n") == 7, value).otherwise(F.col("n"))), 2, touched)
    assert store.read().agg(F.sum("n")).first()[0] == sum(range(50)) - 7 + 200
    assert store.read(version=1).agg(F.sum("n")).first()[0] == sum(range(50))
    store.write(rows.limit(0), 3, range(8))
    assert store.read().count() == 0


def test_first_page_number_of_each_portal(spark):
    rows = [
        (1, "bezrealitky", "all", 0, False, 100, 150),
        (1, "bezrealitky", "all", 1, False, 50, 150),
        (2, "bezrealitky", "all", 1, False, 100, 150),
        (2, "bezrealitky", "all", 2, False, 50, 150),
        (3, "sreality", "10", 1, False, 100, 150),
        (3, "sreality", "10", 2, False, 50, 150),
        (4, "sreality", "10", 2, False, 50, 50),
    ]
    stats = spark.createDataFrame(
        rows, "run_id long, source string, region string, page_no int, failed boolean, n long, total long"
    )
    got = {r["run_id"]: r["completed"] for r in run_completeness(stats).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_pages_are_scanned_once(spark):
    """The upsert's plans read the stored run, not the pages."""
    from workload import portals as WP

    path = scratch_path(spark, "pages")
    WP.all_pages(spark, SF).write.parquet(path)
    entries = store_entries(spark.read.parquet(path))
    rows, stats = normalize_pages(entries), page_stats(entries)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (rows, stats)]
    assert all("payload" not in plan for plan in plans)
    whole = normalize_pages(spark.read.parquet(path))
    assert rows.exceptAll(whole).count() == 0 and rows.count() == whole.count()
    assert stats.exceptAll(page_stats(spark.read.parquet(path))).count() == 0


def test_append_run_is_idempotent(spark):
    root, rows = scratch_path(spark, "log"), spark.range(4)
    for _ in range(2):
        append_run(rows, root, "h", 1)
    append_run(rows, root, "h", 2)
    assert read_log(spark, root, "h", rows.schema).count() == 8


SOURCES = ["alpha", "beta", "gamma"]


def land(spark, folder, run, part=None, of=3):
    rows = conform(W.raw_run(spark, SF, run).withColumn("run_ts", W.run_time(run)), SNAPSHOT)
    if part is not None:
        rows = rows.filter(F.pmod(F.hash("source_id", "pos"), F.lit(of)) == part)
    rows.repartition(1).write.mode("append").parquet(folder)


def close(spark, folder, run, sources=SOURCES, completed=True):
    ts = spark.range(1).select(W.run_time(run)).first()[0]
    rows = [(run, ts, source, completed) for source in sources]
    spark.createDataFrame(rows, CLOSING).repartition(1).write.mode("append").parquet(folder)


def test_runs_wait_until_they_are_closed(spark):
    """Files in any order and in several triggers; a version appears only for a closed run."""
    root, raw, closed = (scratch_path(spark, n) for n in ("stream", "raw", "closed"))

    def go():
        W.wait(stream_ingest(spark, raw, closed, root, f"{root}/checkpoint", SOURCES, files_per_trigger=1))
        return current_version(spark, root, "listings")

    land(spark, raw, 1, 0)
    land(spark, raw, 2, 0)
    close(spark, closed, 2)  # run 2 is through first, but run 1 comes before it
    assert go() is None
    land(spark, raw, 1, 1)
    close(spark, closed, 1, ["alpha", "beta"])
    assert go() is None
    land(spark, raw, 1, 2)
    land(spark, raw, 2, 1)
    land(spark, raw, 2, 2)
    assert go() is None
    close(spark, closed, 1, ["gamma"])
    assert go() == 2
    for version in (1, 2):
        listings = read_table(spark, root, "listings", LISTINGS, version=version)
        assert listings.filter(~F.col("is_active") & (F.col("last_seen_at") == W.run_time(version))).count() == 0
    streamed = W.shown(read_table(spark, root, "listings", LISTINGS))
    batch = W.shown(W.second_run(spark, SF).listings)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert late_adverts(spark, root).count() == 0
    land(spark, raw, 2, 0, of=50)
    assert go() == 2
    late = late_adverts(spark, root)
    assert late.count() > 0 and {r["run_id"] for r in late.select("run_id").distinct().collect()} == {2}


def test_price_steps_wait_for_their_run(spark):
    """A file of run 1 that lands after run 2 began changes nothing; one that lands after the closing is left out."""
    raw, closed, out = (scratch_path(spark, n) for n in ("raw", "closed", "changes"))

    def go():
        changes = stream_price_changes(read_snapshots(spark, raw, 100), read_closings(spark, closed, 100))
        W.wait(start_stream(changes, out, f"{out}-checkpoint"))
        return spark.read.schema(PRICE_CHANGE).parquet(out)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    land(spark, raw, 1, 0)
    land(spark, raw, 2, 0)
    assert go().count() == 0
    land(spark, raw, 1, 1)
    land(spark, raw, 1, 2)
    close(spark, closed, 1)
    first = I.price_changes(W.empty_listings(spark), I.in_scope(W.raw_run(spark, SF, 1)))
    assert go().count() == first.count() > 0
    land(spark, raw, 2, 1)
    land(spark, raw, 2, 2)
    close(spark, closed, 2)
    second = I.price_changes(W.after_first_run(spark, SF), I.in_scope(W.raw_run(spark, SF, 2)))
    got = go()
    columns = ["source", "source_id", "run_id", "page_no", "pos", "old_price", "new_price"]
    want = first.withColumn("run_id", F.lit(1)).unionByName(second.withColumn("run_id", F.lit(2))).select(
        *[F.col(c).cast(got.schema[c].dataType) for c in columns]
    )
    assert got.select(columns).exceptAll(want).count() == 0 and got.count() == want.count()
    land(spark, raw, 1, 0, of=50)
    assert go().count() == want.count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_listings_of_a_group_share_calls_to_the_state():
    """Many listings, as many calls as one; adverts without a place come first."""
    calls = []

    class Held:
        def __init__(self, schema):
            self.rows = []

        def get(self):
            calls.append("get")
            return list(self.rows) if self.many else (self.rows[0] if self.rows else None)

        def appendValue(self, row):
            calls.append("append")
            self.rows.append(row)

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

        def update(self, row):
            self.put([row])

        def clear(self):
            self.put([])

    class Handle:
        def getListState(self, name, schema):
            held = Held(schema)
            held.many = True
            return held

        def getValueState(self, name, schema):
            held = Held(schema)
            held.many = False
            return held

        def registerTimer(self, at):
            calls.append("timer")

    class Expired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    steps = PriceSteps()
    steps.init(Handle())
    many = 500
    ids = [str(i) for i in range(many)]
    first = pd.DataFrame({"source": "alpha", "source_id": ids, "run_id": 1, "page_no": 1, "pos": 0, "price": 1000, "at": 10})
    again = first.assign(page_no=None, price=900)
    second = first.assign(run_id=2, price=800, at=20)
    assert list(steps.handleInputRows((3,), iter([first, again, second]), None)) == []
    (one,) = steps.handleExpiredTimer((3,), None, Expired(10))
    (two,) = steps.handleExpiredTimer((3,), None, Expired(20))
    assert list(steps.handleExpiredTimer((3,), None, Expired(20))) == []
    assert len(calls) < 20
    pick = one[one["source_id"] == "7"][["run_id", "page_no", "old_price", "new_price"]].values.tolist()
    assert pick == [[1, None, None, 900], [1, 1, 900, 1000]] and len(one) == 2 * many
    assert sorted(two["source_id"]) == sorted(ids) and set(two["drop_pct"]) == {20.0}


@pytest.mark.parametrize("strict, want", [(False, False), (True, True)])
def test_failed_page_of_the_html_portal(spark, strict, want):
    stats = spark.createDataFrame(
        [(1, "ceskereality", "all", 1, False, 60, None), (1, "ceskereality", "all", 2, True, 0, None)],
        "run_id long, source string, region string, page_no int, failed boolean, n long, total long",
    )
    assert run_completeness(stats, strict=strict).first()["completed"] is want


def test_page_cap_is_incomplete(spark):
    stats = spark.createDataFrame(
        [
            (1, "sreality", "10", 40, False, 100, 5000),
            (1, "sreality", "11", 3, False, 10, 210),
            *[(2, "sreality", "10", p, False, 100, 5000) for p in range(1, 51)],
            # The last page came, the second never landed.
            (3, "sreality", "10", 1, False, 100, 300),
            (3, "sreality", "10", 3, False, 100, 300),
            (1, "bezrealitky", "all", 2, False, 0, 900),
        ],
        "run_id long, source string, region string, page_no int, failed boolean, n long, total long",
    )
    got = {(r["run_id"], r["source"]): r["completed"] for r in run_completeness(stats).collect()}
    assert got == {
        (1, "sreality"): False,
        (2, "sreality"): True,
        (3, "sreality"): False,
        (1, "bezrealitky"): False,
    }


def test_absent_region_is_incomplete(spark):
    stats = spark.createDataFrame(
        [(1, "sreality", "10", 1, False, 7, 7), (1, "bezrealitky", "all", 1, False, 3, 3)],
        "run_id long, source string, region string, page_no int, failed boolean, n long, total long",
    )
    wanted = [("sreality", "10"), ("sreality", "11"), ("bezrealitky", "all")]
    got = {r["source"]: r["completed"] for r in run_completeness(stats, expected=wanted).collect()}
    assert got == {"sreality": False, "bezrealitky": True}


def test_a_page_landed_twice_does_not_stand_for_another(spark):
    stats = spark.createDataFrame(
        [
            (1, "bezrealitky", "all", 1, False, 3, 6),
            (1, "bezrealitky", "all", 1, False, 3, 6),
            # Different pages that brought all there is, whatever their numbers.
            (2, "bezrealitky", "all", 1, False, 3, 6),
            (2, "bezrealitky", "all", 3, False, 3, 6),
            (3, "bezrealitky", "all", 1, True, 6, 6),
            (4, "bezrealitky", "all", 1, False, 0, 0),
        ],
        "run_id long, source string, region string, page_no int, failed boolean, n long, total long",
    )
    got = {r["run_id"]: r["completed"] for r in run_completeness(stats).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_odd_numbers_do_not_stop_a_run(spark):
    from listinglens.operators.scoring import price_metrics

    df = spark.createDataFrame([(99_999_999_999_999, 1, 10), (900, 3, None)], "price long, usable_area_m2 int, land_area_m2 int")
    rows = price_metrics(df).collect()
    assert [r["price_per_usable_m2"] for r in rows] == [None, 300]


def test_one_hash_for_each_position(spark):
    from listinglens.operators.images import hash_images

    px = list(range(72))
    rows = [(1, 0, "b", px), (1, 0, "a", px[::-1]), (1, 1, "a", px)]
    df = spark.createDataFrame(rows, "listing_id long, position int, url string, px array<int>")
    got = sorted((r["listing_id"], r["position"], r["url"]) for r in hash_images(df).collect())
    assert got == [(1, 0, "a"), (1, 1, "a")]


def test_cluster_without_shared_folder_raises():
    from types import SimpleNamespace

    import pytest

    from listinglens.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError):
        shared_dir(session)


def test_scan_prunes_and_pushes_down(spark):
    from listinglens.sources.tables import scan_active

    path = scratch_path(spark, "listings")
    X.listings(spark, SF).write.parquet(path)
    df = scan_active(spark.read.parquet(path), "id", "price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(is_active), EqualTo(is_active,true)]" in plan
    assert "description" not in plan


def test_enrichment_keeps_unresolved_fields(spark):
    listings = W.after_first_run(spark, SF)
    patch = listings.limit(5).select(
        *I.KEY, F.lit(None).cast("string").alias("description"), F.lit(77).alias("usable_area_m2")
    )
    out = I.apply_enrichment(listings, patch)
    assert out.filter("usable_area_m2 = 77").count() >= 5
    assert out.filter("description is null").count() == listings.filter("description is null").count()


def test_nightly_run_from_payloads(spark):
    """Landed pages to a feed page; the second night changes nothing but the clock."""
    from listinglens.operators.feed import FeedFilters
    from listinglens.sources.portals import normalize_detail_json
    from workload import portals as WP

    root = scratch_path(spark, "nightly")
    pages = WP.all_pages(spark, SF)
    details = WP._rows(spark, SF).selectExpr(
        "'sreality' as source", "cast(id as string) as source_id", WP.DETAIL_ITEM
    )
    patches = normalize_detail_json(details)
    summaries = []
    for version, day in ((1, "2001-08-01"), (2, "2001-08-02")):
        run = Nightly(spark, root, version, F.lit(day).cast("timestamp"))
        summaries.append(run.ingest_pages(pages, patches).first().asDict())
        due = run.images_due()
        rasters = due.select(
            "listing_id",
            "position",
            "url",
            F.transform(
                F.sequence(F.lit(0), F.lit(71)), lambda i: F.pmod(F.hash("url", i), F.lit(256))
            ).alias("px"),
        )
        run.hash(rasters)
        run.bucket(X.areas(spark, SF))
        run.dedupe()
        run.score()
    first, second = summaries
    assert first["inserted"] == first["seen"] > 0 and first["deactivated"] == 0
    assert second["inserted"] == 0 and second["updated"] == second["seen"] == first["seen"]
    assert due.count() == 0
    page = run.feed(FeedFilters(limit=20), X.stations(spark, SF), X.places(spark, SF)).collect()
    assert [r["position"] for r in page] == list(range(1, len(page) + 1)) and page
    assert all(r["member_count"] == len(r["members"]) for r in page)


def test_delisted_listings_keep_their_scores(spark):
    root = scratch_path(spark, "delisted")
    nights = [Nightly(spark, root, v, F.lit(f"2001-08-0{v}").cast("timestamp")) for v in (1, 2)]
    for night in nights:
        listings = X.listings(spark, SF).withColumn("is_active", F.lit(night.version == 1) | (F.col("id") % 3 > 0))
        write_table(listings, root, "listings", night.version)
        append_run(X.image_hashes(spark, SF), root, "image_hashes", 1)
        append_run(X.price_history(spark, SF), root, "price_history", 1)
        night.bucket(X.areas(spark, SF))
        night.dedupe()
        night.score()
    columns = ["id", "bucket_key", "percentile", "scam_score", "scored_at"]
    first, second = (read_table(spark, root, "scored", version=v).select(columns) for v in (1, 2))
    gone = F.col("id") % 3 == 0
    assert sorted(first.filter(gone).collect(), key=str) == sorted(second.filter(gone).collect(), key=str)
    assert first.filter(gone & F.col("scored_at").isNotNull()).count() > 0
    assert second.filter(~gone).agg(F.min("scored_at")).first()[0] > first.agg(F.max("scored_at")).first()[0]


def _shuffles_of(df, column):
    """How many shuffles of the plan carry ``column``."""
    steps = _explained(df).split("\n\n")
    return sum("Exchange" in s.split("\n")[0] and f"{column}#" in s for s in steps)


def _explained(df):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _stored(spark, df, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_scoring_shuffles_whole_listings_once(spark, no_broadcasts):
    from listinglens.operators.scoring import max_price_by_listing, score_signals

    homes = _stored(spark, X.housed(X.bucketed(spark, SF)), "homes")
    history = _stored(spark, X.price_history(spark, SF), "history")
    stolen = homes.filter("id % 10 = 0").select(F.col("id").alias("listing_id"))
    scored = score_signals(homes, max_price_by_listing(history), stolen, X.run_ts())
    assert _shuffles_of(scored, "photos") == 1
    assert scored.count() == homes.filter("is_active").count() > 0


def test_whole_rows_are_dealt_in_bounded_parts(spark, monkeypatch):
    from listinglens.operators import skew

    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    dealt = skew.by_key(spark.range(2_000), "id")
    assert dealt.rdd.getNumPartitions() == 20
    assert skew.by_key(spark.range(10), "id").rdd.getNumPartitions() == 4


def test_feed_pages_are_found_without_whole_listings(spark, no_broadcasts, monkeypatch):
    from listinglens.operators import feed
    from listinglens.operators.duplicates import build_clusters

    homes = _stored(spark, X.scored_houses(spark, SF), "scored")
    clusters = _stored(
        spark, build_clusters(homes, homes.select("id", F.col("cluster_id").alias("component"))), "clusters"
    )
    stations, places, kept = X.stations(spark, SF), X.places(spark, SF), []
    cut = feed.cut_lineage
    monkeypatch.setattr(feed, "cut_lineage", lambda df: (kept.append(_shuffles_of(df, "photos")), cut(df))[1])
    for filters in (feed.FeedFilters(limit=7), feed.FeedFilters(limit=7, sort="train", max_prague_km=60.0)):
        kept.clear()
        page = feed.get_clusters(homes, clusters, stations, places, filters, X.run_ts()).collect()
        assert [r["position"] for r in page] == list(range(1, 8))
        # The last frame kept is the page itself; what leads to it has no whole listings.
        assert len(kept) > 1 and not any(kept[:-1])


def test_prices_are_ranked_in_the_bucket_they_take_only(spark):
    from listinglens.operators.percentile import chosen_buckets, price_cells, price_histogram

    rows = [("A", "s", v) for v in range(8)] + [("B", "s", 1), ("", None, 5)]
    samples = spark.createDataFrame(rows, "cadastral_code string, size_band string, price_per_usable_m2 int")
    cells = price_cells(samples)
    chosen = chosen_buckets(cells).select("level", "key")
    assert {tuple(r) for r in chosen.collect()} == {(1, "A|s"), (3, "band:s"), (4, "all")}
    histogram = price_histogram(cells, chosen.distinct())
    # Whole buckets: the wider ones still count the prices of listings that have one of their own.
    totals = {(r["level"], r["key"]): r["total"] for r in histogram.collect()}
    assert totals == {(1, "A|s"): 8, (3, "band:s"): 9, (4, "all"): 10}
