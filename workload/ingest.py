"""Snapshots of two crawl runs derived from the orders, and their ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.operators import ingest as I
from listinglens.plans.nightly import Nightly
from listinglens.schemas import LISTINGS, RAW_LISTING, conform
from listinglens.session import scratch_path
from listinglens.sources.portals import union_sources
from listinglens.sources.tables import read_table, write_table
from listinglens.streaming.snapshots import (
    CLOSING,
    SNAPSHOT,
    read_closings,
    read_snapshots,
    start_stream,
    stream_ingest,
    stream_price_changes,
)
from workload import fixtures as X
from workload.base import block, query, staged

RUNS = {1: "2001-08-01 06:00:00", 2: "2001-08-02 06:00:00"}


def run_time(run: int):
    return F.lit(RUNS[run]).cast("timestamp")


def raw_run(spark, sf, run: int):
    """Adverts of one crawl: some listings appear, vanish, change, repeat within the run."""
    base = X.listings(spark, sf).filter("id % 10 <> 0" if run == 1 else "id % 10 <> 1")
    later = run == 2
    price = "price"
    if later:
        price = "case when id % 101 = 0 then null when id % 6 = 0 then price + 50000 else price end"
    fields = base.selectExpr(
        f"cast({run} as bigint) as run_id",
        "cast((id div 3) div 50 + 1 as int) as page_no",
        "cast(((id div 3) % 50) * 2 as int) as pos",
        "source",
        "source_id",
        ("case when id % 9 <> 0 then url end" if later else "url") + " as url",
        f"{price} as price",
        "case when id % 19 = 0 then 'recreational' when id % 23 <> 0 then property_kind end as property_kind",
        "usable_area_m2",
        "land_area_m2",
        "case when id % 47 = 0 then lat + 2D "
        + ("when id % 8 = 0 then null " if later else "")
        + "else lat end as lat",
        "lng",
        ("case when id % 5 = 0 then null when id % 4 = 0 then concat(locality_text, '!') else locality_text end"
         if later else "locality_text") + " as locality_text",
        "seller_type",
        "has_ico",
        "description",
        f"case when id % 12 <> 0 then array(concat('run{run}-', source_id)) end as photos",
        "case when id % 3 = 0 then array('NEW') end as labels",
        "id % 97 = 0 as _twice",
    )
    again = fields.filter("_twice").withColumns(
        {"pos": F.expr("pos + 1"), "price": F.expr("price + 1"), "labels": F.array(F.lit("AGAIN"))}
    )
    return conform(fields.unionByName(again), RAW_LISTING)


def raw_sql(run: int) -> str:
    later = run == 2
    price = "price"
    if later:
        price = "CASE WHEN id % 101 = 0 THEN NULL WHEN id % 6 = 0 THEN price + 50000 ELSE price END"
    url = "CASE WHEN id % 9 <> 0 THEN url END" if later else "url"
    lat = (
        "CASE WHEN id % 47 = 0 THEN lat + CAST(2 AS DOUBLE) "
        + ("WHEN id % 8 = 0 THEN NULL " if later else "")
        + "ELSE lat END"
    )
    place = (
        "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 4 = 0 THEN locality_text || '!' ELSE locality_text END"
        if later
        else "locality_text"
    )
    one = f"""SELECT {run} AS run_id, id AS oid, g // 50 + 1 AS page_no, (g % 50) * 2 AS pos, source, source_id,
      {url} AS url, {price} AS price,
      CASE WHEN id % 19 = 0 THEN 'recreational' WHEN id % 23 <> 0 THEN property_kind END AS property_kind,
      usable_area_m2, land_area_m2, {lat} AS lat, lng, {place} AS locality_text, seller_type, has_ico, description,
      CASE WHEN id % 12 <> 0 THEN 'run{run}-' || source_id ELSE '' END AS photos,
      CASE WHEN id % 3 = 0 THEN 'NEW' ELSE '' END AS labels
    FROM lst WHERE id % 10 <> {0 if run == 1 else 1}"""
    return f"""SELECT *, page_no * 1000 + pos AS ord FROM (
    SELECT * FROM ({one})
    UNION ALL
    SELECT * REPLACE (pos + 1 AS pos, price + 1 AS price, 'AGAIN' AS labels) FROM ({one}) WHERE oid % 97 = 0)"""


SCOPE_SQL = """property_kind IS DISTINCT FROM 'recreational'
    AND (lat IS NULL OR lng IS NULL OR (lat BETWEEN 49.4 AND 50.6 AND lng BETWEEN 13.4 AND 15.5))"""
COALESCED = ["price", "lat", "lng", "locality_text", "property_kind", "url"]
FIRST = ["usable_area_m2", "land_area_m2", "seller_type", "has_ico", "description", "labels"]

for number, time in RUNS.items():
    block(f"raw_{'ab'[number - 1]}", raw_sql(number))
    scoped = f"(SELECT * FROM raw_{'ab'[number - 1]} WHERE {SCOPE_SQL})"
    block(
        f"fold_{'ab'[number - 1]}",
        "SELECT source, source_id, "
        + ", ".join(f"arg_max({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in COALESCED)
        + ", arg_max(photos, ord) AS photos, "
        + ", ".join(f"arg_min_null({c}, ord) AS {c}" for c in FIRST)
        + f", min(ord) AS ord FROM {scoped} GROUP BY source, source_id",
    )

block(
    "state_a",
    f"""SELECT row_number() OVER (ORDER BY source, ord, source_id) AS id, * EXCLUDE (ord),
    '{RUNS[1]}' AS first_seen, '{RUNS[1]}' AS last_seen FROM fold_a""",
)
block(
    "fresh_b",
    f"""SELECT row_number() OVER (ORDER BY source, ord, source_id) + (SELECT max(id) FROM state_a) AS id,
    * EXCLUDE (ord), '{RUNS[2]}' AS first_seen, '{RUNS[2]}' AS last_seen
  FROM fold_b n WHERE NOT EXISTS (
    SELECT 1 FROM state_a s WHERE s.source = n.source AND s.source_id = n.source_id)""",
)
block(
    "state_b",
    "SELECT s.id, s.source, s.source_id, "
    + ", ".join(f"coalesce(n.{c}, s.{c}) AS {c}" for c in COALESCED)
    + ", CASE WHEN n.source IS NULL THEN s.photos ELSE n.photos END AS photos, "
    + ", ".join(f"s.{c}" for c in FIRST)
    + f""", s.first_seen, CASE WHEN n.source IS NULL THEN s.last_seen ELSE '{RUNS[2]}' END AS last_seen
  FROM state_a s LEFT JOIN fold_b n ON n.source = s.source AND n.source_id = s.source_id
  UNION ALL BY NAME SELECT * FROM fresh_b""",
)
STATE = """id, source, source_id, price, lat, lng, locality_text, property_kind, url, usable_area_m2,
    land_area_m2, seller_type, has_ico, description, photos, labels, first_seen, last_seen"""


def shown(listings, *more):
    return listings.select(
        "id",
        "source",
        "source_id",
        "price",
        "lat",
        "lng",
        "locality_text",
        "property_kind",
        "url",
        "usable_area_m2",
        "land_area_m2",
        "seller_type",
        "has_ico",
        "description",
        F.array_join("photos", ",").alias("photos"),
        F.array_join("labels", ",").alias("labels"),
        F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        *more,
    )


def empty_listings(spark):
    return spark.createDataFrame([], LISTINGS)


def after_first_run(spark, sf):
    return staged(
        spark,
        sf,
        "run1",
        lambda: I.upsert_listings(
            empty_listings(spark), raw_run(spark, sf, 1), run_time(1)
        ).listings,
    )


def second_run(spark, sf):
    return I.upsert_listings(after_first_run(spark, sf), raw_run(spark, sf, 2), run_time(2))


@query(
    "in_scope",
    f"SELECT run_id, source, source_id, page_no, pos FROM (FROM raw_a UNION ALL FROM raw_b) WHERE {SCOPE_SQL}",
)
def _(spark, sf):
    both = raw_run(spark, sf, 1).unionByName(raw_run(spark, sf, 2))
    return I.in_scope(both).select("run_id", "source", "source_id", "page_no", "pos")


@query(
    "union_sources",
    "SELECT source, source_id, page_no, pos, price FROM raw_a",
)
def _(spark, sf):
    rows = raw_run(spark, sf, 1).select("source", "source_id", "page_no", "pos", "price")
    parts = [rows.filter(F.col("source") == s) for s in ("alpha", "beta", "gamma")]
    return union_sources(*parts)


@query(
    "fold_batch",
    "SELECT source, source_id, price, lat, locality_text, url, photos, labels, usable_area_m2 FROM fold_b",
)
def _(spark, sf):
    folded = I.fold_batch(I.in_scope(raw_run(spark, sf, 2)))
    return folded.select(
        "source",
        "source_id",
        "price",
        "lat",
        "locality_text",
        "url",
        F.array_join("photos", ",").alias("photos"),
        F.array_join("labels", ",").alias("labels"),
        "usable_area_m2",
    )


@query("insert_listings", f"SELECT {STATE} FROM state_a")
def _(spark, sf):
    return shown(after_first_run(spark, sf))


@query("upsert_listings", f"SELECT {STATE} FROM state_b")
def _(spark, sf):
    return shown(second_run(spark, sf).listings)


def _step_sql(letter: str, stored: str | None) -> str:
    start = f"(SELECT price FROM {stored} s WHERE s.source = r.source AND s.source_id = r.source_id)"
    first = f"CASE WHEN lag(ord) OVER w IS NULL THEN {start} END" if stored else "NULL"
    return f"""SELECT source, source_id, run_id, page_no, pos, ord, price AS new_price,
      coalesce(lag(price) OVER w, {first}) AS old_price
    FROM (SELECT * FROM raw_{letter} WHERE {SCOPE_SQL} AND price IS NOT NULL) r
    WINDOW w AS (PARTITION BY source, source_id ORDER BY ord)"""


block("step_a", _step_sql("a", None))
block("step_b", _step_sql("b", "state_a"))
block(
    "change_b",
    "SELECT * FROM step_b WHERE new_price IS DISTINCT FROM old_price",
)


@query(
    "price_changes",
    "SELECT source, source_id, page_no, pos, old_price, new_price FROM change_b",
)
def _(spark, sf):
    changes = I.price_changes(after_first_run(spark, sf), I.in_scope(raw_run(spark, sf, 2)))
    return changes.select("source", "source_id", "page_no", "pos", "old_price", "new_price")


@query(
    "price_history_rows",
    f"""SELECT s.id AS listing_id, new_price AS price, '{RUNS[2]}' AS seen
       FROM change_b JOIN state_b s USING (source, source_id)""",
)
def _(spark, sf):
    return second_run(spark, sf).price_history.select(
        "listing_id", "price", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen")
    )


block(
    "request_b",
    f"""SELECT source, source_id, bool_or(is_new) AS is_new, count(*) AS requests FROM (
    SELECT r.source, r.source_id, s.id IS NULL AS is_new,
      s.id IS NULL AND row_number() OVER (PARTITION BY r.source, r.source_id ORDER BY r.ord) = 1 AS inserts,
      c.ord IS NOT NULL AS changed,
      CASE WHEN s.id IS NULL
        THEN first_value(r.usable_area_m2) OVER (PARTITION BY r.source, r.source_id ORDER BY r.ord)
        ELSE s.usable_area_m2 END AS area
    FROM (SELECT * FROM raw_b WHERE {SCOPE_SQL}) r
      LEFT JOIN state_a s ON s.source = r.source AND s.source_id = r.source_id
      LEFT JOIN change_b c ON c.source = r.source AND c.source_id = r.source_id AND c.ord = r.ord)
  WHERE inserts OR changed OR area IS NULL GROUP BY source, source_id""",
)


@query("enrich_candidates", "SELECT source, source_id, is_new, requests FROM request_b")
def _(spark, sf):
    return second_run(spark, sf).enrich_requests


def patches(spark, sf):
    """What the detail pages said: one row per order, many fields unresolved."""
    return X.listings(spark, sf).selectExpr(
        "source",
        "source_id",
        "case when id % 2 = 0 then concat('detail ', source_id) end as description",
        "case when id % 3 = 0 then cast(100 + id % 50 as int) end as usable_area_m2",
        "case when id % 40 = 0 then price + 7 end as price",
        "case when id % 4 = 0 then true end as has_ico",
    )


block(
    "patch",
    """SELECT source, source_id, CASE WHEN id % 2 = 0 THEN 'detail ' || source_id END AS description,
    CASE WHEN id % 3 = 0 THEN 100 + id % 50 END AS usable_area_m2,
    CASE WHEN id % 40 = 0 THEN price + 7 END AS price, CASE WHEN id % 4 = 0 THEN TRUE END AS has_ico
  FROM lst""",
)


@query(
    "apply_enrichment",
    """SELECT s.id, coalesce(p.price, s.price) AS price, coalesce(p.description, s.description) AS description,
         coalesce(p.usable_area_m2, s.usable_area_m2) AS usable_area_m2, coalesce(p.has_ico, s.has_ico) AS has_ico
       FROM state_b s LEFT JOIN (SELECT p.* FROM patch p JOIN request_b USING (source, source_id)) p
         ON p.source = s.source AND p.source_id = s.source_id""",
)
def _(spark, sf):
    result = second_run(spark, sf)
    wanted = patches(spark, sf).join(result.enrich_requests.select(*I.KEY), I.KEY, "left_semi")
    return I.apply_enrichment(result.listings, wanted).select(
        "id", "price", "description", "usable_area_m2", "has_ico"
    )


def completeness(spark, sf):
    """Per source, whether the run reached the end: told from the nations table."""
    return (
        X.table(spark, sf, "nation")
        .groupBy(
            F.expr("element_at(array('alpha', 'beta', 'gamma'), cast(n_nationkey % 3 + 1 as int)) as source")
        )
        .agg(F.expr("max(n_nationkey) % 2 = 0 as completed"))
    )


block(
    "complete",
    """SELECT CASE n_nationkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source,
    max(n_nationkey) % 2 = 0 AS completed FROM nation GROUP BY 1""",
)
block(
    "gone",
    f"SELECT id FROM state_b JOIN complete USING (source) WHERE completed AND last_seen < '{RUNS[2]}'",
)


@query("deactivate_missing", "SELECT id, id NOT IN (SELECT id FROM gone) AS is_active FROM state_b")
def _(spark, sf):
    listings = second_run(spark, sf).listings
    return I.deactivate_missing(listings, completeness(spark, sf), run_time(2)).select(
        "id", "is_active"
    )


@query(
    "ingest_summary",
    f"""SELECT seen, keys - known AS inserted, seen - keys + known AS updated, enriched, deactivated FROM (
         SELECT (SELECT count(*) FROM raw_b WHERE {SCOPE_SQL}) AS seen, (SELECT count(*) FROM fold_b) AS keys,
           (SELECT count(*) FROM fold_b JOIN state_a USING (source, source_id)) AS known,
           (SELECT CAST(sum(requests) AS BIGINT) FROM request_b JOIN patch USING (source, source_id)
            WHERE description IS NOT NULL OR usable_area_m2 IS NOT NULL OR price IS NOT NULL OR has_ico IS NOT NULL)
             AS enriched,
           (SELECT count(*) FROM gone) AS deactivated)""",
)
def _(spark, sf):
    result = second_run(spark, sf)
    patch = patches(spark, sf)
    listings = I.apply_enrichment(result.listings, patch)
    after = I.deactivate_missing(listings, completeness(spark, sf), run_time(2))
    return I.ingest_summary(result.counts, result.enrich_requests, patch, listings, after)


@query(
    "table_versions",
    "SELECT id, price, is_active FROM lst",
)
def _(spark, sf):
    """Two versions of a table are written; the reader sees the later one, whole."""
    root = scratch_path(spark, "tables")
    listings = X.listings(spark, sf).select("id", "price", "is_active", "source")
    write_table(listings.filter("is_active"), root, "listings", 1, partition_by=["source"])
    write_table(listings, root, "listings", 2, partition_by=["source"])
    return read_table(spark, root, "listings").select("id", "price", "is_active")


#: Order in which the parts of the runs land: run 1's last file comes after run 2 has begun.
LANDING = [(1, 0), (1, 1), (2, 0), (1, 2), (2, 1), (2, 2)]


def landed(spark, sf):
    """Both runs as snapshot files, three parts each, in order of landing, and their closings."""
    adverts, closed = scratch_path(spark, "snapshots"), scratch_path(spark, "closed")
    for place, (run, part) in enumerate(LANDING):
        rows = conform(raw_run(spark, sf, run).withColumn("run_ts", run_time(run)), SNAPSHOT)
        part_rows = rows.filter(F.pmod(F.hash("source_id", "pos"), F.lit(3)) == part)
        part_rows.repartition(2).write.mode("append").parquet(adverts)
        if run not in [r for r, _ in LANDING[place + 1 :]]:
            closing = completeness(spark, sf).withColumns({"run_id": F.lit(run), "run_ts": run_time(run)})
            conform(closing, CLOSING).coalesce(1).write.mode("append").parquet(closed)
    return adverts, closed


@query(
    "stream_ingest",
    f"SELECT {STATE}, id NOT IN (SELECT id FROM gone) AS is_active FROM state_b",
)
def _(spark, sf):
    root = scratch_path(spark, "stream")
    adverts, closed = landed(spark, sf)
    # Many files a trigger: the gate, not the pace, keeps runs apart.
    stream = stream_ingest(
        spark, adverts, closed, root, f"{root}/checkpoint", ["alpha", "beta", "gamma"], files_per_trigger=100
    )
    wait(stream)
    listings = read_table(spark, root, "listings", LISTINGS)
    return shown(listings, "is_active")


def wait(stream):
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query(
    "bucketed_upsert",
    f"SELECT {STATE}, id NOT IN (SELECT id FROM gone) AS is_active FROM state_b",
)
def _(spark, sf):
    """Both runs through the nightly ingest over a table in key buckets."""
    root = scratch_path(spark, "buckets")
    for run in RUNS:
        night = Nightly(spark, root, run, run_time(run))
        night.ingest(raw_run(spark, sf, run), completeness(spark, sf))
    return shown(night.listings.read(), "is_active")


@query(
    "stream_price_changes",
    """SELECT source, source_id, run_id, page_no, pos, old_price, new_price,
         CASE WHEN new_price > 0 AND old_price > new_price
           THEN round(CAST(old_price - new_price AS DOUBLE) / old_price * 100, 6) END AS drop_pct
       FROM (
         SELECT *, lag(price) OVER (PARTITION BY source, source_id ORDER BY run_id, ord) AS old_price, price AS new_price
         FROM (FROM raw_a UNION ALL FROM raw_b) WHERE price IS NOT NULL AND """
    + SCOPE_SQL
    + ") WHERE new_price IS DISTINCT FROM old_price",
)
def _(spark, sf):
    out = scratch_path(spark, "changes")
    adverts, closed = landed(spark, sf)
    changes = stream_price_changes(read_snapshots(spark, adverts, 4), read_closings(spark, closed))
    wait(start_stream(changes, out, f"{out}-checkpoint"))
    return spark.read.schema(changes.schema).parquet(out).withColumn("drop_pct", F.round("drop_pct", 6))
