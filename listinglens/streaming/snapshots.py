"""Streams over landed listing snapshots, run by run.

A crawl lands its adverts in any number of files and, when it is through, one
completeness row per portal. Files may come late and runs may overlap, so
nothing that depends on the order of a listing's adverts is decided before the
run is closed:

* :func:`stream_ingest` keeps the adverts of open runs in a landing log and
  applies a run, in order of run_id, once its completeness has landed. A run is
  one version of the table.
* :func:`stream_price_changes` holds the adverts of open runs in keyed state.
  The rows that close a run move the watermark past it, upon which a timer of
  each group of listings gives that run's price steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from listinglens.operators.ingest import KEY, deactivate_missing, in_scope, upsert_listings
from listinglens.schemas import LISTINGS, RAW_LISTING, TIME
from listinglens.settings import DEFAULTS, Settings
from listinglens.sources.tables import append_run, current_version, read_table, write_table

SNAPSHOT = T.StructType([*RAW_LISTING.fields, T.StructField("run_ts", TIME, True)])
#: Landed when a portal's pass of a run is over.
CLOSING = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("run_ts", TIME),
        T.StructField("source", T.StringType()),
        T.StructField("completed", T.BooleanType()),
    ]
)
#: A run whose closing never lands is closed by adverts this much younger.
PATIENCE = "3 days"

PRICE_CHANGE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("page_no", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("old_price", T.LongType()),
        T.StructField("new_price", T.LongType()),
        T.StructField("drop_pct", T.DoubleType()),
    ]
)
PLACE = ["run_id", "page_no", "pos"]
#: Adverts of a batch, and listings with the price last given out: one row of arrays a group.
ADVERTS = """source array<string>, source_id array<string>, run_id array<long>, page_no array<long>, pos array<long>,
    price array<long>, at array<long>"""
GIVEN = "source array<string>, source_id array<string>, price array<long>"
#: Groups that listings are held in. Stored streams have it in their state: do not change it.
GROUPS = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_snapshots(spark: SparkSession, raw_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed snapshot files as a stream, oldest first."""
    return _landed(spark, raw_dir, SNAPSHOT, files_per_trigger)


def read_closings(spark: SparkSession, closed_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed completeness rows as a stream, oldest first."""
    return _landed(spark, closed_dir, CLOSING, files_per_trigger)


def _landed(spark: SparkSession, path: str, schema: T.StructType, files: int) -> DataFrame:
    # Nothing may have landed yet; a stream wants its folder to be there.
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


# --- ingest ----------------------------------------------------------------


def _read_landing(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All that has landed, with the batch it came in."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(full).parquet(f"{root}/landing")
    except AnalysisException:
        return spark.createDataFrame([], full)


def _landing_schema() -> T.StructType:
    return T.StructType([*SNAPSHOT.fields, CLOSING["completed"]])


def closed_runs(spark: SparkSession, root: str, sources: Sequence[str]) -> list[int]:
    """Runs to apply now, in order: closed, not yet a version, with no open run before them."""
    landed = _read_landing(spark, root, _landing_schema())
    applied = current_version(spark, root, "listings")
    gate = F.countDistinct(F.when(F.col("completed").isNotNull() & F.col("source").isin(list(sources)), F.col("source")))
    runs = landed.groupBy("run_id").agg(gate.alias("gates"))
    if applied is not None:
        runs = runs.filter(F.col("run_id") > applied)
    ready = []
    for run in runs.orderBy("run_id").collect():  # the few crawls since the last version
        if run["gates"] < len(sources):
            break
        ready.append(run["run_id"])
    return ready


def late_adverts(spark: SparkSession, root: str) -> DataFrame:
    """Adverts that landed after their run had been applied; they are kept, not applied."""
    schema = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("last_batch", T.LongType())])
    try:
        applied = spark.read.schema(schema).parquet(f"{root}/applied")
    except AnalysisException:
        applied = spark.createDataFrame([], schema)
    landed = _read_landing(spark, root, _landing_schema()).filter("completed IS NULL")
    return landed.join(applied, "run_id").filter("batch > last_batch").drop("last_batch", "completed")


def _apply_run(spark: SparkSession, root: str, run_id: int, batch_id: int, settings: Settings) -> None:
    landed = _read_landing(spark, root, _landing_schema()).filter(F.col("run_id") == run_id)
    closing = landed.filter("completed IS NOT NULL")
    run_ts = F.lit(closing.agg(F.min("run_ts")).first()[0])
    completeness = closing.groupBy("source").agg(F.bool_and("completed").alias("completed"))
    current = read_table(spark, root, "listings", LISTINGS, before=run_id)
    result = upsert_listings(current, landed.filter("completed IS NULL"), run_ts, settings)
    listings = deactivate_missing(result.listings, completeness, run_ts)
    append_run(result.price_history, root, "price_history", run_id)
    applied = spark.createDataFrame([(batch_id,)], "last_batch long")
    append_run(applied, root, "applied", run_id)
    write_table(listings, root, "listings", run_id)


def stream_ingest(
    spark: SparkSession,
    raw_dir: str,
    closed_dir: str,
    root: str,
    checkpoint: str,
    sources: Sequence[str],
    settings: Settings = DEFAULTS,
    files_per_trigger: int = 1,
) -> StreamingQuery:
    """Upsert each landed run into the ``listings`` table below ``root``, once it is closed.

    A run is closed when a completeness row of each of ``sources`` has landed in
    ``closed_dir``. Until then its adverts wait in the landing log, and so do
    those of later runs. The version number is the run_id: a batch repeated
    after a failure rewrites its part of the log and applies what is left to
    apply, so no run is applied twice and no version shows a part of a run.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("run_id").parquet(f"{root}/landing/batch={batch_id}")
        for run_id in closed_runs(spark, root, sources):
            _apply_run(spark, root, run_id, batch_id, settings)

    adverts = read_snapshots(spark, raw_dir, files_per_trigger)
    closings = read_closings(spark, closed_dir, files_per_trigger)
    return (
        adverts.unionByName(closings, allowMissingColumns=True)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- price changes ---------------------------------------------------------


def _whole(column: pd.Series) -> list[int | None]:
    """Numbers of a column; pandas turns them into floats where some are missing."""
    if column.dtype.kind == "i":
        return column.tolist()
    return [None if pd.isna(x) else int(x) for x in column.tolist()]


def _in_order(advert: tuple) -> list[tuple[bool, int]]:
    return [(x is not None, x or 0) for x in advert]


class PriceSteps(StatefulProcessor):
    """The price steps of a group of listings.

    State: the adverts of open runs, as they came, and of each listing the price
    last given out. Adverts are put in order when the watermark passes their run.
    Each call to the state is a round trip to the JVM and each row of it is
    pickled by itself, so the listings of a group share both.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.adverts = handle.getListState("adverts", ADVERTS)
        self.given = handle.getValueState("given", GIVEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] >= 0:  # closings only move the watermark
            ats = set()
            for part in rows:
                at = part["at"].tolist()
                ats.update(at)
                numbers = [_whole(part[c]) for c in (*PLACE, "price")]
                self.adverts.appendValue((*[part[c].tolist() for c in KEY], *numbers, at))
            for at in ats:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = expiredTimerInfo.getExpiryTimeInMs()
        due: dict[tuple, list[tuple]] = {}
        still = []
        for held in self.adverts.get():
            for advert in zip(*held, strict=True):
                if advert[6] <= closed:
                    due.setdefault(advert[:2], []).append(advert[2:6])
                else:
                    still.append(advert)
        if not due:
            return
        before = self.given.get() or ((), (), ())
        given = dict(zip(zip(before[0], before[1], strict=True), before[2], strict=True))
        steps = []
        for listing, adverts in due.items():
            old = given.get(listing)
            for run_id, page_no, pos, price in sorted(adverts, key=_in_order):
                if price != old:
                    drop = (old - price) / old * 100.0 if old is not None and 0 < price < old else None
                    steps.append((*listing, run_id, page_no, pos, old, price, drop))
                old = price
            given[listing] = old
        self.given.update(([k[0] for k in given], [k[1] for k in given], list(given.values())))
        if still:
            self.adverts.put([tuple(map(list, zip(*still, strict=True)))])
        else:
            self.adverts.clear()
        if steps:
            columns = zip(PRICE_CHANGE.names, zip(*steps, strict=True), strict=True)
            # Whole numbers stay whole beside missing ones.
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns})

    def close(self) -> None:
        pass


def stream_price_changes(
    snapshots: DataFrame,
    closings: DataFrame | None = None,
    patience: str = PATIENCE,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Price changes of a snapshot stream: first prices and every step, run by run.

    A run's steps come out when it is closed: by its row in ``closings`` (run_id,
    run_ts), or by adverts of a run ``patience`` younger. Until then its files
    may land in any order, also after those of later runs. Adverts that land
    after their run was closed are late in Spark's sense: they are left out and
    counted in the query's ``numRowsDroppedByWatermark``. Runs must not share a
    ``run_ts``. Start the result with :func:`start_stream`.
    """
    adverts = in_scope(snapshots, settings).filter(F.col("price").isNotNull()).select(
        *KEY,
        *[F.col(c).cast("long").alias(c) for c in PLACE],
        "price",
        "run_ts",
        F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)).cast("int").alias("listings"),
    )
    if closings is not None:
        # A second past the run, after the patience is taken off.
        past = F.col("run_ts") + F.expr(f"INTERVAL {patience}") + F.expr("INTERVAL 1 SECOND")
        ends = closings.select(past.alias("run_ts"), F.lit(-1).alias("listings"))
        adverts = adverts.unionByName(ends, allowMissingColumns=True)
    keyed = adverts.withWatermark("run_ts", patience).withColumn("at", F.unix_millis("run_ts"))
    return keyed.groupBy("listings").transformWithStateInPandas(PriceSteps(), PRICE_CHANGE, "append", "eventTime")


def start_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Start ``stream`` into Parquet files, with its state in RocksDB.

    A query copies the session's settings when it starts; the session's own
    provider is set back at once.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)
    try:
        return (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(name, before)
