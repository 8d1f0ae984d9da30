"""Registry of this subpackage's queries and small helpers its operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglens import session
from listinglens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Most bytes that are ever broadcast; above it a join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows that a Python worker gets at a time.
BATCH_ROWS = 1000


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent for the SQL check."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage with a columnar, replicated-by-the-store copy that
    outlives any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames that :func:`stored` returned.

    Also lets the driver collect what it no longer refers to, upon which Spark
    drops the shuffle files of the finished steps.
    """
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    frames[0].sparkSession._jvm.System.gc()


def broadcast_within(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` if its measured bytes are at most ``limit``.

    ``row_bytes`` is the size of a row; beyond the limit the frame comes back
    unhinted and Spark shuffles both sides of the join.
    """
    width = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one column, may repeat).

    Rows alike in doc_id and text are reduced to one; only those whose id
    repeats are compared.
    """
    keep, n = free_name(docs, "_keep"), free_name(docs, "_n")
    counted = stored(ids.toDF(keep).groupBy(keep).agg(F.count(F.lit(1)).alias(n)), "keep")
    kept = docs.join(broadcast_within(counted, 16), docs["doc_id"].eqNullSafe(F.col(keep)))
    once = kept.filter(F.col(n) == 1).select(*docs.columns)
    again = counted.filter(F.col(n) > 1)
    if again.isEmpty():
        return once
    repeated = kept.filter(F.col(n) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, label: str, seed_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each value of ``label``, chosen by a hash.

    One narrow pass counts the labels; a row stays if the hash of ``seed_col``
    falls below its label's share, so that nothing is sorted or shuffled. The
    expected number of rows is bounded by ``per_label`` times the labels.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("_n"))
    shares = broadcast_within(counts.select(F.col(label).alias("_label"), share.alias("_share")), 64)
    point = F.pmod(F.xxhash64(F.lit("sample"), F.col(seed_col)), F.lit(1 << 20)) / float(1 << 20)
    return (
        df.join(shares, F.col(label).eqNullSafe(F.col("_label")))
        .filter(point < F.col("_share"))
        .drop("_label", "_share")
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks are found by import there, also on executors
    that have no copy of the repository.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    # Rows are whole texts: few at a time keep a worker's memory bounded.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    session.ship_package(spark)
    _SHIPPED.add(context.applicationId)


#: What a module keeps in a Python worker between its tasks: how to drop it, by module.
KEPT: dict[str, Callable[[], None]] = {}


def let_go(module: str) -> None:
    """Drop what tasks of other modules than ``module`` have left in this worker."""
    others = [drop for name, drop in KEPT.items() if name != module]
    for drop in others:
        drop()
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` whose function may use this package."""
    ship_package(df.sparkSession)

    def run(batches):
        let_go(function.__module__)
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)
