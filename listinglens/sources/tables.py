"""Versioned Parquet tables, append-only logs and static lists.

A stage never changes files in place: it writes a new version and then logs it.
Readers resolve the newest logged version, so a failed or repeated stage leaves
the former state visible.

A table is written whole (:func:`write_table`), or as a :class:`BucketedTable`:
rows lie in buckets by a hash of their key, a version writes only the buckets
that it changes, and the log says for each bucket which version has its files.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglens.operators.skew import chunked_rank
from listinglens.schemas import PLACES, STATIONS

#: Without a bucket: the version has all rows; else one row for each bucket that has any.
VERSION_LOG = T.StructType(
    [
        T.StructField("version", T.LongType(), False),
        T.StructField("bucket", T.IntegerType(), True),
        T.StructField("files_of", T.LongType(), True),
    ]
)


def _log_version(spark: SparkSession, root: str, name: str, version: int, parts: dict[int, int] | None) -> None:
    """Make ``version`` visible; logging it again replaces what was logged."""
    rows = [(version, None, None)] if parts is None else [(version, b, v) for b, v in sorted(parts.items())]
    # A version without any row still exists.
    entry = spark.createDataFrame(rows or [(version, -1, None)], VERSION_LOG)
    entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/versions/of={version}")


def _versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(VERSION_LOG).parquet(f"{root}/{name}/versions").select(*VERSION_LOG.names)
    except AnalysisException:
        return spark.createDataFrame([], VERSION_LOG)


def write_table(
    df: DataFrame, root: str, name: str, version: int, partition_by: Sequence[str] = ()
) -> None:
    """Write ``version`` of a table, then make it visible."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{name}/data/version={version}")
    _log_version(df.sparkSession, root, name, version, None)


def current_version(
    spark: SparkSession, root: str, name: str, before: int | None = None
) -> int | None:
    """Newest visible version, optionally only below ``before``."""
    log = _versions(spark, root, name)
    if before is not None:
        log = log.filter(F.col("version") < before)
    return log.agg(F.max("version")).first()[0]


def bucket_parts(spark: SparkSession, root: str, name: str, version: int) -> dict[int, int] | None:
    """Bucket -> version with its files; None for a table that was written whole."""
    log = _versions(spark, root, name).filter(F.col("version") == version)
    rows = log.collect()  # one per bucket
    if any(r["bucket"] is None for r in rows):
        return None
    return {r["bucket"]: r["files_of"] for r in rows if r["bucket"] >= 0}


def read_table(
    spark: SparkSession,
    root: str,
    name: str,
    schema: T.StructType | None = None,
    version: int | None = None,
    before: int | None = None,
    buckets: Iterable[int] | None = None,
) -> DataFrame:
    """A table at its newest (or a given) version; an empty frame if never written.

    ``buckets`` reads only those of a bucketed table.
    """
    chosen = version if version is not None else current_version(spark, root, name, before)
    if chosen is None:
        if schema is None:
            raise FileNotFoundError(f"{root}/{name} has no version")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    parts = bucket_parts(spark, root, name, chosen)
    if parts is None:
        return reader.parquet(f"{root}/{name}/data/version={chosen}")
    if buckets is not None:
        parts = {b: parts[b] for b in set(buckets) & set(parts)}
    if not parts:
        return spark.createDataFrame([], schema)
    return reader.parquet(*[f"{root}/{name}/data/_b={b}/_v={v}" for b, v in sorted(parts.items())])


@dataclass(frozen=True)
class BucketedTable:
    """A table whose rows lie in ``buckets`` by a hash of ``keys``; versions are copy-on-write."""

    spark: SparkSession
    root: str
    name: str
    schema: T.StructType
    keys: tuple[str, ...] = ("source", "source_id")
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets of the keys of ``rows``; at most ``buckets`` numbers."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def read(
        self, before: int | None = None, version: int | None = None, buckets: Iterable[int] | None = None
    ) -> DataFrame:
        return read_table(self.spark, self.root, self.name, self.schema, version, before, buckets)

    def write(self, rows: DataFrame, version: int, touched: Iterable[int] | None = None) -> None:
        """Make ``rows`` all rows of the ``touched`` buckets (None: of the table) in ``version``.

        Files of other buckets stay as they are, and so do those of older
        versions, for readers that still have them. A version may be written
        again: only its own files are replaced.
        """
        found = Observation()
        placed = rows.withColumn("_b", self.bucket()).withColumn("_v", F.lit(version))
        (
            placed.observe(found, F.collect_set("_b").alias("buckets"))
            .hint("rebalance", "_b")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_b", "_v")
            .parquet(f"{self.root}/{self.name}/data")
        )
        earlier = current_version(self.spark, self.root, self.name, before=version)
        parts = {}
        if earlier is not None and touched is not None:
            parts = bucket_parts(self.spark, self.root, self.name, earlier)
            if parts is None:
                raise ValueError(f"version {earlier} of {self.name} has no buckets; write this one whole")
            parts = {b: v for b, v in parts.items() if b not in set(touched)}
        parts |= {b: version for b in found.get["buckets"]}
        _log_version(self.spark, self.root, self.name, version, parts)

    def expire(self, keep_from: int) -> int:
        """Delete files that no version from ``keep_from`` on has, and those versions' log; how many buckets' files went."""
        log = _versions(self.spark, self.root, self.name).collect()  # a row per bucket and version
        kept = {(r["bucket"], r["files_of"]) for r in log if r["version"] >= keep_from}
        gone = {(r["bucket"], r["files_of"]) for r in log if r["bucket"] is not None and r["bucket"] >= 0} - kept
        folder = f"{self.root}/{self.name}"
        for version in {r["version"] for r in log if r["version"] < keep_from}:
            delete(self.spark, f"{folder}/versions/of={version}")
        for bucket, version in gone:
            delete(self.spark, f"{folder}/data/_b={bucket}/_v={version}")
        return len(gone)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def append_run(df: DataFrame, root: str, name: str, run_id: int) -> None:
    """Append a run's rows to a log; repeating the run replaces its rows."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")


def read_log(
    spark: SparkSession,
    root: str,
    name: str,
    schema: T.StructType,
    visible_in: str | None = None,
    before: int | None = None,
) -> DataFrame:
    """All runs of a log, with ``run_id``.

    With ``visible_in`` only those that are visible versions of that table: a run
    that failed after it wrote its log does not show. ``before`` leaves out later runs.
    """
    full = T.StructType([*schema.fields, T.StructField("run_id", T.LongType(), True)])
    try:
        rows = spark.read.schema(full).parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], full)
    if before is not None:
        rows = rows.filter(F.col("run_id") < before)
    if visible_in is not None:
        versions = _versions(spark, root, visible_in).select("version").distinct().collect()  # a row per night
        rows = rows.filter(F.col("run_id").isin([r["version"] for r in versions]))
    return rows


def scan_active(listings: DataFrame, *columns: str) -> DataFrame:
    """Active listings, only the named columns; filter and pruning reach the scan."""
    active = listings.filter("is_active")
    return active.select(*columns) if columns else active


def _static_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON arrays of objects, one per file; ``ord`` counts entries in order of file and place."""
    fields = [f for f in schema if f.name != "ord"]
    entry = T.ArrayType(T.StructType(fields))
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    entries = text.select(
        F.input_file_name().alias("_file"),
        F.posexplode(F.from_json("value", entry)).alias("_place", "e"),
    )
    ranked = chunked_rank(entries, chunk=["_file"], order=[F.col("_place")], name="_rank")
    return ranked.select(
        (F.col("_rank") - 1).alias("ord"), *[F.col(f"e.{f.name}") for f in fields]
    )


def load_stations(spark: SparkSession, path: str) -> DataFrame:
    return _static_list(spark, path, STATIONS)


def load_places(spark: SparkSession, path: str) -> DataFrame:
    return _static_list(spark, path, PLACES)
