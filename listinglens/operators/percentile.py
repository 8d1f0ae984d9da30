"""Price percentiles among comparable homes.

Everything is computed on the histogram of prices per m², not on the listings:
the rank of a price only depends on (code, band, price). Cumulative counts are
taken in two levels (blocks of 65,536 prices, then prices in a block), so even
the bucket that holds all listings never meets in one task. Prices per m² are
32-bit integers, which bounds a block and the number of blocks alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.operators.skew import broadcast_if_small
from listinglens.session import cut_lineage
from listinglens.settings import DEFAULTS, Settings

BLOCK = 65_536
LEVELS = [1, 2, 3, 4]
LEVEL_NAMES = {1: "code_band", 2: "code", 3: "band", 4: "all"}


def _filled(name: str) -> Column:
    """Missing and empty keys both skip their level."""
    return F.when(F.col(name) != "", F.col(name))


def price_cells(samples: DataFrame) -> DataFrame:
    """(code, band, value, n): listings per distinct price in a bucket.

    ``samples`` has cadastral_code, size_band, price_per_usable_m2.
    """
    return (
        samples.filter(F.col("price_per_usable_m2").isNotNull())
        .groupBy(
            _filled("cadastral_code").alias("code"),
            _filled("size_band").alias("band"),
            F.col("price_per_usable_m2").cast("long").alias("value"),
        )
        .agg(F.count("*").alias("n"))
    )


def level_keys() -> Column:
    """The buckets a (code, band) belongs to, most specific first."""
    code, band = F.col("code"), F.col("band")
    level = lambda i, key: F.struct(F.lit(i).alias("level"), key.alias("key"))
    keys = F.array(
        level(1, F.concat(code, F.lit("|"), band)),
        level(2, code),
        level(3, F.concat(F.lit("band:"), band)),
        level(4, F.lit("all")),
    )
    return F.filter(keys, lambda k: k["key"].isNotNull())


def price_histogram(cells: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(level, key, value, equal, less, total) for every bucket and price.

    With ``wanted`` (level, key) only for those buckets, each over all its prices.
    """
    keyed = cells.select("value", "n", F.explode(level_keys()).alias("_l")).select(
        "_l.level", "_l.key", F.floor(F.col("value") / BLOCK).cast("long").alias("block"), "value", "n"
    )
    if wanted is not None:
        keyed = keyed.join(wanted, ["level", "key"], "left_semi")
    counts = (
        keyed
        .groupBy("level", "key", "block", "value")
        .agg(F.sum("n").alias("equal"))
    )
    bucket = Window.partitionBy("level", "key")
    earlier = bucket.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("level", "key", "block").agg(F.sum("equal").alias("_size")).select(
        "level",
        "key",
        "block",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(bucket).alias("total"),
    )
    lower = (
        Window.partitionBy("level", "key", "block")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counts.withColumn("_within", F.coalesce(F.sum("equal").over(lower), F.lit(0)))
        .join(blocks, ["level", "key", "block"])
        .select(
            "level", "key", "value", "equal", (F.col("_before") + F.col("_within")).alias("less"), "total"
        )
    )


def mid_rank(less: Column, equal: Column, total: Column) -> Column:
    """Mid-rank percentile 0..100; equal prices tie."""
    return (less.cast("double") + equal.cast("double") / 2.0) / total.cast("double") * 100.0


def chosen_buckets(cells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(code, band) -> (level, key): the most specific bucket with enough listings, of at least two."""
    keyed = (
        cells.groupBy("code", "band")
        .agg(F.sum("n").alias("n"))
        .select("code", "band", "n", F.explode(level_keys()).alias("_l"))
        .select("code", "band", "n", "_l.level", "_l.key")
    )
    totals = keyed.groupBy("level", "key").agg(F.sum("n").alias("total"))
    enough = F.when(F.col("total") >= settings.min_samples, F.col("level")).otherwise(F.lit(9))
    ranked = F.struct(enough.alias("rank"), (-F.col("level")).alias("widest"), "level", "key", "total")
    return (
        keyed.join(totals, ["level", "key"])
        .groupBy("code", "band")
        .agg(F.min(ranked).alias("b"))
        .filter("b.total >= 2")
        .select("code", "band", "b.level", "b.key")
    )


def price_percentiles(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(code, band, value) -> percentile in the most specific bucket with enough listings.

    Falls back code and band -> code -> band -> all; below two listings there
    is no result. How many listings a bucket has is known before any price is
    looked up, so a price is counted and looked up in the one bucket it takes.
    """
    cells = cut_lineage(price_cells(samples))
    # Kept once: its rows are as many as the (code, band) that occur.
    chosen = cut_lineage(chosen_buckets(cells, settings))
    wanted = broadcast_if_small(chosen.select("level", "key").distinct())
    histogram = price_histogram(cells, wanted)
    few = broadcast_if_small(chosen.withColumnsRenamed({"code": "_code", "band": "_band"}))
    same = F.col("code").eqNullSafe(F.col("_code")) & F.col("band").eqNullSafe(F.col("_band"))
    best = cells.join(few, same).drop("_code", "_band", "n").join(histogram, ["level", "key", "value"])
    percentile = mid_rank(F.col("less"), F.col("equal"), F.col("total"))
    return best.select(
        "code",
        "band",
        "value",
        percentile.alias("percentile"),
        F.when(F.col("level") == 1, "high").otherwise("low").alias("percentile_confidence"),
        F.col("total").cast("int").alias("sample_size"),
        F.col("key").alias("bucket_key"),
        verdict(percentile, settings).alias("deal_verdict"),
    )


def verdict(percentile: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(percentile >= settings.overpriced_pct, "overpriced")
        .when(percentile <= settings.deal_pct, "deal")
        .when(percentile.isNotNull(), "fair")
    )


def with_percentiles(listings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Attach the percentile columns by (code, band, price per m²)."""
    found = price_percentiles(listings, settings)
    dropped = [c for c in found.columns if c in listings.columns]
    base = listings.drop(*dropped).withColumns(
        {
            "_code": _filled("cadastral_code"),
            "_band": _filled("size_band"),
            "_value": F.col("price_per_usable_m2").cast("long"),
        }
    )
    match = (
        (base["_value"] == found["value"])
        & base["_code"].eqNullSafe(found["code"])
        & base["_band"].eqNullSafe(found["band"])
    )
    return base.join(found, match, "left").drop(
        "_code", "_band", "_value", "code", "band", "value"
    )


def mid_rank_percentile(df: DataFrame, partition: str, value: str, name: str) -> DataFrame:
    """Mid-rank percentile of an integer column within ``partition``, by histogram."""
    as_samples = df.select(
        F.col(partition).cast("string").alias("cadastral_code"),
        F.lit(None).cast("string").alias("size_band"),
        F.col(value).alias("price_per_usable_m2"),
    )
    ranks = (
        price_histogram(price_cells(as_samples))
        .filter("level = 2")
        .select(
            F.col("key").alias("_key"),
            F.col("value").alias("_value"),
            mid_rank(F.col("less"), F.col("equal"), F.col("total")).alias(name),
        )
    )
    match = (F.col(partition).cast("string") == F.col("_key")) & (
        F.col(value).cast("long") == F.col("_value")
    )
    return df.join(ranks, match, "left").drop("_key", "_value")


def bucket_stats(samples: DataFrame) -> DataFrame:
    """n, p25, median, p75 of price per m² for every bucket of every level.

    Exact quantiles with linear interpolation, read off cumulative counts.
    """
    histogram = price_histogram(price_cells(samples))
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("less") + F.col("equal") > rank, F.col("value"))).cast("double")

    picked = []
    for name, share in shares.items():
        rank = (F.col("total") - 1) * F.lit(share)
        picked += [
            at_rank(F.floor(rank)).alias(f"_{name}_lo"),
            at_rank(F.ceil(rank)).alias(f"_{name}_hi"),
        ]
    grouped = histogram.groupBy("level", "key").agg(F.max("total").alias("n"), *picked)

    def blend(name: str, share: float) -> Column:
        rank = (F.col("n") - 1) * F.lit(share)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (rank - F.floor(rank))).alias(name)

    names = F.create_map(*[F.lit(x) for pair in LEVEL_NAMES.items() for x in pair])
    return grouped.select(
        names[F.col("level")].alias("level"),
        "key",
        "n",
        *[blend(name, share) for name, share in shares.items()],
    )
