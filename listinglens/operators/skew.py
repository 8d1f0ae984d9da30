"""Building blocks that keep hot keys from landing in one task.

* :func:`broadcast_if_small` hints a broadcast only after measuring the side.
* :func:`chunked_rank` and :func:`nearest_non_null` are window functions split
  in two levels, so a partition key holding a third of all rows is still spread
  over its chunks; only one summary row per chunk meets in a single window.
* :func:`join_hot_split` salts the join keys that are measured to be hot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglens.settings import DEFAULTS

ROWS_PER_TASK = 50_000


def broadcast_if_small(
    df: DataFrame, max_rows: int = DEFAULTS.broadcast_rows, weight: Column | None = None
) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows and few bytes.

    ``weight`` counts a row as several (array lengths). Beyond either bound the
    frame comes back unhinted and the join shuffles both sides.
    """
    if weight is None:
        some = df.limit(max_rows + 1)
        size, width = some.agg(F.count("*"), F.sum(row_bytes(some))).first()
    else:
        size, width = df.agg(F.sum(weight), F.sum(row_bytes(df))).first()
    small = (size or 0) <= max_rows and (width or 0) <= DEFAULTS.broadcast_bytes
    return F.broadcast(df) if small else df


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes: its texts and nested values, 8 for each other."""
    total = F.lit(16)
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            total += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            total += F.coalesce(F.octet_length(F.to_json(F.col(f.name))), F.lit(0))
        else:
            total += F.lit(8)
    return total.cast("long")


def spread(df: DataFrame) -> DataFrame:
    """Spread few but costly rows over all shuffle partitions.

    AQE merges partitions by bytes; rows about to be exploded or compared need
    parallelism by work instead.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_key(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``key`` so that a task holds about ``ROWS_PER_TASK`` rows at most.

    For joins of whole rows: their sort stays in memory however many rows there
    are. Sides that are joined by ``key`` follow this number of partitions.
    ``rows`` is given where the number of rows is known.
    """
    count = df.count() if rows is None else rows
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(count / ROWS_PER_TASK)), key)


def chunked_rank(
    df: DataFrame,
    chunk: Sequence[str],
    order: Sequence[Column],
    name: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """1-based row number within ``keys`` by (``chunk``, ``order``).

    ``chunk`` columns must be the leading part of the order and not null.
    """
    keys, chunk = list(keys), list(chunk)
    sizes = df.groupBy(*keys, *chunk).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, *chunk, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*keys, *chunk).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(within))
        .join(starts, [*keys, *chunk])
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_before", "_rn")
    )


def nearest_non_null(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    value: str,
    name: str,
    after: bool = False,
) -> DataFrame:
    """Closest non-null ``value`` strictly before (or after) each row of its key.

    ``chunk`` is a coarse, non-null prefix of the order (a day, a page block).
    """
    keys, order = list(keys), list(order)
    turn = (lambda c: F.col(c).desc()) if after else (lambda c: F.col(c).asc())
    within = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*[turn(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pick = F.min_by if after else F.max_by
    edge = pick(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    edges = df.groupBy(*keys, chunk).agg(edge.alias("_edge"))
    across = (
        Window.partitionBy(*keys).orderBy(turn(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *keys, chunk, F.last("_edge", ignorenulls=True).over(across).alias("_carried")
    )
    return (
        df.withColumn("_near", F.last(value, ignorenulls=True).over(within))
        .join(carried, [*keys, chunk])
        .withColumn(name, F.coalesce("_near", "_carried"))
        .drop("_near", "_carried")
    )


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys of ``df`` with more than ``max_rows`` rows and the pieces to cut them in."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > max_rows).select(
        *keys, F.ceil(F.col("_n") / max_rows).cast("int").alias("_pieces")
    )


def join_hot_split(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    salt_by: Sequence[Column],
    condition: Column | None = None,
) -> DataFrame:
    """Inner equi-join with the keys listed in ``hot`` salted.

    A left row goes to one piece of its key, a right row to every piece, so
    each pair still meets exactly once. ``condition`` may name columns of both
    sides, which must not clash apart from ``keys``.
    """
    keys = list(keys)
    piece = F.coalesce(F.col("_pieces"), F.lit(1))
    salted_left = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), piece).cast("int"))
        .drop("_pieces")
    )
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), piece - 1)))
        .drop("_pieces")
    )
    # Exploded sides are far larger than the planner's estimate of them, so the
    # shuffle is asked for; AQE still splits and coalesces its partitions.
    joined = salted_left.hint("merge").join(salted_right, [*keys, "_salt"])
    if condition is not None:
        joined = joined.filter(condition)
    return joined.drop("_salt")
