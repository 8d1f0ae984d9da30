"""Per-user triage: fold of the operation log, views, merges, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.operators.skew import chunked_rank, nearest_non_null

OWNER = ["user_id", "cluster_id"]


def _day(ts: str) -> Column:
    return F.to_date(F.col(ts))


def next_clear(ops: DataFrame) -> DataFrame:
    """Set operations with the instant their state is next cleared for the user.

    A set in state s ends at the user's next "clear s". Sets and clears of one
    (user, state) are lined up and each set takes the closest clear after it:
    no product of clears and clusters.
    """
    lined = ops.filter(F.col("op").isin("set", "clear")).select(
        "user_id",
        "state",
        "ts",
        "seq",
        "op",
        "cluster_id",
        _day("ts").alias("_day"),
        F.when(F.col("op") == "clear", F.struct("ts", "seq")).alias("_clear"),
    )
    near = nearest_non_null(
        lined, ["user_id", "state"], "_day", ["ts", "seq"], "_clear", "cleared_at", after=True
    )
    return near.filter("op = 'set'").select(
        *OWNER, "ts", "seq", "state", "op", "cleared_at"
    )


def fold_triage(ops: DataFrame) -> DataFrame:
    """Current (user, cluster, state, created_at) rows of a log of set / delete / clear.

    A change of state keeps the original created_at; a set after a delete or a
    clear starts a new one. Operations are ordered by (ts, seq).
    """
    sets = next_clear(ops)
    deletes = ops.filter("op = 'delete'").select(
        *OWNER, "ts", "seq", F.lit(None).cast("string").alias("state"), "op",
        F.lit(None).cast("struct<ts: timestamp, seq: bigint>").alias("cleared_at"),
    )
    steps = sets.unionByName(deletes).withColumns(
        {"_day": _day("ts"), "_at": F.struct("ts", "seq")}
    )
    # Next operation of the same row: a clear only counts when it comes first.
    timed = nearest_non_null(
        steps, OWNER, "_day", ["ts", "seq"], "_at", "_next", after=True
    )
    cleared = F.col("cleared_at").isNotNull() & (
        F.col("_next").isNull() | (F.col("cleared_at") < F.col("_next"))
    )
    marked = timed.select(
        *OWNER,
        "_at",
        "ts",
        "op",
        "state",
        ((F.col("op") == "delete") | cleared).alias("_ends"),
    )
    rows = marked.groupBy(*OWNER).agg(
        F.max("_at").alias("_last"),
        F.max(F.when(F.col("_ends"), F.col("_at"))).alias("_reset"),
        F.max_by("state", "_at").alias("state"),
    )
    current = rows.filter(F.col("_reset").isNull() | (F.col("_reset") < F.col("_last")))
    begun = (
        marked.filter("op = 'set'")
        .join(current, OWNER, "left_semi")
        .join(current.select(*OWNER, "_reset"), OWNER)
        .filter(F.col("_reset").isNull() | (F.col("_at") > F.col("_reset")))
        .groupBy(*OWNER)
        .agg(F.min("ts").alias("created_at"))
    )
    return current.select(*OWNER, "state").join(begun, OWNER).select(
        *OWNER, "state", "created_at"
    )


def triage_list(triage: DataFrame) -> DataFrame:
    """Oldest-added first."""
    return triage.orderBy("user_id", "created_at", "cluster_id")


def triage_snapshot(triage: DataFrame) -> DataFrame:
    """Rows of each user's seen and shortlist lists with their place in the list.

    The lists stay rows (position 1 = oldest): a heavy user's list is never
    gathered into one array or one task.
    """
    dated = triage.withColumn("_day", _day("created_at"))
    return chunked_rank(
        dated,
        chunk=["_day"],
        order=[F.col("created_at"), F.col("cluster_id")],
        name="position",
        keys=["user_id", "state"],
    ).select("user_id", "state", "position", "cluster_id", "created_at")


def merge_triage(server: DataFrame, device: DataFrame) -> DataFrame:
    """Server rows plus the device rows of clusters the server does not know.

    A cluster the device holds in both states comes over as seen: the shortlist
    entry is sent first and then overwritten.
    """
    fresh = device.join(server.select(*OWNER), OWNER, "left_anti")
    rank = F.when(F.col("state") == "seen", 1).otherwise(0)
    fresh = fresh.groupBy(*OWNER).agg(
        F.max_by("state", rank).alias("state"), F.min("created_at").alias("created_at")
    )
    return server.select(*OWNER, "state", "created_at").unionByName(fresh)


def merge_feed_mark(marks: DataFrame, run_ts: Column) -> DataFrame:
    """Feed mark per user: latest of server mark and explicit device mark, else now."""
    counts = (F.col("origin") == "server") | F.col("explicit")
    mark = F.when(counts & (F.unix_micros("seen_at") > 0), F.col("seen_at"))
    return marks.groupBy("user_id").agg(F.coalesce(F.max(mark), run_ts).alias("feed_seen_at"))


def untriaged_feed(feed: DataFrame, triage: DataFrame) -> DataFrame:
    """Feed cards per user without the clusters the user has seen or liked.

    ``feed`` has (user_id, cluster_id, ...): one feed per user.
    """
    return feed.join(triage.select(*OWNER), OWNER, "left_anti")


def seen_feed(feed: DataFrame, triage: DataFrame) -> DataFrame:
    """Feed cards the user has marked seen (respects the feed's filters)."""
    return feed.join(triage.filter("state = 'seen'").select(*OWNER), OWNER, "left_semi")


def liked_clusters(clusters: DataFrame, triage: DataFrame) -> DataFrame:
    """Shortlisted clusters per user, whatever the filters."""
    liked = triage.filter("state = 'shortlist'").select(*OWNER, "created_at")
    return clusters.join(liked, "cluster_id")


def by_recency(cards: DataFrame, triage: DataFrame) -> DataFrame:
    """Cards of a triage set, latest-added first; ``rank`` 1 is the newest.

    ``cards`` has (user_id, cluster_id, ...).
    """
    joined = cards.join(triage.select(*OWNER, "created_at"), OWNER).withColumn(
        "_age", F.datediff(F.lit("9999-12-31").cast("date"), _day("created_at"))
    )
    return chunked_rank(
        joined,
        chunk=["_age"],
        order=[F.col("created_at").desc(), F.col("cluster_id").desc()],
        name="rank",
        keys=["user_id"],
    ).drop("_age")


def feed_counts(feed: DataFrame, triage: DataFrame, marks: DataFrame) -> DataFrame:
    """Tab counts per user: all, liked, seen, total, and new since the mark.

    ``feed`` has (user_id, cluster_id, first_seen_at).
    """
    sided = feed.join(triage.select(*OWNER, "state"), OWNER, "left").join(
        marks.select("user_id", "feed_seen_at"), "user_id", "left"
    )
    untouched = F.col("state").isNull()
    newer = untouched & F.coalesce(F.col("first_seen_at") > F.col("feed_seen_at"), F.lit(False))
    tabs = sided.groupBy("user_id").agg(
        F.count_if(untouched).alias("all_count"),
        F.count_if(F.col("state") == "seen").alias("seen_count"),
        F.count_if(newer).alias("new_count"),
    )
    liked = triage.filter("state = 'shortlist'").groupBy("user_id").agg(
        F.count("*").alias("liked_count")
    )
    zero = F.lit(0).cast("long")
    joined = tabs.join(liked, "user_id", "full")
    names = ["all_count", "liked_count", "seen_count"]
    filled = joined.select(
        "user_id", *[F.coalesce(n, zero).alias(n) for n in [*names, "new_count"]]
    )
    return filled.withColumn("total_count", F.col("all_count") + F.col("liked_count") + F.col("seen_count"))
