"""Triage log, views and feed marks, from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.operators import triage as T
from listinglens.schemas import FEED_MARKS, TRIAGE_OPS, conform
from workload import fixtures as X
from workload.base import block, query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(name: str):
    return F.date_format(name, STAMP).alias(name)


def triage_ops(spark, sf):
    """Views and clicks mark seen, purchases shortlist, sign-ups delete, errors clear one state."""
    return conform(
        X.table(spark, sf, "events")
        .selectExpr(
            "user_id",
            "event_id as seq",
            "cast(ts as timestamp) as ts",
            "case event_type when 'signup' then 'delete' when 'error' then 'clear' else 'set' end as op",
            "case when event_type <> 'error' then event_id % 500 end as cluster_id",
            "case event_type when 'view' then 'seen' when 'click' then 'seen' when 'purchase' then 'shortlist' "
            "when 'error' then if(event_id % 2 = 0, 'seen', 'shortlist') end as state",
        ),
        TRIAGE_OPS,
    )


block(
    "ops",
    """SELECT user_id, event_id AS seq, ts,
    CASE event_type WHEN 'signup' THEN 'delete' WHEN 'error' THEN 'clear' ELSE 'set' END AS op,
    CASE WHEN event_type <> 'error' THEN event_id % 500 END AS cluster_id,
    CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'seen' WHEN 'purchase' THEN 'shortlist'
      WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE 'shortlist' END END AS state
  FROM events""",
)
# Straight reading of the log: a set lives until the next operation on its row;
# a clear of its state in between ends it.
block(
    "op_step",
    """SELECT o.*, lead({'t': ts, 's': seq}) OVER (PARTITION BY user_id, cluster_id ORDER BY ts, seq) AS nxt
  FROM ops o WHERE op <> 'clear'""",
)
block(
    "op_end",
    """SELECT s.*, op = 'delete' OR EXISTS (
      SELECT 1 FROM ops c WHERE c.op = 'clear' AND c.user_id = s.user_id AND c.state = s.state
        AND {'t': c.ts, 's': c.seq} > {'t': s.ts, 's': s.seq}
        AND (s.nxt IS NULL OR {'t': c.ts, 's': c.seq} < s.nxt)) AS ends
  FROM op_step s""",
)
block(
    "folded",
    """SELECT user_id, cluster_id, state, created_at FROM (
    SELECT *, min(ts) OVER (PARTITION BY user_id, cluster_id, life) AS created_at
    FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (
            PARTITION BY user_id, cluster_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS life FROM op_end))
  WHERE nxt IS NULL AND NOT ends""",
)
block(
    "user_feed",
    """SELECT DISTINCT user_id, cluster_id, first_seen_at FROM (
    SELECT user_id, CAST(round(value * 3) AS BIGINT) % 500 AS cluster_id,
      TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (CAST(round(value * 3) AS BIGINT) % 500) AS first_seen_at
    FROM events)""",
)
block(
    "mark",
    """SELECT user_id, CASE WHEN event_id % 7 = 0 THEN 'device' ELSE 'server' END AS origin,
    user_id % 2 = 0 AS explicit, ts AS seen_at FROM events""",
)
block(
    "merged_mark",
    f"""SELECT user_id, coalesce(max(seen_at) FILTER (WHERE origin = 'server' OR explicit),
      TIMESTAMP '{X.RUN_TS}') AS feed_seen_at FROM mark GROUP BY user_id""",
)


def folded(spark, sf):
    return T.fold_triage(triage_ops(spark, sf))


def user_feed(spark, sf):
    """The clusters each user is shown, read from the events."""
    return (
        X.table(spark, sf, "events")
        .select(
            "user_id",
            F.expr("cast(round(value * 3) as bigint) % 500 as cluster_id"),
        )
        .distinct()
        .withColumn(
            "first_seen_at",
            F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(cluster_id as int))"),
        )
    )


def feed_marks(spark, sf):
    return conform(
        X.table(spark, sf, "events")
        .selectExpr(
            "user_id",
            "if(event_id % 7 = 0, 'device', 'server') as origin",
            "user_id % 2 = 0 as explicit",
            "cast(ts as timestamp) as seen_at",
        ),
        FEED_MARKS,
    )


SQL_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"


@query(
    "fold_triage",
    f"SELECT user_id, cluster_id, state, {SQL_STAMP.format('created_at')} FROM folded",
)
def _(spark, sf):
    return folded(spark, sf).select("user_id", "cluster_id", "state", stamp("created_at"))


@query(
    "triage_list",
    f"SELECT user_id, cluster_id, state, {SQL_STAMP.format('created_at')} FROM folded",
)
def _(spark, sf):
    return T.triage_list(folded(spark, sf)).select(
        "user_id", "cluster_id", "state", stamp("created_at")
    )


@query(
    "triage_snapshot",
    """SELECT user_id, state, cluster_id,
         row_number() OVER (PARTITION BY user_id, state ORDER BY created_at, cluster_id) AS position
       FROM folded""",
)
def _(spark, sf):
    return T.triage_snapshot(folded(spark, sf)).drop("created_at")


block(
    "device",
    """SELECT user_id, CAST(round(value) AS BIGINT) % 500 AS cluster_id, max(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)
      AS is_seen, min(ts) AS created_at
  FROM events GROUP BY ALL""",
)


@query(
    "merge_triage",
    f"""SELECT user_id, cluster_id, state, {SQL_STAMP.format('created_at')} FROM (
         SELECT * FROM folded UNION ALL
         SELECT user_id, cluster_id, CASE WHEN is_seen = 1 THEN 'seen' ELSE 'shortlist' END, created_at FROM device d
         WHERE NOT EXISTS (SELECT 1 FROM folded f WHERE f.user_id = d.user_id AND f.cluster_id = d.cluster_id))""",
)
def _(spark, sf):
    device = X.table(spark, sf, "events").select(
        "user_id",
        F.expr("cast(round(value) as bigint) % 500 as cluster_id"),
        F.expr("if(event_id % 3 = 0, 'seen', 'shortlist') as state"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    return T.merge_triage(folded(spark, sf), device).select(
        "user_id", "cluster_id", "state", stamp("created_at")
    )


@query("merge_feed_mark", f"SELECT user_id, {SQL_STAMP.format('feed_seen_at')} FROM merged_mark")
def _(spark, sf):
    return T.merge_feed_mark(feed_marks(spark, sf), X.run_ts()).select(
        "user_id", stamp("feed_seen_at")
    )


@query(
    "triage_views",
    """SELECT 'all' AS view, user_id, cluster_id FROM user_feed u
       WHERE NOT EXISTS (SELECT 1 FROM folded f WHERE f.user_id = u.user_id AND f.cluster_id = u.cluster_id)
       UNION ALL
       SELECT 'seen', user_id, cluster_id FROM user_feed u WHERE EXISTS (
         SELECT 1 FROM folded f WHERE f.user_id = u.user_id AND f.cluster_id = u.cluster_id AND f.state = 'seen')
       UNION ALL
       SELECT 'liked', user_id, cluster_id FROM folded
       WHERE state = 'shortlist' AND cluster_id IN (SELECT cluster_id FROM user_feed)""",
)
def _(spark, sf):
    feed, triage = user_feed(spark, sf), folded(spark, sf)
    clusters = feed.select("cluster_id").distinct()
    parts = {
        "all": T.untriaged_feed(feed, triage),
        "seen": T.seen_feed(feed, triage),
        "liked": T.liked_clusters(clusters, triage),
    }
    views = [
        df.select(F.lit(name).alias("view"), "user_id", "cluster_id") for name, df in parts.items()
    ]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query(
    "by_recency",
    """SELECT user_id, cluster_id,
         row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, cluster_id DESC) AS rank
       FROM user_feed JOIN (SELECT user_id, cluster_id, created_at FROM folded WHERE state = 'seen')
         USING (user_id, cluster_id)""",
)
def _(spark, sf):
    seen = folded(spark, sf).filter("state = 'seen'")
    return T.by_recency(user_feed(spark, sf), seen).select("user_id", "cluster_id", "rank")


@query(
    "feed_counts",
    """SELECT user_id, all_count, seen_count, liked_count, new_count,
         all_count + seen_count + liked_count AS total_count
       FROM (
         SELECT user_id, count(*) FILTER (WHERE in_feed AND state IS NULL) AS all_count,
           count(*) FILTER (WHERE in_feed AND state = 'seen') AS seen_count,
           count(*) FILTER (WHERE state = 'shortlist') AS liked_count,
           count(*) FILTER (WHERE in_feed AND state IS NULL AND first_seen_at > feed_seen_at) AS new_count
         FROM (SELECT u.first_seen_at IS NOT NULL AS in_feed, * FROM user_feed u
               FULL JOIN folded f USING (user_id, cluster_id))
           LEFT JOIN merged_mark USING (user_id)
         GROUP BY user_id)
       WHERE all_count + seen_count + liked_count + new_count > 0
         OR user_id IN (SELECT user_id FROM user_feed)""",
)
def _(spark, sf):
    marks = T.merge_feed_mark(feed_marks(spark, sf), X.run_ts())
    return T.feed_counts(user_feed(spark, sf), folded(spark, sf), marks)
