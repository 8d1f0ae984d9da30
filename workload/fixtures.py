"""Listing-shaped relations derived from the given tables, in Spark and in SQL.

Each Spark function has a SQL block of the same content. All arithmetic is on
integers (or exact doubles), so both engines derive the same rows. Three
consecutive orders are three adverts of one house.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglens.functions.listing import js_round, size_band
from listinglens.operators.areas import assign_bucket
from listinglens.operators.scoring import max_price_by_listing, score_signals
from listinglens.operators.skew import by_key
from listinglens.schemas import (
    AREAS,
    IMAGE_HASHES,
    IMAGE_RASTERS,
    LISTINGS,
    PLACES,
    SCORE_COLUMNS,
    STATIONS,
    conform,
)
from workload.base import block, staged

RUN_TS = "2001-08-02 00:00:00"

DESCRIPTIONS = [
    "Krásný dům po rekonstrukci",
    "Záloha předem na účet",
    "Majitel je v zahraničí",
    "Platba přes Western Union",
    "Kontaktujte pouze emailem",
    "Napište na WhatsApp",
    "Bez prohlídky, ihned volné",
    "Klidná lokalita u lesa",
    "Zahrada a garáž",
    "Blízko vlaku",
    "Novostavba",
    "Cena k jednání",
]


def run_ts() -> Column:
    return F.lit(RUN_TS).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _col(sql: str) -> Column:
    return F.expr(sql)


def listings(spark: SparkSession, sf: str) -> DataFrame:
    base = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), _col("o_custkey = c_custkey"))
        .join(table(spark, sf, "nation"), _col("c_nationkey = n_nationkey"))
        .withColumns({"id": _col("o_orderkey"), "g": _col("o_orderkey div 3"), "m": _col("o_orderkey % 3")})
    )
    located = _col("id % 29 <> 0")
    descriptions = F.array(*[F.lit(d) for d in DESCRIPTIONS])
    photo = lambda i: F.concat(
        F.lit("https://img.example/"), F.col("id").cast("string"), F.lit("/"), i.cast("string")
    )
    return conform(
        base.withColumns(
            {
                "source": _col("element_at(array('alpha', 'beta', 'gamma'), cast(m + 1 as int))"),
                "source_id": _col("cast(id as string)"),
                "deal_type": _col("if(id % 50 = 0, 'rent', 'sell')"),
                "property_kind": _col("case id % 9 when 0 then 'vila' when 1 then 'other' else 'rodinny_dum' end"),
                "price": F.when(_col("id % 37 = 0"), F.lit(None))
                .when(_col("id % 53 = 0"), F.lit(0))
                .otherwise(js_round(F.col("o_totalprice")) * 20),
                "currency": F.lit("CZK"),
                "usable_area_m2": _col("case when id % 41 <> 0 then 40 + (g * 37) % 220 + 2 * m end"),
                "land_area_m2": _col("case when id % 7 <> 0 then 100 + (id * 53) % 1900 end"),
                "lat": F.when(located, _col("cast(494000 + (g * 7919) % 12000 + m as double) / 10000D")),
                "lng": F.when(located, _col("cast(134000 + (g * 104729) % 21000 as double) / 10000D")),
                "locality_text": _col(
                    "case when id % 31 <> 0 then concat(n_name, '-', cast(g % 8 as string)) end"
                ),
                "seller_type": _col("if(c_mktsegment in ('BUILDING', 'HOUSEHOLD'), 'private', 'agency')"),
                "has_ico": _col(
                    "case when id % 17 <> 0 then c_mktsegment not in ('BUILDING', 'HOUSEHOLD', 'MACHINERY') end"
                ),
                "description": F.get(descriptions, _col("cast(id % 12 as int)")),
                "url": _col("concat('https://portal.example/', cast(id as string))"),
                "photos": F.when(
                    _col("id % 11 > 0"),
                    F.transform(F.sequence(F.lit(0).cast("long"), _col("id % 11 - 1")), photo),
                ).otherwise(F.array().cast("array<string>")),
                "labels": F.array().cast("array<string>"),
                "posted_at": _col("o_orderdate"),
                "first_seen_at": _col("o_orderdate"),
                "last_seen_at": _col("o_orderdate"),
                "is_active": _col("o_orderstatus <> 'F'"),
            }
        ),
        LISTINGS,
    )


_PICK = "\n      ".join(
    f"WHEN {i} THEN '{text}'" for i, text in enumerate(DESCRIPTIONS)
)
block(
    "lst",
    f"""SELECT *,
    CASE id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source,
    CAST(id AS VARCHAR) AS source_id,
    CASE WHEN id % 50 = 0 THEN 'rent' ELSE 'sell' END AS deal_type,
    CASE id % 9 WHEN 0 THEN 'vila' WHEN 1 THEN 'other' ELSE 'rodinny_dum' END AS property_kind,
    CASE WHEN id % 37 = 0 THEN NULL WHEN id % 53 = 0 THEN 0
         ELSE CAST(floor(o_totalprice + 0.5) AS BIGINT) * 20 END AS price,
    CASE WHEN id % 41 <> 0 THEN 40 + (g * 37) % 220 + 2 * m END AS usable_area_m2,
    CASE WHEN id % 7 <> 0 THEN 100 + (id * 53) % 1900 END AS land_area_m2,
    CASE WHEN id % 29 <> 0
         THEN CAST(494000 + (g * 7919) % 12000 + m AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lat,
    CASE WHEN id % 29 <> 0
         THEN CAST(134000 + (g * 104729) % 21000 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lng,
    CASE WHEN id % 31 <> 0 THEN n_name || '-' || CAST(g % 8 AS VARCHAR) END AS locality_text,
    CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'private' ELSE 'agency' END AS seller_type,
    CASE WHEN id % 17 <> 0
         THEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') END AS has_ico,
    CASE id % 12
      {_PICK} END AS description,
    'https://portal.example/' || CAST(id AS VARCHAR) AS url,
    o_orderdate AS posted_at, o_orderdate AS first_seen_at, o_orderdate AS last_seen_at,
    o_orderstatus <> 'F' AS is_active
  FROM (
    SELECT *, o_orderkey AS id, o_orderkey // 3 AS g, o_orderkey % 3 AS m
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  )""",
)

BAND_SQL = """CASE WHEN usable_area_m2 < 80 THEN '<80' WHEN usable_area_m2 < 120 THEN '80-120'
         WHEN usable_area_m2 < 200 THEN '120-200' WHEN usable_area_m2 IS NOT NULL THEN '200+' END"""


def image_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Four photos of most listings: adverts of a house differ by a few bits, some galleries recur."""
    seed = _col(
        "case when id % 5 = 0 then 5000000 + id when g % 11 = 0 then 3000000 + g div 22 else g end"
    )
    base = (
        table(spark, sf, "orders")
        .select(_col("o_orderkey as id"), _col("o_orderkey div 3 as g"), _col("o_orderkey % 3 as m"))
        .filter("id % 13 <> 0")
        .select("*", seed.alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("position"))
        .withColumn("s", _col("seed * 4 + position + 17"))
        .withColumns(
            {
                "hi": _col("((s * s % 2147483647) * 48271) % 2147483647"),
                "lo": _col("((s * s % 2147483647) * 69621) % 2147483647"),
            }
        )
    )
    return conform(
        base.select(
            F.col("id").alias("listing_id"),
            "position",
            _col("concat('https://img.example/', cast(id as string), '/', cast(position as string)) as url"),
            _col("(shiftleft(hi, 32) | lo) ^ case m when 0 then 0L when 1 then 3L else 15L end as dhash"),
        ),
        IMAGE_HASHES,
    )


block(
    "hashes",
    """SELECT id AS listing_id, position,
    xor((hi << 32) | lo, CAST(CASE m WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 15 END AS BIGINT)) AS dhash
  FROM (
    SELECT *, ((s * s % 2147483647) * 48271) % 2147483647 AS hi,
              ((s * s % 2147483647) * 69621) % 2147483647 AS lo
    FROM (
      SELECT id, g, m, position, seed * 4 + position + 17 AS s
      FROM (
        SELECT o_orderkey AS id, o_orderkey // 3 AS g, o_orderkey % 3 AS m,
               CASE WHEN o_orderkey % 5 = 0 THEN 5000000 + o_orderkey
                    WHEN (o_orderkey // 3) % 11 = 0 THEN 3000000 + (o_orderkey // 3) // 22
                    ELSE o_orderkey // 3 END AS seed
        FROM orders WHERE o_orderkey % 13 <> 0
      ), (SELECT unnest([0, 1, 2, 3]) AS position)
    )
  )""",
)


def image_rasters(spark: SparkSession, sf: str) -> DataFrame:
    """9x8 grey rasters read from the embedding vectors."""
    grey = F.transform(
        F.sequence(F.lit(0), F.lit(71)),
        lambda i: F.floor(
            F.abs(F.get("embedding", i % 64).cast("double")) * 1000
        ).cast("int"),
    )
    return conform(
        table(spark, sf, "embeddings").select(
            _col("vec_id div 4 as listing_id"),
            _col("cast(vec_id % 4 as int) as position"),
            _col("concat('vec-', cast(vec_id as string)) as url"),
            grey.alias("px"),
        ),
        IMAGE_RASTERS,
    )


def price_history(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Prices of all listings over time; ``of`` are the listings where they are stored."""
    priced = (listings(spark, sf) if of is None else of).filter("price > 0").select("id", "price")
    return (
        table(spark, sf, "lineitem")
        .join(priced, _col("l_orderkey = id"))
        .select(
            F.col("id").alias("listing_id"),
            _col("price + (l_linenumber - 1) * 10000 as price"),
            _col("cast(l_shipdate as timestamp) as seen_at"),
        )
    )


block(
    "history",
    """SELECT id AS listing_id, price + (l_linenumber - 1) * 10000 AS price, l_shipdate AS seen_at
  FROM lineitem JOIN lst ON l_orderkey = id WHERE price > 0""",
)


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """One rectangle per nation; the gaps between them leave points without area."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(
        corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")
    )
    base = table(spark, sf, "nation").selectExpr(
        "n_nationkey as k",
        "n_name as name",
        "(1340 + 42 * (n_nationkey % 5)) / 100D as x0",
        "(4940 + 24 * (n_nationkey div 5)) / 100D as y0",
    )
    boxed = base.withColumns({"x1": _col("x0 + 0.40D"), "y1": _col("y0 + 0.22D")})
    return conform(
        boxed.select(
            _col("concat('A', cast(k as string)) as code"),
            "name",
            F.lit("obec").alias("kind"),
            F.lit("test").alias("region"),
            F.array(F.array(ring)).alias("rings"),
        ),
        AREAS,
    )


block(
    "area",
    """SELECT *, x0 + CAST(0.40 AS DOUBLE) AS x1, y0 + CAST(0.22 AS DOUBLE) AS y1 FROM (
    SELECT 'A' || CAST(n_nationkey AS VARCHAR) AS code, n_name AS name,
           CAST(1340 + 42 * (n_nationkey % 5) AS DOUBLE) / CAST(100 AS DOUBLE) AS x0,
           CAST(4940 + 24 * (n_nationkey // 5) AS DOUBLE) / CAST(100 AS DOUBLE) AS y0
    FROM nation)""",
)


def _spread(key: str) -> list[Column]:
    return [
        _col(f"cast(494000 + ({key} * 7717) % 12000 as double) / 10000D as lat"),
        _col(f"cast(134000 + ({key} * 9973) % 21000 as double) / 10000D as lng"),
    ]


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return conform(
        table(spark, sf, "supplier").select(
            _col("s_suppkey as ord"), _col("s_name as name"), *_spread("s_suppkey")
        ),
        STATIONS,
    )


def places(spark: SparkSession, sf: str) -> DataFrame:
    return conform(
        table(spark, sf, "customer").select(
            _col("c_custkey as ord"),
            _col("c_name as name"),
            *_spread("c_custkey"),
            _col("case when c_custkey % 9 <> 0 then (c_custkey * c_custkey * 97) % 150000 end as pop"),
            _col(
                "element_at(array('city', 'town', 'village', 'hamlet'), cast(c_custkey % 4 + 1 as int)) as type"
            ),
        ),
        PLACES,
    )


def _spread_sql(key: str) -> str:
    return (
        f"CAST(494000 + ({key} * 7717) % 12000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat, "
        f"CAST(134000 + ({key} * 9973) % 21000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lng"
    )


block("station", f"SELECT s_suppkey AS ord, s_name AS name, {_spread_sql('s_suppkey')} FROM supplier")
block(
    "place",
    f"""SELECT c_custkey AS ord, c_name AS name, {_spread_sql('c_custkey')},
    CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * c_custkey * 97) % 150000 END AS pop,
    CASE c_custkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' ELSE 'hamlet' END AS type
  FROM customer""",
)


# ---- listings with area and size band ------------------------------------------------


def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    return assign_bucket(listings(spark, sf), areas(spark, sf))


block(
    "located",
    """SELECT lst.id, min(code) AS code FROM lst JOIN area
    ON lng > x0 AND lng < x1 AND lat > y0 AND lat < y1
  WHERE is_active GROUP BY lst.id""",
)
block(
    "bkt",
    f"""SELECT lst.*,
    CASE WHEN is_active THEN coalesce(located.code, 'loc:' || locality_text) END AS cadastral_code,
    CASE WHEN is_active THEN CASE WHEN located.code IS NOT NULL THEN area.name ELSE locality_text END END
      AS cadastral_name,
    CASE WHEN NOT is_active THEN NULL WHEN located.code IS NOT NULL THEN 'polygon'
         WHEN locality_text IS NOT NULL THEN 'locality' END AS bucket_source,
    CASE WHEN is_active THEN {BAND_SQL} END AS size_band
  FROM lst LEFT JOIN located USING (id) LEFT JOIN area ON area.code = located.code""",
)


# ---- houses: the three adverts of one house as its cluster ---------------------------


def housed(listings_df: DataFrame) -> DataFrame:
    """Cluster id by house, so feed queries do not repeat the duplicate search."""
    active = listings_df.filter("is_active").select("id", _col("id div 3 as g"))
    houses = active.groupBy("g").agg(F.min("id").alias("_cluster"))
    joined = listings_df.withColumn("_g", _col("id div 3")).join(
        houses.withColumnRenamed("g", "_g"), "_g", "left"
    )
    return joined.withColumn(
        "cluster_id", F.when(F.col("is_active"), F.col("_cluster"))
    ).select(*listings_df.columns)


def house_components(listings_df: DataFrame) -> DataFrame:
    return housed(listings_df).filter("is_active").select("id", F.col("cluster_id").alias("component"))


block(
    "house",
    """SELECT bkt.*, CASE WHEN is_active THEN min(CASE WHEN is_active THEN id END)
      OVER (PARTITION BY g) END AS cluster_id FROM bkt""",
)
block(
    "house_cluster",
    """SELECT cluster_id,
    coalesce(min({'p': price, 'i': id}) FILTER (WHERE price IS NOT NULL).i, min(id)) AS representative_listing_id,
    min(price) AS min_price, max(price) AS max_price, count(*) AS member_count
  FROM house WHERE is_active GROUP BY cluster_id""",
)

# ---- percentiles and scores ----------------------------------------------------------

block(
    "metric",
    """SELECT *,
    CASE WHEN price > 0 AND usable_area_m2 > 0
         THEN CAST(floor(CAST(price AS DOUBLE) / usable_area_m2 + 0.5) AS BIGINT) END AS price_per_usable_m2,
    CASE WHEN price > 0 AND land_area_m2 > 0
         THEN CAST(floor(CAST(price AS DOUBLE) / land_area_m2 + 0.5) AS BIGINT) END AS price_per_land_m2
  FROM house""",
)
_LEVELS = {
    1: ("code, band", "code IS NOT NULL AND band IS NOT NULL", "code || '|' || band"),
    2: ("code", "code IS NOT NULL", "code"),
    3: ("band", "band IS NOT NULL", "'band:' || band"),
    4: ("1", "TRUE", "'all'"),
}
_ranks = ",\n    ".join(
    f"""CASE WHEN {cond} THEN count(*) OVER (PARTITION BY {keys}) END AS n{i},
    (CAST(rank() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS DOUBLE)
      + CAST(count(*) OVER (PARTITION BY {keys}, v) AS DOUBLE) / CAST(2 AS DOUBLE))
      / CAST(count(*) OVER (PARTITION BY {keys}) AS DOUBLE) * CAST(100 AS DOUBLE) AS p{i},
    {label} AS k{i}"""
    for i, (keys, cond, label) in _LEVELS.items()
)
block(
    "ranked",
    f"""SELECT id, {_ranks}
  FROM (SELECT id, nullif(cadastral_code, '') AS code, nullif(size_band, '') AS band,
               price_per_usable_m2 AS v
        FROM metric WHERE is_active AND price_per_usable_m2 IS NOT NULL)""",
)
block(
    "pct",
    """SELECT id, lvl,
    CASE lvl WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END AS percentile,
    CASE WHEN lvl = 1 THEN 'high' ELSE 'low' END AS percentile_confidence,
    CASE lvl WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END AS sample_size,
    CASE lvl WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 ELSE k4 END AS bucket_key
  FROM (SELECT *, CASE WHEN n1 >= 8 THEN 1 WHEN n2 >= 8 THEN 2 WHEN n3 >= 8 THEN 3 ELSE 4 END AS lvl
        FROM ranked)
  WHERE CASE lvl WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END >= 2""",
)
block("top_price", "SELECT listing_id AS id, max(price) AS max_price FROM history GROUP BY listing_id")

# The red phrases and their labels, as the SQL sees them.
FOLDED = "strip_accents(lower(description))"
PHRASE_SQL = f"""CASE
      WHEN regexp_matches({FOLDED}, 'zaloh\\w* predem|platb\\w* predem|kauc\\w* predem|penize predem')
        THEN 'Asks for a deposit/payment before viewing'
      WHEN regexp_matches({FOLDED}, 'v zahranici|ze zahranici|do zahranici|zahranicni')
        THEN 'Owner / payment abroad'
      WHEN regexp_matches({FOLDED}, 'western union|moneygram') THEN 'Mentions Western Union / MoneyGram'
      WHEN regexp_matches({FOLDED}, 'pouze (e-?mail|pres e-?mail)|kontaktujte (me )?pouze')
        THEN 'Email-only contact, pushes off-platform'
      WHEN regexp_matches({FOLDED}, 'whatsapp') THEN 'Pushes contact to WhatsApp'
      WHEN regexp_matches({FOLDED}, 'bez prohlidky|nelze prohlidnout|nelze prohlednout')
        THEN 'Discourages an in-person viewing' END"""


def scored_block(name: str, metric: str, pct: str, stolen: str) -> None:
    """SQL of the score stage over given metric, percentile and stolen-photo blocks."""
    block(
        name,
        f"""SELECT *,
    percentile <= 25 AND percentile IS NOT NULL AND scam_score < 30 AS is_good_deal,
    CASE WHEN percentile >= 80 THEN 'overpriced' WHEN percentile <= 25 THEN 'deal'
         WHEN percentile IS NOT NULL THEN 'fair' END AS deal_verdict
  FROM (
    SELECT *, least(100, CAST(floor(CAST(stolen * 40 + phrased * 25 + no_ico * 10 + fresh * 8 AS DOUBLE)
        * CASE WHEN percentile IS NULL THEN CAST(0.6 AS DOUBLE) WHEN percentile <= 10 THEN CAST(1.6 AS DOUBLE)
               WHEN percentile <= 25 THEN CAST(1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END
        + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS scam_score
    FROM (
      SELECT m.*, p.percentile, p.percentile_confidence, p.sample_size, p.bucket_key, t.max_price,
        CASE WHEN price > 0 AND max_price > price
             THEN CAST(max_price - price AS DOUBLE) / CAST(max_price AS DOUBLE) * CAST(100 AS DOUBLE) END
          AS price_drop_pct,
        {PHRASE_SQL} AS phrase,
        CASE WHEN phrase IS NULL THEN 0 ELSE 1 END AS phrased,
        CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS stolen,
        CASE WHEN seller_type = 'private' AND NOT coalesce(has_ico, FALSE) THEN 1 ELSE 0 END AS no_ico,
        CASE WHEN posted_at >= TIMESTAMP '{RUN_TS}' - INTERVAL 3 DAY THEN 1 ELSE 0 END AS fresh
      FROM {metric} m LEFT JOIN {pct} p USING (id) LEFT JOIN top_price t USING (id)
        LEFT JOIN {stolen} s USING (id)
      WHERE m.is_active
    )
  )""",
    )


block("no_stolen", "SELECT id FROM lst WHERE FALSE")
scored_block("scored", "metric", "pct", "no_stolen")


#: What areas, houses and scores read of a listing, and what areas and houses fill in.
JUDGED = (
    "id is_active price usable_area_m2 land_area_m2 lat lng locality_text seller_type has_ico description posted_at"
).split()
FOUND = "cadastral_code cadastral_name bucket_source size_band cluster_id".split()


def scored_houses(spark: SparkSession, sf: str) -> DataFrame:
    """Scored listings clustered by house, without the stolen-photo search.

    The stages work on the columns that they read; whole listings meet the result once, by id.
    """
    whole = listings(spark, sf)
    judged = staged(spark, sf, "judged", lambda: whole.select(*JUDGED, *FOUND))
    homes = staged(spark, sf, "homes", lambda: housed(assign_bucket(judged, areas(spark, sf))))
    none = homes.filter(F.lit(False)).select(F.col("id").alias("listing_id"))
    scored = score_signals(homes, max_price_by_listing(price_history(spark, sf, homes)), none, run_ts())
    rest = [c for c in whole.columns if c not in (*JUDGED[1:], *FOUND, *SCORE_COLUMNS)]
    active = homes.filter("is_active").count()
    dealt = by_key(whole.filter("is_active").select(*rest), "id", active)
    core = [c for c in whole.columns if c not in SCORE_COLUMNS]
    return dealt.join(scored, "id").select(*core, *SCORE_COLUMNS)


def banded(listings_df: DataFrame) -> DataFrame:
    return listings_df.withColumn("size_band", size_band(F.col("usable_area_m2")))
