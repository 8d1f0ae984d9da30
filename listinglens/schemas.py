"""Declared schemas of the tables the stages exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, INT, DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
TEXT, BOOL, TIME = T.StringType(), T.BooleanType(), T.TimestampType()
TEXTS = T.ArrayType(TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


REASON = _struct(code=TEXT, label=TEXT, weight=DOUBLE)

# One landed response of a portal; ``payload`` is the body exactly as received.
RAW_PAGES = _struct(
    run_id=LONG, run_ts=TIME, source=TEXT, region=TEXT, page_no=INT, failed=BOOL, payload=TEXT
)

# One advert of one listing pass. (page_no, pos) orders the adverts of a run.
RAW_LISTING = _struct(
    run_id=LONG,
    page_no=INT,
    pos=INT,
    source=TEXT,
    source_id=TEXT,
    url=TEXT,
    price=LONG,
    property_kind=TEXT,
    usable_area_m2=INT,
    built_up_area_m2=INT,
    land_area_m2=INT,
    disposition=TEXT,
    lat=DOUBLE,
    lng=DOUBLE,
    locality_text=TEXT,
    seller_type=TEXT,
    seller_name=TEXT,
    has_ico=BOOL,
    description=TEXT,
    photos=TEXTS,
    labels=TEXTS,
    posted_at=TIME,
)

_SCORES = _struct(
    price_per_usable_m2=INT,
    price_per_land_m2=INT,
    bucket_key=TEXT,
    percentile=DOUBLE,
    percentile_confidence=TEXT,
    sample_size=INT,
    deal_verdict=TEXT,
    is_good_deal=BOOL,
    scam_score=INT,
    scam_reasons=T.ArrayType(REASON),
    deal_reasons=T.ArrayType(REASON),
    price_drop_pct=DOUBLE,
    scored_at=TIME,
)
_CORE = _struct(
    id=LONG,
    source=TEXT,
    source_id=TEXT,
    deal_type=TEXT,
    property_kind=TEXT,
    price=LONG,
    currency=TEXT,
    rent_charges=LONG,
    usable_area_m2=INT,
    built_up_area_m2=INT,
    land_area_m2=INT,
    disposition=TEXT,
    lat=DOUBLE,
    lng=DOUBLE,
    locality_text=TEXT,
    cadastral_code=TEXT,
    cadastral_name=TEXT,
    bucket_source=TEXT,
    size_band=TEXT,
    seller_type=TEXT,
    seller_name=TEXT,
    has_ico=BOOL,
    description=TEXT,
    url=TEXT,
    photos=TEXTS,
    labels=TEXTS,
    posted_at=TIME,
    first_seen_at=TIME,
    last_seen_at=TIME,
    is_active=BOOL,
    cluster_id=LONG,
)
LISTINGS = T.StructType([*_CORE, *_SCORES])
SCORE_COLUMNS = _SCORES.names

IMAGE_HASHES = _struct(listing_id=LONG, position=INT, url=TEXT, dhash=LONG)
IMAGE_RASTERS = _struct(listing_id=LONG, position=INT, url=TEXT, px=T.ArrayType(INT))
PRICE_HISTORY = _struct(listing_id=LONG, price=LONG, seen_at=TIME)
CLUSTERS = _struct(
    cluster_id=LONG,
    representative_listing_id=LONG,
    min_price=LONG,
    max_price=LONG,
    member_count=LONG,
)
# polygon -> ring -> point; the first ring of a polygon is its shell.
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(_struct(x=DOUBLE, y=DOUBLE))))
AREAS = _struct(code=TEXT, name=TEXT, kind=TEXT, region=TEXT, rings=RINGS)
STATIONS = _struct(ord=LONG, name=TEXT, lat=DOUBLE, lng=DOUBLE)
PLACES = _struct(ord=LONG, name=TEXT, lat=DOUBLE, lng=DOUBLE, pop=LONG, type=TEXT)
TRIAGE_OPS = _struct(user_id=LONG, seq=LONG, ts=TIME, op=TEXT, cluster_id=LONG, state=TEXT)
TRIAGE = _struct(user_id=LONG, cluster_id=LONG, state=TEXT, created_at=TIME)
FEED_MARKS = _struct(user_id=LONG, origin=TEXT, explicit=BOOL, seen_at=TIME)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in order, adding typed nulls for absent ones.

    A number that its column cannot hold becomes null; the row stays.
    """
    have = set(df.columns)

    def typed(f: T.StructField) -> Column:
        value = F.col(f.name) if f.name in have else F.lit(None)
        whole = isinstance(f.dataType, (T.IntegerType, T.LongType))
        return value.try_cast(f.dataType) if whole else value.cast(f.dataType)

    return df.select(*[typed(f).alias(f.name) for f in schema])
