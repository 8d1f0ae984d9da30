"""Golden cases of the scalar rules."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from listinglens.functions import geo, hashing, listing, text
from listinglens.operators.areas import locate
from listinglens.operators.feed import parse_feed_params
from listinglens.schemas import AREAS


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def each(spark, values, use):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[1] for r in df.select("i", use(F.col("v")).alias("o")).orderBy("i").collect()]


def test_decode_entities(spark):
    cases = {
        "a &amp; b": "a & b",
        "&#x16F;&#225;": "ůá",
        "&scaron;&Ccaron;&foo;": "šČ&foo;",
        "&amp;lt;": "&lt;",
        "&#x26;#65;": "A",
        "x&nbsp;y": "x y",
        "&#x1F600;": "😀",
        "&#x110000;": "&#x110000;",
        "&#x0000000041;&#0000000000065;&#x0;": "AA\0",
        "&#x123456789;": "&#x123456789;",
        "none": "none",
        "&;&#;": "&;&#;",
    }
    assert each(spark, cases, text.decode_entities) == list(cases.values())


def test_clean_and_strip(spark):
    cases = ["<p>Dům</p>  &lt;b&gt; x ", "<br>", "   "]
    assert each(spark, cases, text.clean_description) == ["Dům x", None, None]
    assert each(spark, ["a&nbsp;<i>b</i>\n c", "<p></p>"], text.strip_html) == ["a b c", None]


def test_red_phrase_order_and_accents(spark):
    cases = [
        "Zálohu předem, pak WhatsApp",
        "Jsem ZE ZAHRANIČÍ",
        "zálohu předem",
        "Kontaktujte mě pouze",
        "nelze prohlédnout",
        "Hezký dům",
        None,
    ]
    got = each(spark, cases, text.red_phrase)
    assert got == [
        "Asks for a deposit/payment before viewing",
        "Owner / payment abroad",
        "Asks for a deposit/payment before viewing",
        "Email-only contact, pushes off-platform",
        "Discourages an in-person viewing",
        None,
        None,
    ]


def test_names_and_codes(spark):
    usable = each(
        spark,
        ["Dům 126 m², pozemek 175 m²", "Vila 1 200 m2", "bez plochy", "pozemek 300 m"],
        lambda v: listing.areas_from_name(v)[0],
    )
    assert usable == [126.0, 1200.0, None, None]
    land = each(
        spark,
        ["Dům 126 m², POZEMEK 1 175 m²", "Dům 5 m²"],
        lambda v: listing.areas_from_name(v)[1],
    )
    assert land == [1175.0, None]
    codes = ["DISP_5_KK", "DISP_3_1", "DISP_5", "DISP_", "5_KK", None]
    assert each(spark, codes, listing.disposition) == ["5+kk", "3+1", "5", None, None, None]
    alts = ["Prodej domu 96 m² Hřiměždice", "Dům 5 m² X", "Dům Praha", "Dům 120m2"]
    assert each(spark, alts, lambda v: listing.parse_alt(v)[0]) == [96.0, None, None, 120.0]
    assert each(spark, alts, lambda v: listing.parse_alt(v)[1]) == ["Hřiměždice", "X", None, None]


def test_kind_precedence(spark):
    title = ["vila u chaty"]
    assert each(spark, title, listing.classify_kind_b) == ["vila"]
    assert each(spark, title, listing.classify_kind_c) == ["recreational"]
    assert each(spark, ["nic"], lambda v: listing.classify_kind_a(F.lit(None), v)) == ["other"]


def test_gps(spark):
    html = ['{"latitude": 50.0875, "longitude": 14.42130}', "lat=50.1 lng=14.123", "lat='49.123' lon:15.4567"]
    assert each(spark, html, lambda v: listing.parse_gps(v)[0]) == [50.0875, None, 49.123]
    assert each(spark, html, lambda v: listing.parse_gps(v)[1]) == [14.4213, 14.123, 15.4567]


def test_js_round(spark):
    values = [F.lit(v) for v in (0.5, 1.5, -0.5, -1.5, 2.4)]
    assert one(spark, *[listing.js_round(v) for v in values]) == (1, 2, 0, -1, 2)


def test_date_range(spark):
    days = ["2001-05-01 00:00:00", "2001-05-31 23:59:59", "2001-06-01", "soon", None]
    inside = each(spark, days, lambda v: listing.date_range_filter(v, "2001-05-01", "2001-05-31"))
    assert inside == [True, True, False, False, False]
    assert each(spark, days, listing.date_range_filter) == [True] * 5


def test_dhash_sign_and_size(spark):
    rising = list(range(9)) * 8
    falling = rising[::-1]
    df = spark.createDataFrame(
        [(rising,), (falling,), ([9] + [0, 1] * 4 + falling[9:],), ([1, 2],)], "px array<int>"
    )
    got = [r[0] for r in df.select(hashing.dhash_from_pixels(F.col("px"))).collect()]
    assert got[0] == -1 and got[1] == 0 and got[3] is None
    assert got[2] == int("01010101", 2) << 56


def test_geodesic_bounds(spark):
    near, far = one(
        spark,
        geo.geodesic_m(50.0, 14.0, 50.0, 14.001),
        geo.geodesic_m(50.0875, 14.4213, 49.1951, 16.6068),
    )
    assert near == pytest.approx(71.7, abs=0.1)
    # The sphere and the spheroid differ by at most about 0.56 %.
    sphere = one(spark, geo.haversine_km(50.0875, 14.4213, 49.1951, 16.6068)) * 1000
    assert far == pytest.approx(sphere, rel=0.0056)
    same, both = one(
        spark, geo.geodesic_m(50.0, 14.0, 50.0, 14.0), geo.geodesic_far_m(50.0, 14.0, 50.01, 14.01)
    )
    assert same == 0.0
    assert both == pytest.approx(one(spark, geo.geodesic_near_m(50.0, 14.0, 50.01, 14.01)), rel=1e-5)
    # A degree of latitude on WGS84 near 50 degrees.
    assert one(spark, geo.geodesic_m(49.5, 14.0, 50.5, 14.0)) == pytest.approx(111_229, abs=30)


def test_haversine(spark):
    quarter = one(spark, geo.haversine_km(0.0, 0.0, 0.0, 90.0))
    assert quarter == pytest.approx(6371 * math.pi / 2)


def test_polygons_holes_parts_and_edges(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shell = ring((14, 49), (15, 49), (15, 50), (14, 50), (14, 49))
    hole = ring((14.4, 49.4), (14.6, 49.4), (14.6, 49.6), (14.4, 49.6), (14.4, 49.4))
    island = ring((16, 49), (17, 49), (16, 50), (16, 49))
    areas = spark.createDataFrame(
        [
            ("B", "ring", "k", "r", [[shell, hole], [island]]),
            ("A", "corner", "k", "r", [[ring((14, 49), (14.2, 49), (14, 49.2), (14, 49))]]),
        ],
        AREAS,
    )
    points = {
        (49.5, 14.2): "B",
        (49.5, 14.5): None,  # in the hole
        (49.4, 14.5): None,  # on the hole's edge
        (49.0, 14.5): None,  # on the shell
        (49.2, 16.2): "B",
        (49.9, 16.9): None,
        (49.05, 14.05): "A",  # in both: lowest code
    }
    df = spark.createDataFrame([(y, x) for y, x in points], "lat double, lng double")
    found = {(r["lat"], r["lng"]): r["code"] for r in locate(df, areas).collect()}
    assert found == {p: c for p, c in points.items() if c}


def test_feed_params():
    filters, ids = parse_feed_params(
        {
            "maxPrice": ["5e6"],
            "minUsable": ["abc"],
            "maxPrague": ["0"],
            "area": ["A1", "A2"],
            "verdict": ["cheap"],
            "sort": ["upside"],
            "goodDeals": ["true"],
            "fresh": ["1"],
        }
    )
    assert ids == ()
    assert filters.max_price == 5e6 and filters.min_usable is None
    assert filters.max_prague_km == 0.0
    assert filters.areas == ("A1", "A2") and filters.sources == ()
    assert filters.verdict is None and filters.sort == "newest"
    assert not filters.good_deals_only and filters.fresh_only
    assert parse_feed_params({"id": ["7", "x", "9"]})[1] == (7, 9)
