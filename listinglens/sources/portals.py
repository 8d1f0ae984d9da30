"""Landed portal payloads -> listing rows and detail patches.

Input is one row per received response (:data:`listinglens.schemas.RAW_PAGES`).
JSON bodies are read as VARIANT so fields of mixed or wrong type degrade to
null; HTML bodies are read with bounded patterns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.functions import variant as V
from listinglens.functions.listing import (
    areas_from_name,
    classify_kind_a,
    classify_kind_b,
    classify_kind_c,
    disposition,
    js_round,
    locality_label,
    merge_gallery,
    parse_alt,
    parse_gps,
    price_labels,
)
from listinglens.functions.text import SPACE, SPACE_SET, clean_description, strip_html
from listinglens.schemas import RAW_LISTING, conform
from listinglens.session import scratch_path
from listinglens.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Portal:
    """Fixed values of a portal: its name in the data and how its URLs look."""

    name: str
    detail_base: str
    image_host: str = ""
    image_suffix: str = ""
    first_page: int = 1


PORTAL_A = Portal(
    name="sreality",
    detail_base="https://www.sreality.cz/detail/prodej/dum",
    image_host="sdn.cz",
    image_suffix="?fl=res,100,100,1|jpg,80",
)
PORTAL_B = Portal(
    name="bezrealitky",
    detail_base="https://www.bezrealitky.cz/nemovitosti-byty-domy",
    first_page=0,
)
PORTAL_C = Portal(
    name="ceskereality",
    detail_base="https://stredo.ceskereality.cz",
    image_host="https://img-cache.ceskereality.cz/",
)
# Order in which the portals are ingested.
PORTALS = [PORTAL_A, PORTAL_B, PORTAL_C]

# URL keyword of a property kind at portal A.
KIND_SLUGS = {
    "vila": "vila",
    "recreational": "chata",
    "rodinny_dum": "rodinny",
    "other": "rodinny",
}

# How portal C marks up its cards, photos and data blocks.
CARD_ANCHOR = (
    r'<a\s+href="(/prodej/rodinne-domy/[^"]+?-([0-9]+)\.html)"[^>]*\bclass="[^"]*i-estate__image-link'
)
CARD_ALT = r'alt="([^"]*)"'
CARD_PHOTO = r'src="(https://img-cache\.ceskereality\.cz/[^"]+?\.jpg)"'
CARD_PRICE = rf'i-estate__footer-price-value"{SPACE}*>{SPACE}*([0-9{SPACE_SET}]+){SPACE}*K'
GALLERY_PHOTO = rf"(https://img-cache\.ceskereality\.cz/[^{SPACE_SET}\"'<>]+?\.jpg)"
LD_BLOCK = r'<script type="application/ld\+json"[^>]*>([\s\S]*?)</script>'

PAGE_KEYS = ["run_id", "run_ts", "region", "page_no"]


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group; null when there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _as_int(value: Column) -> Column:
    return value.try_cast("int")


def image_urls(entries: Column, portal: Portal = PORTAL_A) -> Column:
    """URLs of a mixed image array: bare strings or objects with one of two url fields."""

    def url_of(entry: Column) -> Column:
        holder = V.first_of(V.field(entry, "url"), V.field(entry, "advert_image_sdn_url"))
        return F.coalesce(V.text(entry), F.when(V.is_object(entry), V.text(holder)))

    def finished(url: Column) -> Column:
        full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
        hosted = full.contains(portal.image_host) & ~full.contains("?")
        return F.when(hosted, F.concat(full, F.lit(portal.image_suffix))).otherwise(full)

    urls = F.filter(F.transform(V.items(entries), url_of), lambda u: u.isNotNull())
    return F.coalesce(F.transform(urls, finished), F.array().cast("array<string>"))


# Address parts of the URL slug; the first present of each group counts.
SLUG_GROUPS = [["city", "district"], ["citypart", "municipality", "quarter"], ["street"]]


def _slug_fields() -> dict[str, str]:
    return {f"seo_{n}": f"{n}_seo_name" for group in SLUG_GROUPS for n in group}


def detail_url(kind: Column, advert_id: Column, portal: Portal = PORTAL_A) -> Column:
    """Public page of a portal A advert, from the ``seo_*`` fields of its locality.

    The slug may be any text but the keyword must be real.
    """
    parts = [
        V.full_text(V.first_of(*[F.col(f"seo_{n}") for n in group])) for group in SLUG_GROUPS
    ]
    slug = F.concat_ws("-", *parts)
    keyword = F.create_map(*[F.lit(x) for pair in KIND_SLUGS.items() for x in pair])[kind]
    return F.concat_ws(
        "/",
        F.lit(portal.detail_base),
        keyword,
        F.when(slug == "", "x").otherwise(slug),
        advert_id,
    )


ENTRY_PATHS = {PORTAL_A.name: "results", PORTAL_B.name: "data.listAdverts.list"}
TOTAL_PATHS = {PORTAL_A.name: "pagination.total", PORTAL_B.name: "data.listAdverts.totalCount"}


def page_entries(pages: DataFrame) -> DataFrame:
    """One row per entry of every page, of all portals in one pass over ``pages``.

    ``item`` is the advert of a JSON page, ``card`` the fragment of an HTML page;
    ``n`` and ``total`` are what the page reported. A page without entries has one
    row, with neither; ``pos`` counts from 0.
    """
    c = F.col
    json = F.when(c("source").isin(*ENTRY_PATHS), V.parse(c("payload")))
    read = pages.select(*PAGE_KEYS, "source", "failed", "payload", json.alias("_body"))

    def by_portal(paths: dict[str, str]) -> Column:
        first, *rest = [
            (c("source") == name, V.field(c("_body"), path)) for name, path in paths.items()
        ]
        out = F.when(*first)
        for other in rest:
            out = out.when(*other)
        return out

    found = read.select(
        *PAGE_KEYS,
        "source",
        "failed",
        V.items(by_portal(ENTRY_PATHS)).alias("_items"),
        F.when(c("source") == PORTAL_C.name, html_cards(c("payload"))).alias("_cards"),
        by_portal(TOTAL_PATHS).alias("_total"),
    )
    n = F.coalesce(F.size("_items"), F.size("_cards"), F.lit(0)).cast("long")
    total = F.when(c("source") == PORTAL_A.name, F.coalesce(V.loose_number(c("_total")), F.lit(0.0))).when(
        c("source") == PORTAL_B.name, F.coalesce(V.number(c("_total")), c("n"))
    )
    entries = F.when(
        c("_items").isNotNull(),
        F.transform("_items", lambda i: F.struct(i.alias("item"), F.lit(None).cast("string").alias("card"))),
    ).otherwise(
        F.transform("_cards", lambda i: F.struct(F.lit(None).cast("variant").alias("item"), i.alias("card")))
    )
    return (
        found.withColumn("n", n)
        .withColumn("total", total.cast("long"))
        .select(*PAGE_KEYS, "source", "failed", "n", "total", F.posexplode_outer(entries).alias("pos", "_e"))
        .select(*PAGE_KEYS, "source", "failed", "n", "total", "pos", "_e.item", "_e.card")
    )


def store_entries(pages: DataFrame) -> DataFrame:
    """:func:`page_entries` written to the shared folder and read again, one partition per portal.

    The adverts of all portals, and the page statistics, can then be had without
    reading or parsing a page again.
    """
    path = scratch_path(pages.sparkSession, "entries")
    page_entries(pages).write.partitionBy("source").parquet(path)
    return pages.sparkSession.read.parquet(path)


def _items_of(pages: DataFrame, portal: Portal) -> DataFrame:
    """Entries of one portal's pages; ``pages`` may already be read as entries."""
    rows = pages.filter(F.col("source") == portal.name)
    if "item" not in pages.columns:
        rows = page_entries(rows)
    return rows.filter("pos IS NOT NULL").select(*PAGE_KEYS, "source", "pos", "item", "card")


def normalize_search_json(pages: DataFrame) -> DataFrame:
    """Portal A result pages -> listing rows."""
    item, c = F.col("item"), F.col
    adverts = _items_of(pages, PORTAL_A).select(
        "*",
        *V.fields(
            item,
            hash_id="hash_id",
            advert_name="advert_name",
            loc="locality",
            sub="category_sub_cb.name",
            price_czk="price_czk",
            plain_price="price",
            premise_id="premise_id",
            premise="premise",
            all_entries="advert_images_all",
            some_entries="advert_images",
        ),
    ).filter(c("hash_id").isNotNull())
    placed = adverts.select(
        "*",
        *V.fields(
            c("loc"),
            gps_lat="gps_lat",
            gps_lon="gps_lon",
            district="district",
            citypart="citypart",
            quarter="quarter",
            municipality="municipality",
            city="city",
            **_slug_fields(),
        ),
        V.as_text(c("hash_id")).alias("source_id"),
        F.coalesce(V.text(c("advert_name")), F.lit("")).alias("title"),
        V.text(c("sub")).alias("sub_name"),
        V.first_of(c("price_czk"), c("plain_price")).alias("asked"),
        V.first_of(c("premise_id"), c("premise")).alias("office"),
        image_urls(c("all_entries")).alias("all_images"),
        image_urls(c("some_entries")).alias("some_images"),
    )
    kinded = placed.withColumn("property_kind", classify_kind_a(c("sub_name"), c("title")))
    usable, land = areas_from_name(c("title"))
    return conform(
        kinded.withColumns(
            {
                "url": detail_url(c("property_kind"), c("source_id")),
                "price": js_round(V.loose_number(c("asked"))),
                "usable_area_m2": _as_int(usable),
                "land_area_m2": _as_int(land),
                "lat": V.loose_number(c("gps_lat")),
                "lng": V.loose_number(c("gps_lon")),
                "locality_text": locality_label(
                    V.text(c("district")),
                    *[V.text(c(n)) for n in ("citypart", "quarter", "municipality", "city")],
                ),
                "seller_type": F.when(V.truthy(c("office")), "agency").otherwise("private"),
                "photos": F.when(F.size("all_images") > 0, c("all_images")).otherwise(
                    c("some_images")
                ),
                "labels": F.array().cast("array<string>"),
            }
        ),
        RAW_LISTING,
    )


def normalize_detail_json(details: DataFrame) -> DataFrame:
    """Portal A detail bodies (source, source_id, payload) -> patch rows."""
    c = F.col
    results = details.select(
        "source", "source_id", V.field(V.parse(c("payload")), "result").alias("d")
    ).filter(V.is_object(c("d")))
    rows = results.select(
        "source",
        "source_id",
        *V.fields(
            c("d"),
            about="advert_description",
            usable="usable_area",
            estate="estate_area",
            garden="garden_area",
            building="building_area",
            floor="floor_area",
            rooms="room_count_cb.name",
            since="since",
            beginning="beginning_date",
            any_premise="premise",
            exclusive="exclusively_at_rk",
            old_czk="price_summary_old_czk",
            old="price_summary_old",
            price="price_czk",
        ),
    ).select(
        "*",
        V.first_of(c("estate"), c("garden")).alias("land"),
        V.first_of(c("building"), c("floor")).alias("built"),
        V.first_of(c("since"), c("beginning")).alias("posted"),
        V.first_of(c("old_czk"), c("old")).alias("old_price"),
        F.when(V.is_object(c("any_premise")), c("any_premise")).alias("premise"),
    )
    offices = rows.select(
        "*",
        *V.fields(c("premise"), ico="company.company_ic", name="name", seo_name="seo_name"),
    )
    agency = c("premise").isNotNull()
    return offices.select(
        "source",
        "source_id",
        strip_html(V.text(c("about"))).alias("description"),
        _as_int(V.loose_number(c("usable"))).alias("usable_area_m2"),
        _as_int(V.loose_number(c("land"))).alias("land_area_m2"),
        _as_int(V.loose_number(c("built"))).alias("built_up_area_m2"),
        V.text(c("rooms")).alias("disposition"),
        F.try_to_timestamp(V.text(c("posted"))).alias("posted_at"),
        F.when(agency, "agency").otherwise("private").alias("seller_type"),
        (agency & V.truthy(c("ico"))).alias("has_ico"),
        V.text(V.first_of(c("name"), c("seo_name"))).alias("seller_name"),
        price_labels(
            V.loose_number(c("old_price")), V.loose_number(c("price")), V.is_true(c("exclusive"))
        ).alias("labels"),
    )


def normalize_adverts_json(pages: DataFrame) -> DataFrame:
    """Portal B advert pages -> listing rows; this portal has no detail step."""
    c = F.col
    adverts = _items_of(pages, PORTAL_B).select(
        "*",
        *V.fields(
            F.col("item"),
            id="id",
            uri="uri",
            title="title",
            about="description",
            asked="price",
            original="originalPrice",
            surface="surface",
            surface_land="surfaceLand",
            layout="disposition",
            gps_lat="gps.lat",
            gps_lng="gps.lng",
            district="cityDistrict",
            city="city",
            address="address",
            main="mainImage.url",
            public="publicImages",
            broker="broker",
        ),
    ).filter(c("id").isNotNull())
    rows = adverts.withColumns(
        {
            "agency": V.is_object(c("broker")),
            "gallery": F.filter(
                F.transform(V.items(c("public")), lambda e: V.text(V.field(e, "url"))),
                lambda u: u.isNotNull(),
            ),
            "price": V.number(c("asked")),
        }
    )
    return conform(
        rows.withColumns(
            {
                "source_id": V.as_text(c("id")),
                "url": F.concat(F.lit(PORTAL_B.detail_base + "/"), V.full_text(c("uri"))),
                "property_kind": classify_kind_b(V.full_text(c("title"))),
                "usable_area_m2": V.number(c("surface")),
                "land_area_m2": V.number(c("surface_land")),
                "disposition": disposition(V.text(c("layout"))),
                "lat": V.number(c("gps_lat")),
                "lng": V.number(c("gps_lng")),
                "locality_text": F.coalesce(
                    *[V.full_text(c(n)) for n in ("district", "city", "address")]
                ),
                "seller_type": F.when(c("agency"), "agency").otherwise("private"),
                "has_ico": c("agency"),
                "description": V.full_text(c("about")),
                "photos": merge_gallery(V.text(c("main")), c("gallery")),
                "labels": price_labels(V.number(c("original")), c("price")),
            }
        ),
        RAW_LISTING,
    )


def html_cards(html: Column) -> Column:
    """Array of card fragments: each runs from its image-link anchor to the next one."""
    pieces = F.split(html, f"(?={CARD_ANCHOR})", -1)
    return F.filter(pieces, lambda p: p.rlike(f"^{CARD_ANCHOR}"))


def normalize_search_html(pages: DataFrame) -> DataFrame:
    """Portal C result pages -> listing rows; the first card of an id on a page counts."""
    cards = _items_of(pages, PORTAL_C).withColumn(
        "source_id", F.regexp_extract("card", CARD_ANCHOR, 2)
    )
    firsts = (
        cards.groupBy(*PAGE_KEYS, "source", "source_id")
        .agg(F.min_by(F.struct("pos", "card"), "pos").alias("_c"))
        .select(*PAGE_KEYS, "source", "source_id", "_c.pos", "_c.card")
    )
    card = F.col("card")
    alt = F.coalesce(_extract(card, CARD_ALT), F.lit(""))
    photo = _extract(card, CARD_PHOTO)
    area, locality = parse_alt(alt)
    return conform(
        firsts.withColumns(
            {
                "url": F.concat(F.lit(PORTAL_C.detail_base), F.regexp_extract(card, CARD_ANCHOR, 1)),
                "price": V.digits_to_number(F.regexp_extract(card, CARD_PRICE, 1)),
                "property_kind": classify_kind_c(alt),
                "usable_area_m2": _as_int(area),
                "locality_text": locality,
                "seller_type": F.lit("agency"),
                "photos": F.when(photo.isNotNull(), F.array(photo)).otherwise(
                    F.array().cast("array<string>")
                ),
                "labels": F.array().cast("array<string>"),
            }
        ),
        RAW_LISTING,
    )


def normalize_detail_html(details: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Portal C detail pages (source, source_id, payload) -> patch rows."""
    html = F.col("payload")
    blocks = F.transform(F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1)), F.try_parse_json)
    products = F.filter(
        blocks,
        lambda b: F.coalesce(
            F.try_variant_get(b, '$["@type"]', "string") == "individualProduct", F.lit(False)
        ),
    )
    c = F.col
    rows = details.select(
        "source", "source_id", "payload", F.get(products, F.lit(0)).alias("p")
    ).select(
        "*",
        *V.fields(
            c("p"),
            asked="offers.price",
            about="description",
            town="offers.areaServed.address.addressLocality",
            title="name",
            lead="image",
        ),
    )
    lat, lng = parse_gps(html)
    found = F.transform(
        F.regexp_extract_all(html, F.lit(GALLERY_PHOTO), F.lit(1)),
        lambda u: F.regexp_replace(u, "/[0-9]+x[0-9]+_jpg/", "/640x640_jpg/"),
    )
    read = rows.withColumns(
        {
            "lat": lat,
            "lng": lng,
            "name": V.text(c("title")),
            "raw_text": V.text(c("about")),
            "photos": merge_gallery(
                V.text(c("lead")), found, settings.max_images_per_listing
            ),
        }
    )
    both = c("lat").isNotNull() & c("lng").isNotNull()
    return read.select(
        "source",
        "source_id",
        js_round(V.loose_number(c("asked"))).alias("price"),
        clean_description(c("raw_text")).alias("description"),
        V.full_text(c("town")).alias("locality_text"),
        _as_int(F.regexp_extract("name", rf"([0-9]{{2,4}}){SPACE}*m[²2]", 1)).alias("usable_area_m2"),
        F.when(both, c("lat")).alias("lat"),
        F.when(both, c("lng")).alias("lng"),
        F.when(F.size("photos") > 0, c("photos")).alias("photos"),
    )


def union_sources(*listings: DataFrame) -> DataFrame:
    """Listing rows of the enabled portals as one frame."""
    head, *rest = listings
    for df in rest:
        head = head.unionByName(df, allowMissingColumns=True)
    return head


def normalize_pages(
    pages: DataFrame, enable_b: bool = True, enable_c: bool = True
) -> DataFrame:
    """All portals' result pages -> listing rows."""
    parts = [normalize_search_json(pages)]
    if enable_b:
        parts.append(normalize_adverts_json(pages))
    if enable_c:
        parts.append(normalize_search_html(pages))
    return union_sources(*parts)


def page_stats(pages: DataFrame) -> DataFrame:
    """(run_id, source, region, page_no, n, total, failed): what each page reported."""
    entries = pages if "item" in pages.columns else page_entries(pages)
    return entries.filter("pos IS NULL OR pos = 0").select(
        "run_id", "source", "region", "page_no", "failed", "n", "total"
    )


def run_completeness(
    stats: DataFrame,
    settings: Settings = DEFAULTS,
    strict: bool = False,
    expected: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """(run_id, source, completed): did the listing pass reach the end of its results?

    A region of A is done at an empty page or when its pages cover the total; B
    at an empty page or when as many adverts as the total came; C at an empty
    page. Pages count from the portal's first page number. A failed page makes the pass incomplete, and so does a page that never
    landed before the last one, or an ``expected`` (source, region) of which no
    page landed; of B nothing is missing once different pages brought as many
    adverts as the total. ``strict=True`` keeps the original rule for C, where a
    failed page counts as the end.
    """
    per_region = stats.groupBy("run_id", "source", "region").agg(
        F.max_by(F.struct("page_no", "n", "total"), "page_no").alias("last"),
        F.sum("n").alias("offset"),
        F.count("page_no").alias("landings"),
        F.countDistinct("page_no").alias("pages"),
        F.min("page_no").alias("first_page"),
        F.bool_or(F.coalesce("failed", F.lit(False))).alias("failed"),
    )
    empty = F.coalesce(F.col("last.n"), F.lit(0)) == 0
    ended = (
        F.when(
            F.col("source") == PORTAL_A.name,
            empty | (F.col("last.page_no") * settings.per_page >= F.col("last.total")),
        )
        .when(F.col("source") == PORTAL_B.name, empty | (F.col("offset") >= F.col("last.total")))
        .otherwise(empty)
    )
    start = F.lit(1)
    for portal in PORTALS:
        start = F.when(F.col("source") == portal.name, portal.first_page).otherwise(start)
    whole = (F.col("first_page") == start) & (F.col("pages") == F.col("last.page_no") - start + 1)
    # B counts adverts, not pages: a page landed twice must not stand for another.
    all_came = (F.col("landings") == F.col("pages")) & (F.col("offset") >= F.col("last.total")) & (F.col("offset") > 0)
    whole = whole | (F.coalesce(all_came, F.lit(False)) & (F.col("source") == PORTAL_B.name))
    sound = ~F.col("failed") & whole
    if strict:
        done = F.when(
            F.col("source") == PORTAL_C.name, whole & (F.col("failed") | ended)
        ).otherwise(sound & ended)
    else:
        done = sound & ended
    place = ["run_id", "source", "region"]
    regions = per_region.select(*place, F.coalesce(done, F.lit(False)).alias("done"))
    if expected:
        wanted = stats.sparkSession.createDataFrame(list(expected), "source string, region string")
        due = regions.select("run_id", "source").distinct().join(F.broadcast(wanted), "source")
        absent = due.join(regions, place, "left_anti").select(*place, F.lit(False).alias("done"))
        regions = regions.unionByName(absent)
    return regions.groupBy("run_id", "source").agg(F.bool_and("done").alias("completed"))
