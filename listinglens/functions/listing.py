"""Scalar rules about one listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listinglens.functions.geo import haversine_km
from listinglens.functions.text import SPACE, SPACE_SET, trim_spaces
from listinglens.functions.variant import digits_to_number
from listinglens.settings import DEFAULTS, Settings


def js_round(value: Column) -> Column:
    """Half rounds up, also below zero."""
    return F.floor(value + F.lit(0.5)).cast("long")


def size_band(usable_area: Column, current: Column | None = None) -> Column:
    """Floor-area band, upper bound exclusive; without an area the band stays."""
    keep = current if current is not None else F.lit(None).cast("string")
    return (
        F.when(usable_area.isNull(), keep)
        .when(usable_area < 80, "<80")
        .when(usable_area < 120, "80-120")
        .when(usable_area < 200, "120-200")
        .otherwise("200+")
    )


def areas_from_name(name: Column) -> tuple[Column, Column]:
    """(usable, land) square metres read from an advert title."""
    # How the portal writes areas.
    run = rf"([0-9][0-9{SPACE_SET}]*){SPACE}*"
    usable = F.regexp_extract(name, run + "m(?:²|2)", 1)
    land = F.regexp_extract(name, rf"(?i)pozemek{SPACE}*" + run + "m", 1)
    return digits_to_number(usable), digits_to_number(land)


def classify_kind_a(sub_name: Column, name: Column) -> Column:
    """Sub-category decides first; the title is the fallback."""
    sub, title = F.lower(F.coalesce(sub_name, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(sub.contains("vila"), "vila")
        .when(sub.contains("chat") | sub.contains("chalup"), "recreational")
        .when(sub.contains("rodinn"), "rodinny_dum")
        .when(title.rlike("chat|chalup|rekrea"), "recreational")
        .when(title.contains("vil"), "vila")
        .when(title.rlike("rodinn|dům|domu|domek|usedlost"), "rodinny_dum")
        .otherwise("other")
    )


def classify_kind_b(title: Column) -> Column:
    """A villa word wins over a recreational one."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(t.contains("vil"), "vila")
        .when(t.rlike("chat|chalup|rekrea"), "recreational")
        .otherwise("rodinny_dum")
    )


def classify_kind_c(alt: Column) -> Column:
    """A recreational word wins over a villa one."""
    t = F.lower(F.coalesce(alt, F.lit("")))
    return (
        F.when(t.rlike("chat|chalup|rekrea"), "recreational")
        .when(t.contains("vil"), "vila")
        .otherwise("rodinny_dum")
    )


def locality_label(district: Column, *parts: Column) -> Column:
    """First non-empty part, prefixed by the district unless it names it already."""
    part = F.coalesce(*[F.when(p != "", p) for p in parts])
    prefixed = (district != "") & ~F.contains(part, district)
    return F.when(prefixed, F.concat(district, F.lit(" – "), part)).otherwise(
        F.coalesce(part, district)
    )


def disposition(code: Column) -> Column:
    """DISP_5_KK -> 5+kk, DISP_3_1 -> 3+1, DISP_5 -> 5, other -> null."""
    parts = F.split(F.regexp_replace(code, "^DISP_", ""), "_", -1)
    rooms, extra = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(
        code.startswith("DISP_") & (rooms != ""),
        F.when(extra == "KK", F.concat(rooms, F.lit("+kk")))
        .when(extra != "", F.concat(rooms, F.lit("+"), extra))
        .otherwise(rooms),
    )


def merge_gallery(main: Column, gallery: Column, limit: int | None = None) -> Column:
    """Main image, then the gallery, first occurrence of each kept in order."""
    lead = F.when(main.isNotNull(), F.array(main)).otherwise(F.array().cast("array<string>"))
    rest = F.coalesce(gallery, F.array().cast("array<string>"))
    merged = F.array_distinct(F.concat(lead, rest))
    return F.slice(merged, 1, limit) if limit else merged


def price_labels(old: Column, new: Column, exclusive: Column | None = None) -> Column:
    """EXCLUSIVE when flagged, LOWERED_PRICE when the old price was higher."""
    lowered = F.coalesce((old != 0) & (new != 0) & (old > new), F.lit(False))
    wanted = [F.when(lowered, F.lit("LOWERED_PRICE"))]
    if exclusive is not None:
        wanted.insert(0, F.when(exclusive, F.lit("EXCLUSIVE")))
    return F.filter(F.array(*wanted), lambda x: x.isNotNull())


def parse_alt(alt: Column) -> tuple[Column, Column]:
    """(area, locality) of an image caption: 2-4 digits before m², text after it."""
    area = F.regexp_extract(alt, rf"([0-9]{{2,4}}){SPACE}*m[²2]", 1)
    rest = F.get(F.split(alt, rf"m[²2]{SPACE}*", -1), F.lit(1))
    locality = trim_spaces(rest)
    return digits_to_number(area), F.when(locality != "", locality)


def parse_gps(html: Column) -> tuple[Column, Column]:
    """(lat, lng) written in page markup with three or more decimals."""
    # How the portal writes coordinates.
    gap, number = rf"[\"':={SPACE_SET}]{{1,4}}", r"([0-9]{1,2}\.[0-9]{3,})"
    lat = F.regexp_extract(html, rf"(?i)lat(?:itude)?{gap}{number}", 1)
    lng = F.regexp_extract(html, rf"(?i)(?:lng|lon)(?:gitude)?{gap}{number}", 1)
    return lat.try_cast("double"), lng.try_cast("double")


def price_per_m2(price: Column, area: Column) -> Column:
    """Rounded price per square metre when both are positive."""
    return F.when((price > 0) & (area > 0), js_round(F.try_divide(price.cast("double"), area)))


def distance_to_centre_km(lat: Column, lng: Column, settings: Settings = DEFAULTS) -> Column:
    return haversine_km(lat, lng, *settings.centre)


def settlement_class(population: Column, kind: Column) -> Column:
    """Size class by population, else by settlement type."""
    return (
        F.when(population < 500, "Hamlet")
        .when(population < 2000, "Village")
        .when(population < 25_000, "Town")
        .when(population < 100_000, "City")
        .when(population.isNotNull(), "Big city")
        .when(kind == "city", "Big city")
        .when(kind == "town", "Town")
        .when(kind == "hamlet", "Hamlet")
        .otherwise("Village")
    )


def status(
    scam_score: Column, is_good_deal: Column, verdict: Column, settings: Settings = DEFAULTS
) -> tuple[Column, Column]:
    """(label, tone) of the headline badge; nulls when there is none."""
    caution = scam_score >= settings.suspicious_score
    label = (
        F.when(caution, F.concat(F.lit("Caution · risk "), scam_score.cast("string"), F.lit("/100")))
        .when(is_good_deal, "Good deal")
        .when(verdict == "overpriced", "Overpriced")
        .when(verdict == "deal", "Below average")
    )
    tone = (
        F.when(caution, "caution")
        .when(is_good_deal, "deal")
        .when(verdict == "overpriced", "overpriced")
        .when(verdict == "deal", "deal")
    )
    return label, tone


def percentile_tone(percentile: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(percentile <= settings.deal_pct, "deal")
        .when(percentile >= settings.overpriced_pct, "overpriced")
        .otherwise("fair")
    )


def marker_tone(scam_score: Column, percentile: Column, settings: Settings = DEFAULTS) -> Column:
    """Map marker: caution overrides the price tone."""
    return F.when(scam_score >= settings.suspicious_score, "caution").otherwise(
        percentile_tone(percentile, settings)
    )


def since_label(mark: Column, now: Column) -> Column:
    """How long ago a mark was set, in the words of the feed header."""
    days = F.datediff(now, mark)
    return (
        F.when(days <= 0, "earlier today")
        .when(days == 1, "yesterday")
        .when(days < 7, F.date_format(mark, "EEEE"))
        .otherwise(F.date_format(mark, "MMM d"))
    )


def date_range_filter(value: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive whole days; an unreadable date fails unless no bound is set."""
    if not start and not end:
        return F.lit(True)
    stamp = value.try_cast("timestamp")
    keep = stamp.isNotNull()
    if start:
        keep = keep & (stamp >= F.to_date(F.lit(start)).cast("timestamp"))
    if end:
        keep = keep & (stamp < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp"))
    return F.coalesce(keep, F.lit(False))
