"""Duplicate listings of one house: candidates, shared photos, links, clusters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.functions.geo import WGS84_A, WGS84_E2, geodesic_m, spheroid_xyz
from listinglens.functions.hashing import hamming
from listinglens.operators.components import connected_components
from listinglens.operators.hamming import similar_rows_within
from listinglens.operators.skew import hot_keys, join_hot_split
from listinglens.session import cut_lineage, ship_package
from listinglens.settings import DEFAULTS, Settings

CELL = ["cx", "cy", "cz"]
BAND = "area_band"
RADII_PER_CELL = 4
HOT_CELL_ROWS = 2_000

# Districts: physical choices, they change the plan, never the result.
DISTRICT = ["dx", "dy", "dz"]
CELLS_PER_DISTRICT = 8
#: Sights that a task compares at once; districts with more go by cells.
GROUP_ROWS = 50_000
#: Pairs of sights held at once.
BLOCK_PAIRS = 1 << 20


def comparable(listings: DataFrame) -> DataFrame:
    """Active listings that can be part of a duplicate pair at all."""
    return listings.filter(
        F.col("is_active")
        & F.col("deal_type").isNotNull()
        & F.col("usable_area_m2").isNotNull()
        & F.col("lat").isNotNull()
        & F.col("lng").isNotNull()
    ).select("id", "deal_type", "usable_area_m2", "lat", "lng")


def _in_cubes(df: DataFrame, names: list[str], side: float) -> DataFrame:
    """Adds the one cube with this side (earth-centred metres) that holds the point."""
    axes = spheroid_xyz(F.col("lat"), F.col("lng"))
    return df.select("*", *[F.floor(v / side).cast("long").alias(n) for v, n in zip(axes, names)])


def _in_reached_cubes(df: DataFrame, names: list[str], side: float, reach: float) -> DataFrame:
    """One row per cube within ``reach`` metres: 1 or 2 per axis."""
    out = df
    for value, name in zip(spheroid_xyz(F.col("lat"), F.col("lng")), names):
        low, high = F.floor((value - reach) / side), F.floor((value + reach) / side)
        out = out.withColumn(name, F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    return out


def in_cell(df: DataFrame, radius_m: float) -> DataFrame:
    """Adds the one cube of side 4 r (earth-centred metres) that holds the point."""
    return _in_cubes(df, CELL, radius_m * RADII_PER_CELL)


def in_reached_cells(df: DataFrame, radius_m: float) -> DataFrame:
    """One row per cube within ``radius_m``: 1 or 2 per axis.

    A straight line is never longer than the geodesic, so a neighbour within
    the radius is in one of these cubes, and it is met exactly once.
    """
    return _in_reached_cubes(df, CELL, radius_m * RADII_PER_CELL, radius_m * 1.001)


def _area_band(log_area: Column, settings: Settings) -> Column:
    """Bands twice as wide as two similar areas can be apart; areas below 1 have one of their own.

    Of those only equal zeros are similar. With a tolerance of 1 all is in one band.
    """
    if settings.area_tolerance >= 1:
        return F.lit(0).cast("long")
    width = 2 * _area_reach(settings)
    return F.when(F.col("usable_area_m2") > 0, F.floor(log_area / width)).otherwise(-1).cast("long")


def _area_reach(settings: Settings) -> float:
    """Largest difference of the logarithms of two similar areas, with slack for rounding."""
    if settings.area_tolerance >= 1:
        return 1e6
    return max(-math.log(1 - settings.area_tolerance) * 1.001, 0.01)


def in_band(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the one band of floor areas that holds the row's area."""
    return df.withColumn(BAND, _area_band(F.log("usable_area_m2"), settings))


def in_reached_bands(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per band that can hold a similar area: 1 or 2."""
    reach, log_area = _area_reach(settings), F.log("usable_area_m2")
    low, high = (_area_band(log_area + r, settings) for r in (-reach, reach))
    return df.withColumn(BAND, F.explode(F.sequence(low, high)))


def similar_area(a: Column, b: Column, settings: Settings) -> Column:
    return F.abs(a - b) <= settings.area_tolerance * F.greatest(a, b)


def dedupe_candidates(listings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pairs (a_id < b_id) of one deal type within 50 m and 10 % floor area."""
    return _candidates(comparable(listings), settings, F.lit(True))


def _candidates(
    base: DataFrame, settings: Settings, condition: Column, *also: str, around: DataFrame | None = None
) -> DataFrame:
    """Candidate pairs of ``base`` that meet ``condition`` on the columns ``also`` of both (a_..., b_...).

    With ``around`` the right ones are from there.
    """
    names = {"id": "id", "usable_area_m2": "area", "lat": "lat", "lng": "lng", **{c: c for c in also}}
    keys = ["deal_type", BAND, *CELL]
    left = in_cell(in_band(base, settings), settings.near_metres).select(
        *keys, *[F.col(n).alias(f"a_{short}") for n, short in names.items()]
    )
    reached = in_reached_bands(base if around is None else around, settings)
    right = in_reached_cells(reached, settings.near_metres).select(
        *keys, *[F.col(n).alias(f"b_{short}") for n, short in names.items()]
    )
    metres = geodesic_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    return join_hot_split(
        left,
        right,
        keys,
        hot_keys(left.select(*keys), keys, HOT_CELL_ROWS),
        salt_by=[F.col("a_id")],
        condition=(F.col("a_id") < F.col("b_id"))
        & similar_area(F.col("a_area"), F.col("b_area"), settings)
        & (metres <= settings.near_metres)
        & condition,
    ).select("a_id", "b_id")


def _photos(hashes: DataFrame) -> DataFrame:
    """(id, photos): the different photo values of a listing as one array."""
    return hashes.groupBy(F.col("listing_id").alias("id")).agg(F.collect_set("dhash").alias("photos"))


def _common_photo(settings: Settings) -> Column:
    def near(x: Column) -> Column:
        return F.exists("b_photos", lambda y: hamming(x, y) <= settings.hamming_max)

    return F.exists("a_photos", near)


def shared_photo(
    candidates: DataFrame, hashes: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The candidate pairs that show at least one common photo."""
    photos = _photos(hashes)
    a, b = (photos.select(F.col("id").alias(f"{x}_id"), F.col("photos").alias(f"{x}_photos")) for x in "ab")
    found = candidates.join(a, "a_id").join(b, "b_id").filter(_common_photo(settings))
    return found.select("a_id", "b_id").distinct()


def duplicate_pairs(
    listings: DataFrame, hashes: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """All candidate pairs that show a common photo, as :func:`shared_photo` gives them.

    Listings are compared by districts, those of crowded districts by cells: their
    photos ride along, so a candidate pair is judged where it meets and only
    duplicate pairs are shuffled.
    """
    base = cut_lineage(comparable(listings).join(_photos(hashes), "id"))
    home, side = ["deal_type", *DISTRICT], _district_side(settings)
    placed = _in_cubes(base, DISTRICT, side)
    sizes = cut_lineage(placed.groupBy(*home).agg(F.sum(F.size("photos")).alias("n")))
    crowded = F.broadcast(cut_lineage(sizes.filter(F.col("n") > GROUP_ROWS).select(*home)))
    around = _in_reached_districts(placed, settings)
    sights = around.join(crowded, home, "left_anti").withColumnRenamed("id", "rep")
    sights = sights.withColumn("dhash", F.explode("photos")).drop("photos")
    count = sizes.agg(F.sum("n")).first()[0] or 0
    quiet = _met_in_districts(sights, count, settings, once=True).filter(_duplicate(settings))
    some = placed.join(crowded, home, "left_semi").select(*base.columns)
    reached = around.join(crowded, home, "left_semi").select(*base.columns).distinct()
    busy = _candidates(some, settings, _common_photo(settings), "photos", around=reached)
    return quiet.select(F.col("a_rep").alias("a_id"), F.col("b_rep").alias("b_id")).unionByName(busy).distinct()


def _duplicate(settings: Settings) -> Column:
    """Whether a_... and b_... are sights of a duplicate pair, the lower one first."""
    metres = geodesic_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    return (
        (F.col("a_rep") < F.col("b_rep"))
        & similar_area(F.col("a_usable_area_m2"), F.col("b_usable_area_m2"), settings)
        & (hamming(F.col("a_dhash"), F.col("b_dhash")) <= settings.hamming_max)
        & (metres <= settings.near_metres)
    )


def duplicate_links(
    listings: DataFrame, hashes: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Sparse edges (a_id, b_id) with the same components as all duplicate pairs.

    Every edge is a true duplicate pair, but a group of n copies yields about n
    edges instead of n*(n-1)/2:

    * listings equal in deal, point, floor area and photo link to the lowest id;
    * what then differs in floor area only is chained in order of area (areas
      within 10 % of each other are linked through all areas between them);
    * the remaining distinct sights are compared within districts, in numpy; those of
      crowded districts within grid cells and bands of floor area, and in crowded cells
      the photo bands of the similarity join become part of the key.
    """
    site = ["deal_type", "lat", "lng", "usable_area_m2", "dhash"]
    photos = (
        comparable(listings)
        .join(hashes.select(F.col("listing_id").alias("id"), "dhash"), "id")
        .select("id", *site)
    )
    sights = cut_lineage(
        photos.groupBy(*site).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    )

    copies = (
        photos.join(sights.filter("n > 1").select(*site, "rep"), site)
        .filter("id <> rep")
        .select(F.col("rep").alias("a_id"), F.col("id").alias("b_id"))
    )

    # At most one row per distinct floor area is in a partition here.
    by_area = Window.partitionBy("deal_type", "lat", "lng", "dhash").orderBy("usable_area_m2")
    chained = (
        sights.select(
            "rep",
            "usable_area_m2",
            F.lag("rep").over(by_area).alias("_rep"),
            F.lag("usable_area_m2").over(by_area).alias("_area"),
        )
        .filter(similar_area(F.col("usable_area_m2"), F.col("_area"), settings))
        .select(F.col("_rep").alias("a_id"), F.col("rep").alias("b_id"))
    )

    across = _links_across(sights.select("rep", *site), settings)
    return (
        copies.unionByName(chained)
        .unionByName(across)
        .select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
        .filter("a_id <> b_id")
        .distinct()
    )


SIGHT = ["rep", "lat", "lng", "usable_area_m2", "dhash"]


def _links_across(sights: DataFrame, settings: Settings) -> DataFrame:
    """Links (a_id, b_id) between sights of different spots or photos, or of one with areas not beside each other."""
    same_spot = (
        (F.col("a_lat") == F.col("b_lat"))
        & (F.col("a_lng") == F.col("b_lng"))
        & (F.col("a_dhash") == F.col("b_dhash"))
    )
    condition = _duplicate(settings) & ~same_spot
    pair = [F.col("a_rep").alias("a_id"), F.col("b_rep").alias("b_id")]
    home = ["deal_type", *DISTRICT]
    placed = _in_cubes(sights, DISTRICT, _district_side(settings))
    crowded = cut_lineage(placed.groupBy(*home).agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_ROWS).select(*home))
    around = _in_reached_districts(placed, settings)
    if crowded.isEmpty():
        return _met_in_districts(around, sights.count(), settings).filter(condition).select(*pair)
    crowded = F.broadcast(crowded)  # at most one for GROUP_ROWS sights
    quiet = _met_in_districts(around.join(crowded, home, "left_anti"), sights.count(), settings)
    some = placed.join(crowded, home, "left_semi").select(*sights.columns)
    reached = around.join(crowded, home, "left_semi").select(*sights.columns).distinct()
    busy = _links_by_cells(some, reached, condition, settings)
    return quiet.filter(condition).select(*pair).unionByName(busy.select(*pair))


def _district_side(settings: Settings) -> float:
    return settings.near_metres * RADII_PER_CELL * CELLS_PER_DISTRICT


def _in_reached_districts(placed: DataFrame, settings: Settings) -> DataFrame:
    """One row per district within reach of the rows of ``placed``, their own kept as _dx, _dy, _dz."""
    own = [F.col(n).alias(f"_{n}") for n in DISTRICT]
    homes = placed.select("*", *own).drop(*DISTRICT)
    return _in_reached_cubes(homes, DISTRICT, _district_side(settings), settings.near_metres * 1.001)


def _met_in_districts(
    around: DataFrame, sights: int, settings: Settings, once: bool = False
) -> DataFrame:
    """Pairs (a_..., b_...) of sights with similar photos that may be near and alike, the left one at home in the district.

    ``around`` has a row per sight and district that it reaches, its own is _dx, _dy, _dz:
    1.1 rows, not the many of the cells. Districts are dealt to groups by hash.
    With ``once`` one pair of sights stands for all of two ``rep``.
    """
    spark = around.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, math.ceil(sights / GROUP_ROWS))
    at_home = [F.col(n) == F.col(f"_{n}") for n in DISTRICT]
    dealt = around.select(
        F.pmod(F.xxhash64(*DISTRICT), F.lit(groups)).cast("int").alias("part"),
        "deal_type",
        (at_home[0] & at_home[1] & at_home[2]).alias("home"),
        *SIGHT,
    ).filter(F.col("dhash").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in around.schema}
    schema = ", ".join(f"{s}_{n} {kinds[n]}" for s in "ab" for n in SIGHT)
    # Few bytes but long work: as many partitions as the session has, not fewer by size.
    dealt = dealt.repartition(parts, "part", "deal_type")
    return dealt.groupBy("part", "deal_type").applyInArrow(_compare_district(settings, once), schema)


def _compare_district(settings: Settings, once: bool):
    """Function of one group of sights -> pairs of a home one with a higher one that may be near and alike, with similar photos.

    Whether they are is decided by the caller; nothing that is gets lost here.
    """
    reach, tolerance = settings.near_metres * 1.001, min(settings.area_tolerance, 1.0)
    distance, cube = settings.hamming_max, max(reach, 20.0)

    def compare(rows: pa.Table) -> pa.Table:
        rep, dhash = rows.column("rep").to_numpy(), rows.column("dhash").to_numpy()
        area = rows.column("usable_area_m2").to_numpy().astype(np.float64)
        home = rows.column("home").to_numpy()
        point = np.stack(_xyz(*(rows.column(n).to_numpy() for n in ("lat", "lng"))), axis=1)
        # Rows in the order of cube and floor area; one cube more on each side, so that no step leaves the box.
        corner = np.floor(point / cube).astype(np.int64)
        corner -= corner.min(axis=0) - 1
        size = corner.max(axis=0) + 2
        steps = np.array([size[1] * size[2], size[2], 1])
        cubes, at = np.unique(corner @ steps, return_inverse=True)
        areas, level = np.unique(area, return_inverse=True)
        key = at * (len(areas) + 1) + level
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        low = np.searchsorted(areas, areas * (1 - tolerance) * (1 - 1e-9), "left")
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.searchsorted(areas, areas / (1 - tolerance) * (1 + 1e-9), "right")
        if tolerance >= 1:
            low, high = np.zeros_like(low), np.full_like(high, len(areas))
        left = np.flatnonzero(home[order])
        mine = level[order][left]
        near = np.arange(-1, 2)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for step in (near[:, None, None] * steps[0] + near[None, :, None] * steps[1] + near).ravel():
            target = np.searchsorted(cubes, cubes + step)
            target[target == len(cubes)] = 0
            other = target[at[left]]
            met = np.flatnonzero((cubes[target] == cubes + step)[at[left]])
            first = np.searchsorted(key, other[met] * (len(areas) + 1) + low[mine[met]])
            count = np.searchsorted(key, other[met] * (len(areas) + 1) + high[mine[met]]) - first
            ends = np.cumsum(count)
            start = 0
            while start < len(met):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - count[start] + BLOCK_PAIRS, "right")))
                n = count[start:stop]
                a = order[np.repeat(left[met[start:stop]], n)]
                b = order[np.arange(n.sum()) + np.repeat(first[start:stop] - np.cumsum(n) + n, n)]
                kept = np.bitwise_count((dhash[a] ^ dhash[b]).view(np.uint64)) <= distance
                a, b = a[kept], b[kept]
                kept = (rep[a] < rep[b]) & (((point[a] - point[b]) ** 2).sum(axis=1) <= reach * reach)
                found.append((a[kept], b[kept]))
                start = stop
        a, b = (np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*found) if found else ((), ())))
        if once and len(a):
            by_pair = np.lexsort((rep[b], rep[a]))
            first = np.ones(len(a), bool)
            first[1:] = (np.diff(rep[a][by_pair]) != 0) | (np.diff(rep[b][by_pair]) != 0)
            a, b = a[by_pair[first]], b[by_pair[first]]
        return pa.table({f"{s}_{n}": rows.column(n).take(pa.array(i)) for s, i in (("a", a), ("b", b)) for n in SIGHT})

    return compare


def _xyz(lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`listinglens.functions.geo.spheroid_xyz`."""
    phi, lam = np.radians(lat), np.radians(lng)
    n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(phi) ** 2)
    return n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - WGS84_E2) * np.sin(phi)


def _links_by_cells(some: DataFrame, sights: DataFrame, condition: Column, settings: Settings) -> DataFrame:
    """Pairs of ``some`` with ``sights`` that meet ``condition``, by cells and bands of floor area."""
    keys = ["deal_type", BAND, *CELL]
    left = in_cell(in_band(some, settings), settings.near_metres).select(
        *keys, *[F.col(n).alias(f"a_{n}") for n in SIGHT]
    )
    right = in_reached_cells(in_reached_bands(sights, settings), settings.near_metres).select(
        *keys, *[F.col(n).alias(f"b_{n}") for n in SIGHT]
    )
    crowded = hot_keys(left.select(*keys), keys, HOT_CELL_ROWS).select(*keys)
    quiet = (
        left.join(crowded, keys, "left_anti").join(right, keys).filter(condition)
    )
    busy = similar_rows_within(
        left.join(crowded, keys, "left_semi"),
        right.join(crowded, keys, "left_semi"),
        keys,
        F.col("a_dhash"),
        F.col("b_dhash"),
        condition,
        settings,
    )
    pair = ["a_rep", "b_rep"]
    return quiet.select(*pair).unionByName(busy.select(*pair))


def duplicate_components(
    listings: DataFrame, hashes: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """(id, component) of every active listing."""
    actives = listings.filter("is_active").select("id")
    return connected_components(actives, duplicate_links(listings, hashes, settings))


def build_clusters(listings: DataFrame, components: DataFrame) -> DataFrame:
    """One row per component; the cheapest member represents it, lowest id on ties."""
    members = listings.select("id", "price").join(components, "id")
    ranked = F.when(F.col("price").isNotNull(), F.struct("price", "id"))
    return members.groupBy(F.col("component").alias("cluster_id")).agg(
        F.coalesce(F.min(ranked)["id"], F.min("id")).alias("representative_listing_id"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("*").alias("member_count"),
    )


def assign_clusters(listings: DataFrame, components: DataFrame) -> DataFrame:
    """Cluster id of every listing: its component, or null when inactive."""
    fresh = components.select("id", F.col("component").alias("_component"))
    return (
        listings.join(fresh, "id", "left")
        .withColumn("cluster_id", F.col("_component"))
        .select(*listings.columns)
    )


def dedupe_summary(listings: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """active, edges, clusters, merged of one run; ``pairs`` are all duplicate pairs."""
    active = listings.filter("is_active").agg(F.count("*")).scalar()
    edges = pairs.agg(F.count("*")).scalar()
    return clusters.agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum(F.when(F.col("member_count") > 1, F.col("member_count"))), F.lit(0)).alias(
            "merged"
        ),
    ).select(active.alias("active"), edges.alias("edges"), "clusters", "merged")
