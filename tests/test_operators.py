"""Distributed operators against brute force on small inputs."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from listinglens.operators import duplicates, stolen_photos
from listinglens.operators.components import connected_components
from listinglens.operators.hamming import similar_values
from listinglens.operators.nearest import nearest
from listinglens.operators.percentile import price_percentiles, with_percentiles
from listinglens.operators.skew import chunked_rank, nearest_non_null
from listinglens.operators.triage import fold_triage
from listinglens.schemas import LISTINGS, TRIAGE_OPS, conform
from listinglens.settings import DEFAULTS


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def bits(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_similar_values_is_exact(spark, hot_rows):
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64) if rng.random() < 0.7 else rng.getrandbits(16) << 4
        values.add(base)
        for _ in range(3):
            flipped = base
            for bit in rng.sample(range(64), rng.randint(1, 12)):
                flipped ^= 1 << bit
            values.add(flipped)
    values = [signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "dhash long")
    got = {tuple(r) for r in similar_values(df, df, replace(DEFAULTS, hot_key_rows=hot_rows)).collect()}
    want = {(a, b) for a in values for b in values if a != b and bits(a, b) <= 10}
    assert got == want and want


def test_similar_values_in_tiles_and_pieces(spark, monkeypatch):
    """Tiles named by some bits and cut into pieces give each pair once, for two sides that overlap."""
    from listinglens.operators import hamming

    monkeypatch.setattr(hamming, "PIECE_FACTOR", 1)
    monkeypatch.setattr(hamming, "_tile_bits", lambda values: 3)
    rng = random.Random(5)
    values = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(8):
            value = base
            for bit in rng.sample(range(64), rng.choice([0, 4, 8])):
                value ^= 1 << bit
            values.append(value)
    left, right = values[:60], values[30:]
    frames = [spark.createDataFrame([(signed(v),) for v in s] + [(None,)], "dhash long") for s in (left, right)]
    got = [(r["a"], r["b"]) for r in similar_values(*frames, replace(DEFAULTS, hot_key_rows=9)).collect()]
    want = {(signed(a), signed(b)) for a in left for b in right if a != b and bits(a, b) <= 10}
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("values", [100, 10**6, 10**9])
def test_values_go_to_eleven_tiles(values):
    """However many values there are, each is sent 11 times, and a pair is compared once in a band."""
    from listinglens.operators import hamming

    assert len(hamming._tiles(hamming._tile_bits(values))) == 11
    for band, radius in enumerate(hamming.RADII):
        parts = [set(hamming._flips(band, part).tolist()) for part in range(len(hamming.PARTS[radius]))]
        assert sum(map(len, parts)) == len(set().union(*parts)) == len(hamming._flips(band, None))
        assert set().union(*parts) == {f for f in range(1 << 16) if f.bit_count() <= radius}
        for (first, size), flips in zip(hamming.PARTS[radius], parts):
            assert not any(f >> first & (1 << size) - 1 for f in flips)


def test_crowded_codes_are_split_by_the_band_beside(monkeypatch):
    """Values that share a band's code are not all compared, and no similar pair is lost."""
    from listinglens.operators import hamming

    compared, pairs_of = [0], hamming._compared

    def counted(left, right, *rest):
        compared[0] += len(left) * len(right)
        return pairs_of(left, right, *rest)

    monkeypatch.setattr(hamming, "_compared", counted)
    monkeypatch.setattr(hamming, "CROWD", 1000)
    rng = np.random.default_rng(5)
    for band in range(hamming.BANDS):
        crowded = rng.integers(0, 2**64, 1500, dtype=np.uint64) & ~hamming._bits(band, 3)
        near = crowded[:300].copy()
        for _ in range(9):
            near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
        values = np.unique(np.concatenate([crowded, near]))
        want = {
            (a, b)
            for a, row in zip(values.tolist(), np.bitwise_count(values[:, None] ^ values[None, :]) <= 10)
            for b in values[row].tolist()
            if a < b
        }
        got = []
        for turn in range(hamming.BANDS):
            before = compared[0]
            a, b = hamming._fresh(hamming._near_pairs(values, values, turn, 10, once=True), turn)
            got += [(min(p), max(p)) for p in zip(a.tolist(), b.tolist())]
            if turn == band:
                # Eight codes hold most values; nearly all of them are within the radius of each other.
                assert compared[0] - before < 0.35 * len(values) ** 2
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_duplicate_pairs_are_judged_where_they_meet(spark):
    """As candidates and photos joined one after the other, but no candidate pair is shuffled."""
    rows = [(i, "sell", 100 + i % 3, 50.0, 14.0, True, None, 1) for i in range(40)]
    ldf = make_listings(spark, rows)
    photos = [(i, p, (i % 8) * 0x1111111111111 + p * 0x7777 if i else None) for i in range(40) for p in range(2)]
    hdf = spark.createDataFrame([(i, p, h) for i, p, h in photos], "listing_id long, position int, dhash long")
    pairs = duplicates.duplicate_pairs(ldf, hdf)
    got = [tuple(r) for r in pairs.collect()]
    known = {i: [h for j, _, h in photos if j == i and h is not None] for i in range(40)}
    want = {
        (a, b)
        for a in range(40)
        for b in range(a + 1, 40)
        if any(bits(x, y) <= 10 for x in known[a] for y in known[b])
    }
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {tuple(r) for r in duplicates.shared_photo(duplicates.dedupe_candidates(ldf), hdf).collect()} == want
    # Nothing but the two sides of the cells is joined.
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_candidates_do_not_meet_across_floor_areas(spark):
    """Adverts of one point only meet those of about their floor area."""
    rows = [(i, "sell", 20 + 40 * (i % 10), 50.0, 14.0, True, None, 1) for i in range(100)]
    base = duplicates.comparable(make_listings(spark, rows))
    left, right = duplicates.in_band(base), duplicates.in_reached_bands(base)
    assert left.count() == 100 and right.count() <= 200
    assert left.select("area_band").join(right.select("area_band"), "area_band").count() < 100 * 100 / 2
    got = {(r["a_id"], r["b_id"]) for r in duplicates.dedupe_candidates(make_listings(spark, rows)).collect()}
    areas = {r[0]: r[2] for r in rows}
    near = lambda x, y: abs(x - y) <= 0.1 * max(x, y)
    assert got == {(a, b) for a in areas for b in areas if a < b and near(areas[a], areas[b])}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(200))
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(i, i + 1) for i in range(150, 199)]  # a long chain
    edges += [(0, i) for i in range(100, 130)]  # a hub
    v = spark.createDataFrame([(n,) for n in nodes], "id long")
    e = spark.createDataFrame(edges, "a_id long, b_id long")
    got = {r["id"]: r["component"] for r in connected_components(v, e).collect()}
    assert got == union_find(nodes, edges)


def make_listings(spark, rows):
    columns = "id long, deal_type string, usable_area_m2 int, lat double, lng double, is_active boolean, cluster_id long, price long"
    return conform(spark.createDataFrame(rows, columns), LISTINGS)


def photo_world(seed, n=90):
    rng = random.Random(seed)
    spots = [(50.0 + i * 0.0002, 14.0 + (i % 3) * 0.0003) for i in range(6)] + [(49.0, 15.0)]
    photos = [rng.getrandbits(64) for _ in range(5)]
    listings, hashes = [], []
    for i in range(n):
        # The first spot and the first photo are hot.
        lat, lng = spots[0] if rng.random() < 0.4 else rng.choice(spots)
        located = rng.random() < 0.95
        listings.append(
            (
                i,
                "rent" if rng.random() < 0.1 else "sell",
                None if rng.random() < 0.05 else rng.randint(50, 90),
                lat if located else None,
                lng if located else None,
                rng.random() < 0.9,
                None,
                rng.choice([None, 100, 200]),
            )
        )
        for position in range(rng.randint(0, 3)):
            value = photos[0] if rng.random() < 0.3 else rng.choice(photos)
            for bit in rng.sample(range(64), rng.choice([0, 0, 2, 5, 9])):
                value ^= 1 << bit
            hashes.append((i, position, "u", signed(value)))
    return listings, hashes


def metres(a, b):
    mid = math.radians((a[0] + b[0]) / 2)
    e2 = (2 - 1 / 298.257223563) / 298.257223563
    w2 = 1 - e2 * math.sin(mid) ** 2
    north = math.radians(b[0] - a[0]) * 6378137 * (1 - e2) / w2**1.5
    east = math.radians(b[1] - a[1]) * 6378137 / math.sqrt(w2) * math.cos(mid)
    return math.hypot(north, east)


def brute_pairs(listings, hashes):
    photos = {}
    for owner, _, _, value in hashes:
        photos.setdefault(owner, []).append(value)
    pairs, candidates = set(), set()
    for a in listings:
        for b in listings:
            if not (a[0] < b[0] and a[5] and b[5] and a[1] == b[1]):
                continue
            if None in (a[2], b[2], a[3], b[3]) or abs(a[2] - b[2]) > 0.1 * max(a[2], b[2]):
                continue
            if metres(a[3:5], b[3:5]) > 50:
                continue
            candidates.add((a[0], b[0]))
            if any(bits(x, y) <= 10 for x in photos.get(a[0], []) for y in photos.get(b[0], [])):
                pairs.add((a[0], b[0]))
    return candidates, pairs


@pytest.mark.parametrize("crowd", [2_000, 4])
def test_duplicates_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(duplicates, "HOT_CELL_ROWS", crowd)
    settings = replace(DEFAULTS, hot_key_rows=5 if crowd == 4 else 20_000)
    listings, hashes = photo_world(3)
    candidates, pairs = brute_pairs(listings, hashes)
    ldf = make_listings(spark, listings)
    hdf = spark.createDataFrame(hashes, "listing_id long, position int, url string, dhash long")
    found = duplicates.dedupe_candidates(ldf, settings)
    assert {tuple(r) for r in found.collect()} == candidates
    assert {tuple(r) for r in duplicates.shared_photo(found, hdf, settings).collect()} == pairs
    links = {tuple(r) for r in duplicates.duplicate_links(ldf, hdf, settings).collect()}
    assert links <= pairs
    active = [row[0] for row in listings if row[5]]
    components = union_find(active, pairs)
    assert union_find(active, links) == components
    got = duplicates.duplicate_components(ldf, hdf, settings)
    assert {r["id"]: r["component"] for r in got.collect()} == components


@pytest.mark.parametrize("group_rows", [50_000, 12])
def test_links_across_districts_match_brute_force(spark, monkeypatch, group_rows):
    """A street through several districts; with few rows allowed, some go by cells."""
    monkeypatch.setattr(duplicates, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(duplicates, "BLOCK_PAIRS", 7)
    rng = random.Random(8)
    photos = [rng.getrandbits(64) for _ in range(3)]
    listings, hashes = [], []
    for i in range(160):
        lat = 50.0 + rng.randrange(90) * 0.0003 if i % 4 else 50.01
        kind = "rent" if rng.random() < 0.1 else "sell"
        listings.append((i, kind, rng.choice([0, 40, 60, 64, 90]), lat, 14.0, rng.random() < 0.9, None, 1))
        for position in range(2):
            value = rng.choice(photos) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            hashes.append((i, position, "u", signed(value) if rng.random() < 0.9 else None))
    _, pairs = brute_pairs(listings, [(i, p, u, v) for i, p, u, v in hashes if v is not None])
    ldf = make_listings(spark, listings)
    hdf = spark.createDataFrame(hashes, "listing_id long, position int, url string, dhash long")
    links = {tuple(r) for r in duplicates.duplicate_links(ldf, hdf).collect()}
    active = [row[0] for row in listings if row[5]]
    assert links <= pairs and union_find(active, links) == union_find(active, pairs)
    assert any(listings[a][3] != listings[b][3] for a, b in links)


def test_sights_are_dealt_out_about_once(spark, monkeypatch):
    """Sights that no crowd surrounds go to 1.1 groups each, not to every cell and band around."""
    rng = random.Random(8)
    listings = [(i, "sell", rng.randint(40, 200), 49 + rng.random(), 14 + rng.random(), True, None, 1) for i in range(2000)]
    hashes = [(i, 0, "u", signed(rng.getrandbits(64))) for i in range(2000)]
    dealt, met = [], duplicates._met_in_districts

    def counted(around, *rest):
        dealt.append(around.count())
        return met(around, *rest)

    monkeypatch.setattr(duplicates, "_met_in_districts", counted)
    links = duplicates.duplicate_links(
        make_listings(spark, listings),
        spark.createDataFrame(hashes, "listing_id long, position int, url string, dhash long"),
    )
    assert links.count() == 0 and 2000 <= dealt[0] < 1.4 * 2000
    assert "area_band" not in links._jdf.queryExecution().optimizedPlan().toString()


def test_copies_give_linear_links(spark):
    """A group of n identical adverts yields n-1 links, not all pairs."""
    rows = [(i, "sell", 70, 50.0, 14.0, True, None, 1) for i in range(300)]
    hashes = [(i, 0, "u", 12345) for i in range(300)]
    links = duplicates.duplicate_links(
        make_listings(spark, rows),
        spark.createDataFrame(hashes, "listing_id long, position int, url string, dhash long"),
    )
    assert links.count() == 299


@pytest.mark.parametrize("spread", [0.0002, 0.008, 0.03])
def test_far_photos_match_brute_force(spark, spread):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(4)]
    listings, hashes = [], []
    for i in range(70):
        located = rng.random() < 0.9
        lat = 50 + rng.randint(0, 4) * spread if located else None
        lng = 14 + rng.randint(0, 4) * spread if located else None
        cluster = rng.choice([None, 1, 2, i])
        listings.append((i, "sell", 70, lat, lng, rng.random() < 0.8, cluster, 1))
        for position in range(rng.randint(1, 4)):
            value = rng.choice(base)
            for bit in rng.sample(range(64), rng.choice([0, 3, 6])):
                value ^= 1 << bit
            hashes.append((i, position, "u", signed(value)))
    by_id = {r[0]: r for r in listings}
    want = {}
    for a, position, _, x in hashes:
        la = by_id[a]
        if not la[5] or la[3] is None:
            continue
        for b, _, _, y in hashes:
            lb = by_id[b]
            if a == b or lb[3] is None or la[6] == lb[6] or bits(x, y) > 10:
                continue
            if metres(la[3:5], lb[3:5]) > 2000:
                want.setdefault(a, set()).add(position)
    got = stolen_photos.far_shared_photos(
        make_listings(spark, listings),
        spark.createDataFrame(hashes, "listing_id long, position int, url string, dhash long"),
    )
    assert {r["listing_id"]: r["shared"] for r in got.collect()} == {a: len(p) for a, p in want.items()}


def test_photos_of_one_cluster_need_no_places(spark, monkeypatch):
    """Places are gathered for photo values that several clusters show, not for all."""
    rng = random.Random(4)
    listings, hashes = [], []
    for house in range(60):
        base, lat = rng.getrandbits(64), 50 + rng.random()
        for i in range(3 * house, 3 * house + 3):
            listings.append((i, "sell", 70, lat, 14.0, True, 3 * house, 1))
            hashes += [(i, p, "u", signed(base ^ (i % 3) << 8 * p)) for p in range(3)]
    # The last two houses show one photo, the two before them similar ones.
    hashes += [(177, 9, "u", 5), (174, 9, "u", 5), (171, 9, "u", 0xFF0000), (168, 9, "u", 0x1EF0000)]
    spots, gathered = [], stolen_photos._outermost

    def counted(some):
        spots.append(some.count())
        return gathered(some)

    monkeypatch.setattr(stolen_photos, "_outermost", counted)
    got = stolen_photos.far_shared_photos(
        make_listings(spark, listings),
        spark.createDataFrame(hashes, "listing_id long, position int, url string, dhash long"),
    )
    assert {r["listing_id"]: r["shared"] for r in got.collect()} == {177: 1, 174: 1, 171: 1, 168: 1}
    assert sum(spots) <= 8


def test_nearest_anywhere_on_the_globe(spark):
    rng = random.Random(9)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    points += [(50 + rng.random(), 14 + rng.random()) for _ in range(60)] + [(90.0, 0.0), (0.0, 180.0)]
    dim = [(i, 50 + rng.random(), 14 + rng.random()) for i in range(40)]
    dim += [(40, 0.0, -179.9), (41, -89.0, 10.0), (42, 50.5, 14.5), (43, 50.5, 14.5)]

    def km(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2
        h += math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    pdf = spark.createDataFrame(points, "lat double, lng double")
    ddf = spark.createDataFrame(dim, "ord long, lat double, lng double")
    got = {(r["lat"], r["lng"]): r for r in nearest(pdf, ddf).collect()}
    assert len(got) == len(points)
    for p in points:
        best = min(km(p, d[1:]) for d in dim)
        assert got[p]["km"] == pytest.approx(best, abs=1e-6)
    tied = nearest(spark.createDataFrame([(50.5, 14.5)], "lat double, lng double"), ddf).first()
    assert tied["ord"] == 42


def test_nearest_compares_few_of_dense_references(spark):
    from listinglens.operators.nearest import CUBE, _cubes, candidates

    dim = [(i, 50 + i // 20 * 0.0027, 14 + i % 20 * 0.0042) for i in range(400)]  # 300 m apart
    ddf = spark.createDataFrame(dim, "ord long, lat double, lng double")
    point = spark.createDataFrame([(50.026, 14.042)], "lat double, lng double")
    cubes = point.select(*[c.alias(n) for c, n in zip(_cubes(F.col("lat"), F.col("lng")), CUBE)])
    assert 1 <= candidates(cubes, ddf).count() < 200


def test_percentile_levels_and_mean(spark):
    rows = [("A", "<80", v) for v in range(1, 9)]  # 8 samples: bucket of its own
    rows += [("B", "<80", 3), ("B", "80-120", 7)]  # falls back to the band, then to all
    rows += [(None, None, 5), ("", "", 5)]
    df = spark.createDataFrame(
        rows, "cadastral_code string, size_band string, price_per_usable_m2 int"
    )
    got = {
        (r["code"], r["band"], r["value"]): r for r in price_percentiles(df).collect()
    }
    assert got[("A", "<80", 1)]["bucket_key"] == "A|<80"
    assert got[("A", "<80", 1)]["percentile"] == 6.25
    assert got[("B", "<80", 3)]["bucket_key"] == "band:<80"
    assert got[("B", "80-120", 7)]["bucket_key"] == "all"
    assert got[(None, None, 5)]["bucket_key"] == "all"
    assert got[("A", "<80", 1)]["percentile_confidence"] == "high"
    assert got[(None, None, 5)]["percentile_confidence"] == "low"
    own = [got[("A", "<80", v)]["percentile"] for v in range(1, 9)]
    assert sum(own) / 8 == pytest.approx(50)
    assert with_percentiles(df).count() == len(rows)


def test_single_sample_has_no_percentile(spark):
    df = spark.createDataFrame(
        [("A", "<80", 5)], "cadastral_code string, size_band string, price_per_usable_m2 int"
    )
    assert price_percentiles(df).count() == 0


def test_two_level_windows_match_plain_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), t // 7, t, rng.choice([None, t])) for t in range(60)]
    df = spark.createDataFrame(rows, "k string, chunk int, t int, v int")
    ranked = chunked_rank(df, ["chunk"], [F.col("t")], "rn", ["k"])
    for key in "ab":
        order = [r for r in rows if r[0] == key]
        got = sorted((r["rn"], r["t"]) for r in ranked.filter(F.col("k") == key).collect())
        assert got == [(i + 1, r[2]) for i, r in enumerate(order)]
        for after in (False, True):
            near = nearest_non_null(df, ["k"], "chunk", ["t"], "v", "n", after=after)
            found = {r["t"]: r["n"] for r in near.filter(F.col("k") == key).collect()}
            for i, r in enumerate(order):
                others = order[i + 1 :] if after else order[:i][::-1]
                assert found[r[2]] == next((o[3] for o in others if o[3] is not None), None)


def test_fold_triage_matches_replay(spark):
    import datetime as dt

    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    ops, state = [], {}
    for seq in range(500):
        user, cluster = rng.randint(1, 3), rng.randint(1, 8)
        ts = start + dt.timedelta(hours=seq // 2)
        op = rng.choices(["set", "delete", "clear"], [8, 1, 1])[0]
        kind = rng.choice(["seen", "shortlist"])
        key = (user, cluster)
        if op == "set":
            state[key] = (kind, state[key][1] if key in state else ts)
            ops.append((user, seq, ts, op, cluster, kind))
        elif op == "delete":
            state.pop(key, None)
            ops.append((user, seq, ts, op, cluster, None))
        else:
            for other in [k for k, v in state.items() if k[0] == user and v[0] == kind]:
                del state[other]
            ops.append((user, seq, ts, op, None, kind))
    got = fold_triage(spark.createDataFrame(ops, TRIAGE_OPS)).select(
        "user_id", "cluster_id", "state", F.unix_micros("created_at").alias("at")
    )
    want = {
        (u, c, s, int(t.timestamp() * 1e6)) for (u, c), (s, t) in state.items()
    }
    assert {tuple(r) for r in got.collect()} == want
