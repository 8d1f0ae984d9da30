from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
import xxhash

from listinglens.llm import mixing, simhash
from listinglens.llm.base import QUERIES
from listinglens.operators.components import connected_components
from tests.llm.conftest import ODD
from tests.llm.test_exact_tokens import SF, documents

# --- SimHash ---------------------------------------------------------------


def fingerprint_by_force(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    parts = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_force(prints, ids):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, doc_id in enumerate(ids):
        known = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(known, default=None)
    return [least[find(i)] for i in range(len(ids))]


def expected(rows):
    prints = [fingerprint_by_force(t or "") for _, t in rows]
    parts = components_by_force(prints, [i for i, _ in rows])
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, parts, strict=True)), key=str)


def test_odd_rows(odd, empty):
    got = [tuple(r) for r in simhash.simhash_components(odd).collect()]
    assert sorted(got, key=str) == expected([r[:2] for r in ODD])
    assert simhash.simhash_components(empty).count() == 0


def test_query_matches_brute_force(spark):
    got = [tuple(r) for r in QUERIES["op10_simhash_components"](spark, SF).collect()]
    assert sorted(got, key=str) == expected(documents())


def test_every_close_pair_shares_a_cell():
    rng = np.random.default_rng(3)
    masks = [m % (1 << 64) for m in simhash.grid_masks()]

    def unary(x):
        low = 0x5555555555555555
        return ((x | x >> 1) & low) | ((x & x >> 1) & low) << 1

    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        assert any(unary(a) & m == unary(b) & m for m in masks)
        assert (unary(a) ^ unary(b)).bit_count() <= (a ^ b).bit_count()


@pytest.mark.parametrize("crowd", [4, 64, 10_000])
def test_crowds_give_the_same_components(spark, crowd):
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 2**63, 3):
        for _ in range(120):
            x = int(base)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame(
        [(i, x - (1 << 64) if x >= 1 << 63 else x) for i, x in enumerate(values)], "doc_id long, fp long"
    )
    links = simhash.stored(simhash.fingerprint_links(df.select("fp"), crowd), "test-links")
    parts = connected_components(df.selectExpr("fp AS id"), links).join(df, df["fp"] == simhash.F.col("id")).toPandas()
    least = parts.groupby("component").doc_id.transform("min")
    got = dict(zip(parts.doc_id, least, strict=True))
    assert [got[i] for i in range(len(values))] == components_by_force(values, range(len(values)))


def test_drop_near_duplicates(odd):
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    prints = [fingerprint_by_force(r["text"] or "") for r in left.collect()]
    assert len(prints) == len({c for _, _, c in expected([r[:2] for r in ODD])})


# --- mixing ----------------------------------------------------------------


def targets_by_force(sizes, weights=(3, 1, 2), ratio=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = ratio * sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets():
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, None: 30, "z": 0}, {None: 7}, {"a": 0}):
        got = mixing.word_targets(sizes)
        want = targets_by_force(sizes)
        assert got == pytest.approx(want) and list(got) == sorted(sizes, key=mixing.source_order)


def test_query_comes_near_its_targets(spark):
    got = QUERIES["op4_mix_sources"](spark, SF).toPandas()
    rows = documents()
    assert sorted(got.doc_id) == [i for i, _ in rows]
    size = {i: len((t or "").split()) for i, t in rows}
    assert all(size[r.doc_id] == r.size and r.taken in (0, r.size, 2 * r.size) for r in got.itertuples())
    by = got.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.said).all()
    assert dict(by.target) == pytest.approx(targets_by_force(dict(by["size"])))
    assert ((by.taken - by.target).abs() <= got.groupby("source")["size"].max()).all()
    again = QUERIES["op4_mix_sources"](spark, SF).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_flow_routes_overlaps_without_needless_repeats():
    patterns = {("a",): 100, ("b",): 100, ("a", "b"): 100}
    sent = mixing.route(patterns, {"a": 190.0, "b": 110.0})
    assert {s: sum(w for p in sent.values() for x, w in p if x == s) for s in "ab"} == {"a": 190, "b": 110}
    assert all(sum(w for _, w in sent[p]) <= patterns[p] for p in patterns)  # 300 words, nothing twice


@pytest.mark.parametrize("seed", range(6))
def test_flow_cost_is_least(seed):
    """Against every way to route a few words."""
    rng = np.random.default_rng(seed)
    patterns = {("a",): int(rng.integers(0, 3)), ("b",): int(rng.integers(0, 3)), ("a", "b"): int(rng.integers(0, 3))}
    targets = {"a": float(rng.integers(0, 6)), "b": float(rng.integers(0, 6))}
    sent = mixing.route(patterns, targets)

    def judge(flows):  # (words that reach a quota, cost)
        used = {p: sum(w for _, w in f) for p, f in flows.items()}
        return sum(used.values()), -sum(max(0, used[p] - patterns[p]) for p in patterns)

    best = (0, 0)
    for a, b, x, y in itertools.product(range(5), repeat=4):
        flows = {("a",): [("a", a)], ("b",): [("b", b)], ("a", "b"): [("a", x), ("b", y)]}
        fits = a <= 2 * patterns["a",] and b <= 2 * patterns["b",] and x + y <= 2 * patterns["a", "b"]
        if fits and a + x <= targets["a"] and b + y <= targets["b"]:
            best = max(best, judge(flows))
    assert judge(sent) == best


def test_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a"] if i % 3 else ["b", "a"] if i % 2 else ["b"]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(df).collect()
    sizes = {"a": 0, "b": 0}
    taken = {"a": 0, "b": 0}
    for r in got:
        for s in r["sources"]:
            sizes[s] += r["size"]
        assert set(r["taken_for"]) <= set(r["sources"]) and r["copies"] == len(r["taken_for"]) <= 2
        for s in r["taken_for"]:
            taken[s] += r["size"]
    want = mixing.word_targets(sizes)
    words = sum(r["size"] for r in got)
    assert sum(taken.values()) <= 2 * words
    if sum(want.values()) <= 2 * words:
        assert taken == pytest.approx(want, abs=30)


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"]) == sorted(
        (i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in ODD if i
    )
    assert mixing.mix(empty).count() == 0
    used = mixing.take_mix(odd)
    assert used.columns == odd.columns
    assert sum(len((r["text"] or "").split()) for r in used.collect()) <= 2 * sum(r["size"] for r in got)
