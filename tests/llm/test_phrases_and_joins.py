"""Importance resampling, collocations and the shingle join against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from listinglens.llm import collocations, resampling, shinglejoin
from listinglens.llm.base import ORACLES, QUERIES
from tests.llm.conftest import COLUMNS, ODD
from workload.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["op11_collocations", "op12_shingle_join", "op13_importance_resampling"])
def test_query_matches_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, name, SF, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- importance resampling -------------------------------------------------


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % 10_000 for r in runs]


def resampled_by_force(docs, target, percent, least):
    s = Counter(b for _, text in docs for b in features(text)[1])
    t = Counter(b for text in target for b in features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        share = float(t[b] + 1) * float(total_s + 10_000) / (float(s[b] + 1) * float(total_t + 10_000))
        return math.floor(1000 * math.log(share))

    out = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(map(gain, found))
        name = f"42:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words)])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_runs_are_named_by_their_checksum():
    random.seed(1)
    words = [bytes(random.choices(b"abz09\xc3\xa9", k=random.choice([1, 3, 62, 63, 64, 65, 200, 5000]))) for _ in range(60)]
    found = resampling.RunBuckets(1 << 31)(words)
    for n, got in enumerate(found, 1):
        want = [zlib.crc32(b" ".join(words[i : i + n])) % (1 << 31) for i in range(len(words) - n + 1)]
        assert got.tolist() == want


def test_resampling_equals_brute_force(spark):
    random.seed(2)
    vocabulary = ["Ah", "be", "see", "dé", "e5", "x" * 70]
    lines = ["".join(random.choice(vocabulary) + random.choice(" ,-") for _ in range(random.randrange(5))) for _ in range(12)]
    texts = ["\n".join(random.choices(lines, k=random.randrange(12))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in ODD]
    target = [*lines[:3], None, "be be\nbe"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, bench, percent=30, least_words=5)
    assert rows_of(got) == resampled_by_force(docs, target, 30, 5)


# --- collocations ----------------------------------------------------------


def collocations_by_force(docs, top, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            around = [
                b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if any(100 * b >= 80 * a for b in around):
                continue
            score, _, left, right = min(
                (2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            )
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=str)


def test_tiles_count_every_cell_once():
    """Dense, sparse, merged and handed on before the end."""
    rng = np.random.default_rng(5)
    ranked = np.arange(2, 6, dtype=np.uint64).reshape(-1, 1)
    tiles, want, blocks = collocations.Tiles(ranked, ranked, 7), Counter(), []
    for _ in range(20):
        a, b = rng.integers(2, 40, (2, 500)).astype(np.uint64)
        tiles.add(a, [a, b])
        want.update(zip(a.tolist(), b.tolist(), strict=True))
        blocks += tiles.overflow(600)
    assert blocks
    blocks += tiles.rest()
    got, owners = Counter(), defaultdict(set)
    for batch in blocks:
        for row in batch.to_pylist():
            words = np.frombuffer(row["words"], np.uint64).reshape(2, -1)
            for x, y, n in zip(*words.tolist(), np.frombuffer(row["n"], np.int64).tolist(), strict=True):
                got[x, y] += n
                owners[x, y].add(row["tile"])
    assert got == want and all(len(t) == 1 for t in owners.values())


@pytest.mark.parametrize("dense", [1024, 3])
def test_collocations_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(collocations, "DENSE", dense)
    random.seed(3)
    vocabulary = ["the", "of", "Sea", "é", "new\x0byork", "a\x00b", *[f"w{i}" for i in range(12)]]
    docs = []
    for i in range(150):
        words = random.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=random.randrange(60))
        text = "".join(w + random.choice([" ", " ", " ", "\t", ". ", "  "]) for w in words)
        docs.append((random.choice(["en", "de", None, "und"]), text))
    docs += [(r[2], r[1]) for r in ODD]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = collocations.collocations(df, top=15, least=4)
    assert rows_of(got) == collocations_by_force(docs, 15, 4)


# --- shingle join ----------------------------------------------------------


def components_by_force(docs, percent):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        parts = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [tuple(words)] * bool(words)
        sets.append(frozenset(parts))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        known = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(known, default=None)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def near_copies(seed):
    random.seed(seed)
    docs = []
    for _ in range(4):
        base = [f"w{random.randrange(400)}" for _ in range(random.randrange(60, 140))]
        for _ in range(25):
            copy = list(base)
            for _ in range(random.randrange(4)):
                copy[random.randrange(len(copy))] = f"x{random.randrange(10_000)}"
            docs.append(" ".join(copy))
    docs += [f"a b c d e f g h i j k{i}" for i in range(5)] + ["one", "one", "two words", "Two  words"]
    random.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("crowd, block, most", [(32, 500, 1 << 20), (2, 7, 1 << 20), (4, 500, 0)])
def test_shingle_join_equals_brute_force(spark, monkeypatch, crowd, block, most):
    """Also with all columns multiplied in small blocks, and without known frequencies."""
    monkeypatch.setattr(shinglejoin, "BLOCK_ROWS", block)
    monkeypatch.setattr(shinglejoin, "MOST_FREQUENT", most)
    docs = near_copies(crowd) + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(shinglejoin.shingle_components(df, crowd=crowd)) == components_by_force(docs, 90)


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for size in (5, 60, 900):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        b = np.unique(np.concatenate([a[size // 10 :], rng.integers(0, 1 << 63, size // 8, np.uint64)]))
        bytes_apart = sum(x != y for x, y in zip(shinglejoin.sketch(a), shinglejoin.sketch(b), strict=True))
        assert bytes_apart <= len(np.setxor1d(a, b))


# --- edges -----------------------------------------------------------------


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert collocations.collocations(empty).count() == 0
    assert shinglejoin.shingle_components(empty).count() == 0
    assert resampling.resample(empty, bench).count() == 0


def test_clashing_columns_change_nothing(spark, odd):
    plain = spark.createDataFrame(ODD, COLUMNS)
    bench = plain.select("doc_id", "text")
    assert rows_of(shinglejoin.shingle_components(odd)) == rows_of(shinglejoin.shingle_components(plain))
    assert rows_of(collocations.collocations(odd, least=2)) == rows_of(collocations.collocations(plain, least=2))
    assert rows_of(resampling.resample(odd, bench)) == rows_of(resampling.resample(plain, bench))
