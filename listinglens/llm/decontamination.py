"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question that was only
given other values keeps its template. Windows of five template words are
hashed and joined with those of the benchmark; a document that holds at least
80 % of an item's windows is aligned with the item by chains of matching runs,
and it is a leak if any chain covers as much and its slots are consistent: the
same value of the item always became the same value in the document, and the
other way round.
Every text is read twice, with its names and with placeholders for them, so a
passage in another case or in the middle of a sentence is still met.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, free_name, map_arrow, query, ship_package, stored, table
from listinglens.llm.words import WordRows, in_groups

WINDOW = 5
COVERAGE = 0.8
#: Most windows of the benchmark that are sent to the tasks as a filter (8 bytes
#: each). A larger benchmark is joined without it, with the same result.
FILTER_WINDOWS = 4_000_000
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£¥°]|[.!?\n]")

#: Words that count as numbers, and units (after a number).
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fifteen twenty thirty forty fifty "
    "sixty hundred thousand million".split()
)
UNITS = frozenset(
    "km m cm mm mile miles foot feet inch inches yard yards meter meters metre metres kilometer kilometers "
    "kilometre kilometres kg g mg ton tons lb lbs oz pound pounds gram grams kilogram kilograms l ml liter "
    "liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month "
    "months year years dollar dollars euro euros cent cents percent degree degrees mph kph".split()
)
SYMBOLS = frozenset("%$€£¥°")
_NUMBER, _NAME, _UNIT = 1, 2, 3
_IS_NUMBER, _IS_CAPITAL, _IS_UNIT, _IS_SYMBOL, _IS_END = 1, 2, 4, 8, 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _describe(tokens: list[str]) -> np.ndarray:
    """(hash, flags) of each distinct token."""
    import xxhash

    out = np.zeros((len(tokens), 2), np.uint64)
    for i, token in enumerate(tokens):
        low = token.lower()
        flags = 0
        if token in ".!?\n":
            flags = _IS_END
        elif token in SYMBOLS:
            flags = _IS_SYMBOL
        elif token[0].isdigit() or low in NUMBER_WORDS:
            flags = _IS_NUMBER
        else:
            shouted = len(token) > 1 and token.isupper()  # says nothing about names
            flags = _IS_UNIT * (low in UNITS) | _IS_CAPITAL * (token[0].isupper() and not shouted)
        out[i] = xxhash.xxh64_intdigest(low.encode()) | 8, flags  # clear of the placeholders
    return out


class Templates:
    """Template words and window hashes of many texts at once."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.known = WordRows(_describe, 2, 200_000, np.uint64)

    def words(self, found: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(code, text number, position among all tokens) of each template word.

        Once with names as they are, in any case, and once with placeholders
        for them. A name is a capitalised word inside a sentence; names in a
        row are one. A unit stands after a number, a symbol on either side.
        """
        counts = np.array([len(f) for f in found], np.int64)
        rows = self.known.of(found)
        code, flag = self.known.rows[rows, 0], self.known.rows[rows, 1].astype(np.int64)
        text = np.repeat(np.arange(len(found)), counts)
        opens = np.ones(len(code), bool)
        opens[1:] = (text[1:] != text[:-1]) | ((flag[:-1] & _IS_END) > 0)
        keep = np.flatnonzero((flag & _IS_END) == 0)
        code, flag, text, opens = code[keep], flag[keep], text[keep], opens[keep]
        number = (flag & _IS_NUMBER) > 0
        same = np.zeros(len(code), bool)
        same[1:] = text[1:] == text[:-1]
        after = np.zeros(len(code), bool)
        after[1:] = number[:-1] & same[1:]
        before = np.zeros(len(code), bool)
        before[:-1] = number[1:] & same[1:]
        name = ((flag & _IS_CAPITAL) > 0) & ~opens
        unit = (((flag & _IS_UNIT) > 0) & after) | (((flag & _IS_SYMBOL) > 0) & (after | before))
        code = np.where(number, np.uint64(_NUMBER), np.where(unit, np.uint64(_UNIT), code))
        named = np.where(name & ~number & ~unit, np.uint64(_NAME), code)
        joined = np.zeros(len(code), bool)
        joined[1:] = (named[1:] == _NAME) & (named[:-1] == _NAME) & same[1:]
        return [(code, text, keep), (named[~joined], text[~joined], keep[~joined])]

    def windows(self, code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every window.

        A text with fewer words than a window has one of all its words.
        """
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        sizes = np.diff(np.r_[starts, len(text)])
        hashes = np.zeros(len(code), np.uint64)
        ahead = np.concatenate([code, np.zeros(self.window, np.uint64)])
        short = bool((sizes < self.window).any())
        left = np.repeat(starts + sizes, sizes) - np.arange(len(code))  # words to the end of the text
        width = np.minimum(self.window, np.repeat(sizes, sizes))
        for j in range(self.window):
            mixed = (hashes ^ ahead[j : j + len(code)]) * _MULTIPLIER
            hashes = np.where(j < width, mixed, hashes) if short else mixed
            hashes ^= hashes >> np.uint64(31)
        first = np.flatnonzero(left >= width)
        return hashes[first].view(np.int64), first


def align(item: str, doc: str, coverage: float = COVERAGE, window: int = WINDOW) -> tuple[float, str] | None:
    """(coverage, kind) if ``doc`` holds ``item``; kind is verbatim or reparameterised."""
    own = Templates(window)
    tokens = [TOKEN.findall(item), TOKEN.findall(doc)]
    flat = [t for f in tokens for t in f]
    best = None
    for template in own.words(tokens):
        got = _align(own, template, flat, coverage)
        if got and got[1] == "verbatim":
            return got
        best = best or got
    return best


def _align(own: Templates, template: tuple, flat: list[str], coverage: float) -> tuple[float, str] | None:
    """The chain of runs that covers most; a verbatim one before any other.

    A run is a stretch of windows that follow each other in the item and in the
    document. Chains go forward in both, over any distance, so words put in or
    left out only cost the windows they break.
    """
    code, text, place = template
    window = own.window
    hashes, first = own.windows(code, text)
    split = int((text[first] == 0).sum())
    cut = int((text == 0).sum())
    item_hash, doc_hash = hashes[:split], hashes[split:]
    if not split or not len(doc_hash):
        return None
    order = np.argsort(doc_hash, kind="stable")
    low = np.searchsorted(doc_hash[order], item_hash, side="left")
    high = np.searchsorted(doc_hash[order], item_hash, side="right")
    if (high > low).sum() < coverage * split:
        return None
    i = np.repeat(np.arange(split), high - low)
    d = np.concatenate([order[a:b] for a, b in zip(low, high, strict=True)])
    by = np.lexsort((i, d - i))
    i, off = i[by], (d - i)[by]
    starts = np.flatnonzero(np.r_[True, (off[1:] != off[:-1]) | (i[1:] != i[:-1] + 1)])
    ends = np.r_[starts[1:], len(i)] - 1
    runs = np.stack([i[starts], i[ends], off[starts]])

    def slots(a: int, b: int, diagonal: int) -> list[tuple[int, str, str]]:
        """(kind, value in the item, value in the document) in the windows a to b."""
        out = []
        for j in range(a, min(b + window, cut)):
            at = cut + j + diagonal
            if code[j] <= _UNIT and at < len(code):
                out.append((int(code[j]), flat[place[j]].lower(), flat[place[at]].lower()))
        return out

    # The same from the end: where runs overlap, either may have the windows.
    turned = np.stack([split - 1 - runs[1], split - 1 - runs[0], len(doc_hash) - split - runs[2]])

    def turned_slots(a: int, b: int, diagonal: int) -> list[tuple[int, str, str]]:
        return slots(split - 1 - b, split - 1 - a, len(doc_hash) - split - diagonal)

    # Placeholders alone look alike in any text: only windows with a word tell a template.
    worded = np.convolve(code[:cut] > _UNIT, np.ones(min(window, cut), int))[min(window, cut) - 1 :][:split] > 0
    kinds = ("verbatim", "reparameterised") if worded.sum() >= coverage * split else ("verbatim",)
    for kind in kinds:
        got = [_chain(r, f, coverage * split, kind == "verbatim") for r, f in ((runs, slots), (turned, turned_slots))]
        if max(got):
            return max(got) / split, kind
    return None


def _chain(runs: np.ndarray, slots, least: float, same: bool) -> int:
    """Most windows in a chain of whole ``runs`` whose slots agree; 0 if below ``least``.

    ``runs`` are (first window, last window, diagonal). Of a run that overlaps
    the one before it the rest counts. Best first, by what a chain could still
    come to if slots did not matter; with ``same`` no value may change.
    """
    runs = runs[:, np.lexsort((runs[2], runs[1]))]
    first, last, diagonal = runs
    end = last + diagonal
    size = last - first + 1
    after = np.zeros(len(first), np.int64)

    def gains(r: int) -> tuple[np.ndarray, np.ndarray]:
        later = np.arange(np.searchsorted(last, last[r], side="right"), len(last))
        later = later[end[later] > end[r]]
        begin = np.maximum(np.maximum(first[later], last[r] + 1), end[r] + 1 - diagonal[later])
        return later, begin

    for r in range(len(first) - 1, -1, -1):
        later, begin = gains(r)
        if len(later):
            after[r] = (last[later] - begin + 1 + after[later]).max()

    # (-bound, -windows, gap in the document, number, run or -1 for an end, its first window, forth, back)
    heap: list[tuple] = []
    number = itertools.count()
    seen = set()
    for r in np.flatnonzero(size + after >= least).tolist():
        heapq.heappush(heap, (-int(size[r] + after[r]), -int(size[r]), 0, next(number), r, int(first[r]), {}, {}))
    while heap:
        bound, covered, _, _, r, begin, forth, back = heapq.heappop(heap)
        if r < 0:
            return -covered
        forth, back = dict(forth), dict(back)
        if not all(
            (not same or a == b) and forth.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a
            for kind, a, b in slots(begin, int(last[r]), int(diagonal[r]))
        ):
            continue
        state = (r, frozenset(() if same else forth.items()))
        if state in seen:  # by a chain that covers as much
            continue
        seen.add(state)
        if -covered >= least:
            heapq.heappush(heap, (covered, covered, 0, next(number), -1, 0, forth, back))
        later, begins = gains(r)
        total = last[later] - begins + 1 - covered
        for at in np.flatnonzero(total + after[later] >= least).tolist():
            s, b, n = int(later[at]), int(begins[at]), int(total[at])
            heapq.heappush(heap, (-(n + int(after[s])), -n, b + int(diagonal[s] - end[r]), next(number), s, b, forth, back))
    return 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, window: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, item_id, coverage, kind): which documents hold which items.

    ``benchmark`` has item_id and text. row_key is the hash of doc_id and text
    that tells rows with one doc_id apart; rows that are alike in both give one
    result. Null or blank texts hold nothing and items without words match
    nothing; an item shorter than a window only matches texts of just its words,
    one without an id is passed over; empty tables give no rows.
    """
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(window)
        for batch in batches:
            found = [TOKEN.findall(t) if t else [] for t in batch.column("text").to_pylist()]
            for mode, (code, text, _) in enumerate(own.words(found)):
                hashes, first = own.windows(code, text)
                pair = np.unique(np.stack([text[first], hashes], axis=1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
                total = np.bincount(pair[:, 0], minlength=len(found))[pair[:, 0]]
                ids = batch.column("item_id").take(pa.array(pair[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(pair), mode)), pa.array(pair[:, 1]), pa.array(total)],
                    names=["item_id", "mode", "hash", "windows"],
                )

    items = benchmark.filter("item_id is not null").select("item_id", "text").distinct()
    index = stored(
        map_arrow(items, item_windows, f"item_id {item_kind}, mode long, hash long, windows long").distinct(), "leak-index"
    )
    total, least = index.agg(F.countDistinct("hash"), F.min(F.ceil(F.col("windows") * coverage))).first()
    least = int(least or 1)
    known = None
    if total <= FILTER_WINDOWS:
        known = np.array(sorted(r["hash"] for r in index.select("hash").distinct().toLocalIterator()), np.int64)
    ship_package(spark)
    shared = spark.sparkContext.broadcast(known)  # at most FILTER_WINDOWS numbers

    def doc_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = Templates(window), shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [TOKEN.findall(t) for t in texts]
            for a, b in in_groups(found, 150_000):
                both = [(*own.windows(code, text), text) for code, text, _ in own.words(found[a:b])]
                hashes = np.concatenate([h for h, _, _ in both])
                text = np.concatenate([t[f] for _, f, t in both])
                if wanted is not None:
                    at = np.searchsorted(wanted, hashes)
                    hit = wanted[np.minimum(at, len(wanted) - 1)] == hashes if len(wanted) else np.zeros(len(hashes), bool)
                    hashes, text = hashes[hit], text[hit]
                order = np.argsort(text, kind="stable")
                hashes, text = hashes[order], text[order]
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                rows, lists = [], []
                for i in range(b - a):
                    if cuts[i + 1] - cuts[i] >= least:
                        own_hashes = np.unique(hashes[cuts[i] : cuts[i + 1]])
                        if len(own_hashes) >= least:
                            rows.append(a + i)
                            lists.append(own_hashes)
                if rows:
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in ("doc_id", "row_key", "text")] + [pa.array(lists, pa.list_(pa.int64()))],
                        names=["doc_id", "row_key", "text", "hashes"],
                    )

    # Only rows with enough windows of the benchmark go on, their texts with them.
    rows = docs.filter("text is not null").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text")
    )
    hits = stored(
        map_arrow(rows, doc_hits, f"doc_id {id_kind}, row_key long, text string, hashes array<long>"), "leak-hits"
    )
    pairs = (
        hits.select("row_key", F.explode("hashes").alias("hash"))
        .distinct()
        .join(broadcast_within(index, 40), "hash")
        .groupBy("row_key", "item_id", "mode", "windows")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= coverage * F.col("windows"))
        .select("row_key", "item_id")
        .distinct()
    )
    found = hits.drop("hashes").dropDuplicates(["row_key"]).join(pairs, "row_key")
    both = found.join(
        broadcast_within(items.withColumnRenamed("text", "item"), F.octet_length("item") + 16), "item_id"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [
                align(i, d, coverage, window)
                for i, d in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            part = batch.take(pa.array([i for i, g in enumerate(got) if g], pa.int64()))
            good = [g for g in got if g]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("doc_id", "row_key", "item_id")]
                + [pa.array([g[0] for g in good], pa.float64()), pa.array([g[1] for g in good], pa.string())],
                names=["doc_id", "row_key", "item_id", "coverage", "kind"],
            )

    schema = f"doc_id {id_kind}, row_key long, item_id {item_kind}, coverage double, kind string"
    return map_arrow(both.select("doc_id", "row_key", "text", "item_id", "item"), verify, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark."""
    leak = free_name(docs, "_leak")
    leaks = find_leaks(docs, benchmark).select(F.col("row_key").alias(leak)).distinct()
    return docs.join(broadcast_within(leaks, 8), F.xxhash64(docs["doc_id"], docs["text"]) == F.col(leak), "left_anti")


@query("op6_decontaminate")
def op6(spark, sf_dir):
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),  # at most the benchmark's items
        F.max("coverage").alias("coverage"),
        F.max("kind").alias("kind"),
    )
