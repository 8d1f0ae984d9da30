"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans. The field looks at the surroundings of digits,
at-signs and spelled-out dots that no base span covers: candidate segments of a
bounded number of tokens are scored by features of the whole span (its shape,
digits, checksum, neighbours), and one dynamic program chooses boundaries and
types together. It learns from the corpus: base spans of a bounded sample are
the gold segments, as they are and rewritten the way people disguise them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.base import map_arrow, query, ship_package, table

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field learns from, at most about so many, and its windows.
TRAIN_DOCS, TRAIN_WINDOWS = 6000, 1500
MOST_TOKENS = 14
AROUND = 10
WEIGHTS = 1 << 14
STEPS, RATE, SEED = 5000, 0.2, 11

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Leftmost matches start where a run of digits starts, which keeps this linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: How people spell out the signs of an address.
AT_WORDS, DOT_WORDS = frozenset({"at", "arroba", "chez", "ät"}), frozenset({"dot", "punto", "point", "punkt"})
_TRIGGER = re.compile(r"[0-9@]|\b(?:dot|punto|point|punkt)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches, failing ones dropped."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        tail = _DOMAIN.match(text, at + 1)
        start = at
        if tail:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if tail and start < at:
            out.append(("email", start, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- the field -------------------------------------------------------------


@dataclass
class Window:
    """Tokens (start, end) of a stretch of text, and its candidate segments."""

    text: str
    tokens: list[tuple[int, int]]
    segments: list[tuple[int, int]]  # first token, last token + 1
    features: list[np.ndarray]


def _kind_of(token: str) -> str:
    if token.isdecimal():
        return f"d{min(len(token), 20)}"
    low = token.lower()
    return "AT" if low in AT_WORDS else "DOT" if low in DOT_WORDS else "a" if token[0].isalpha() else token


def _features(text: str, tokens: list[tuple[int, int]], names: list[str], i: int, j: int) -> np.ndarray:
    shape = []
    for k in range(i, j):
        if k > i and tokens[k][0] > tokens[k - 1][1]:
            shape.append(" ")
        shape.append(names[k])
    fine = "".join(shape)
    coarse = re.sub(r"d\d+", "d", fine)
    digits = "".join(text[a:b] for a, b in tokens[i:j] if text[a:b].isdecimal())
    groups = [text[a:b] for a, b in tokens[i:j] if text[a:b].isdecimal()]
    left = "^" if i == 0 else names[i - 1][0] + " " * (tokens[i][0] > tokens[i - 1][1])
    right = "$" if j == len(tokens) else " " * (tokens[j][0] > tokens[j - 1][1]) + names[j][0]
    at = re.search("AT|@", coarse)
    before, tail = coarse[: at.start()].rstrip() if at else "", re.split(r"DOT|\.", coarse)[-1].strip("])} ")
    found = [
        "bias",
        f"spaces before at {before.count(' ') if at else None}",
        f"after the last dot {tail if at else None}",
        f"fine {fine}",
        f"coarse {coarse}",
        f"digits {len(digits)}",
        f"tokens {j - i}",
        f"left {left}",
        f"right {right}",
        f"first {coarse[0]}",
        f"last {coarse[-1]}",
        f"signs {'@' in fine}{'AT' in fine}{'DOT' in fine}{'.' in fine}",
        f"luhn {13 <= len(digits) <= 19 and luhn(digits) if digits.isascii() and digits else None}",
        f"parts {len(groups)} {len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)}",
    ]
    return np.array([zlib.crc32(f.encode()) % WEIGHTS for f in found])


def make_windows(text: str, taken: list[tuple[int, int]]) -> list[Window]:
    """Stretches around triggers outside the ``taken`` spans, with candidates.

    A segment has at most MOST_TOKENS tokens, starts and ends with a word, a
    number or a sign that may, and holds nine digits, four numbers, an at-sign,
    or a spelled at and dot.
    """
    if not _TRIGGER.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    names = [_kind_of(text[a:b]) for a, b in tokens]
    free = np.ones(len(tokens), bool)
    starts = np.array([a for a, _ in tokens])
    ends = np.array([b for _, b in tokens])
    for a, b in taken:
        free[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = False
    digits = np.array([b - a if n[0] == "d" else 0 for (a, b), n in zip(tokens, names, strict=True)])
    sign = np.array([n == "@" for n in names])
    spelled_at, spelled_dot = np.array([n == "AT" for n in names]), np.array([n == "DOT" for n in names])
    trigger = np.flatnonzero(((digits > 0) | sign | spelled_dot) & free)
    if not len(trigger):
        return []
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (digits, sign, spelled_at, spelled_dot, ~free, digits > 0)]
    out, at = [], 0
    while at < len(trigger):
        low, last = max(0, int(trigger[at]) - AROUND), int(trigger[at])
        while at < len(trigger) and trigger[at] <= last + AROUND:
            last = int(trigger[at])
            at += 1
        high = min(len(tokens), last + AROUND + 1)
        segments, features = [], []
        for i in range(low, high):
            if not free[i] or not (names[i][0] in "da+(" or names[i] in ("AT", "DOT")):
                continue
            for j in range(i + 1, min(high, i + MOST_TOKENS) + 1):
                d, s, a, o, t, g = (int(x[j] - x[i]) for x in sums)
                if t:
                    break
                if (d >= 9 or g == 4 or s or (a and o)) and names[j - 1][0] in "daAD":
                    segments.append((i - low, j - low))
                    features.append(_features(text, tokens, names, i, j))
        if segments:
            out.append(Window(text, tokens[low:high], segments, features))
    return out


class SemiMarkovField:
    """Weights by type and feature; a token outside a segment scores nothing."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), WEIGHTS)) if weights is None else weights

    def scores(self, window: Window) -> np.ndarray:
        """[segments, kinds]"""
        return self.w[:, np.stack(window.features)].sum(axis=2).T

    def decode(self, window: Window) -> list[tuple[str, int, int]]:
        """The best segmentation: (kind, start, end) in the text."""
        scores = self.scores(window)
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(window.segments):
            ending.setdefault(j, []).append(k)
        best, came = [0.0], [(-1, -1)]
        for j in range(1, len(window.tokens) + 1):
            top, how = best[j - 1], (-1, -1)
            for k in ending.get(j, ()):
                kind = int(scores[k].argmax())
                value = best[window.segments[k][0]] + scores[k, kind]
                if value > top:
                    top, how = value, (k, kind)
            best.append(top)
            came.append(how)
        out, j = [], len(window.tokens)
        while j > 0:
            k, kind = came[j]
            if k < 0:
                j -= 1
            else:
                i = window.segments[k][0]
                out.append((KINDS[kind], window.tokens[i][0], window.tokens[j - 1][1]))
                j = i
        return out[::-1]

    def gradient(self, window: Window, gold: dict[int, int]) -> tuple[np.ndarray, float]:
        """([segments, kinds] of gold less expected, log likelihood)."""
        scores, n = self.scores(window), len(window.tokens)
        pooled = np.logaddexp.reduce(scores, axis=1)
        forth, back = np.zeros(n + 1), np.zeros(n + 1)
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(window.segments):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        for j in range(1, n + 1):
            forth[j] = np.logaddexp.reduce(
                [forth[j - 1], *(forth[window.segments[k][0]] + pooled[k] for k in ending.get(j, ()))]
            )
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce(
                [back[i + 1], *(back[window.segments[k][1]] + pooled[k] for k in starting.get(i, ()))]
            )
        first = np.array([forth[i] for i, _ in window.segments])
        rest = np.array([back[j] for _, j in window.segments])
        diff = -np.exp(first[:, None] + scores + rest[:, None] - forth[n])
        total = -forth[n]
        for k, kind in gold.items():
            diff[k, kind] += 1
            total += scores[k, kind]
        return diff, total


def _disguise(kind: str, value: str, style: int) -> str:
    """``value`` in one of the ways to write it that the patterns miss.

    Three ways, and for addresses the same three for a shorter one.
    """
    pick = style % 3
    if kind == "email":
        local, domain = value.split("@", 1)
        if style >= 3:
            local = re.sub("[^A-Za-z]", "", local) or local
            domain = ".".join(re.sub("[0-9]", "", domain).split(".")[-2:])
        at = (" at ", " (at) ", "[at]")[pick]
        return local + at + domain.replace(".", (" dot ", " (dot) ", "[dot]")[pick])
    if kind == "ip":
        return value.replace(".", ("[.]", " . ", "[.]")[pick])
    digits = re.sub(r"\D", "", value)
    if kind == "phone" and len(digits) > 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")[pick]
    return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if kind == "card" else value


def fit(snippets: list[str], seed: int = SEED) -> SemiMarkovField:
    """Train on stretches of text by gradient ascent on the likelihood."""
    rng = np.random.default_rng(seed)
    examples: list[tuple[Window, dict[int, int]]] = []
    for text in snippets:
        found = base_spans(text)
        for style in (None, *range(6)) if found else (None,):
            parts, gold, at = [], [], 0
            for kind, a, b in sorted(found, key=lambda s: s[1]):
                if a < at:
                    continue
                parts.append(text[at:a])
                value = text[a:b] if style is None else _disguise(kind, text[a:b], style)
                start = sum(map(len, parts))
                parts.append(value)
                gold.append((KINDS.index(kind), start, start + len(value)))
                at = b
            for window in make_windows("".join([*parts, text[at:]]), []):
                place = {(window.tokens[i][0], window.tokens[j - 1][1]): k for k, (i, j) in enumerate(window.segments)}
                low, high = window.tokens[0][0], window.tokens[-1][1]
                inside = [g for g in gold if g[1] < high and g[2] > low]
                if all((a, b) in place for _, a, b in inside):
                    examples.append((window, {place[a, b]: kind for kind, a, b in inside}))
    field = SemiMarkovField()
    seen = np.full_like(field.w, 1e-3)
    for _ in range(-(-STEPS // max(1, len(examples)))):
        for at in rng.permutation(len(examples)):
            window, gold = examples[at]
            diff, _ = field.gradient(window, gold)
            rows, own = np.stack(window.features), np.flatnonzero(np.abs(diff).max(axis=1) > 1e-4)
            if not len(own):
                continue
            flat = rows[own].reshape(-1)
            for kind in range(len(KINDS)):
                g = np.bincount(flat, np.repeat(diff[own, kind], rows.shape[1]), WEIGHTS)
                hit = np.flatnonzero(g)
                g = g[hit] - 1e-4 * field.w[kind, hit]
                seen[kind, hit] += g * g
                field.w[kind, hit] += RATE * g / np.sqrt(seen[kind, hit])
    return field


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS, most_windows: int = TRAIN_WINDOWS) -> SemiMarkovField:
    """Learn from about ``most_docs`` documents chosen by a hash of doc_id."""
    total = docs.count()
    share = min(1.0, most_docs / max(1, total))
    chosen = docs.filter("text is not null").filter(
        F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    )

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                last = 0
                for m in _TRIGGER.finditer(text):
                    if m.start() >= last:
                        last = m.end() + 120
                        out.append(text[max(0, m.start() - 80) : last])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["snippet"])

    found = map_arrow(chosen.select("text"), snippets, "snippet string").distinct()
    rows = found.orderBy(F.xxhash64("snippet"), "snippet").limit(most_windows).collect()
    return fit([r["snippet"] for r in rows])


def find_spans(text: str, field: SemiMarkovField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the field adds); none of the latter touches a base span."""
    base = base_spans(text)
    added = []
    for window in make_windows(text, [(a, b) for _, a, b in base]):
        added += field.decode(window)
    return base, added


def _joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def detect(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """One row per document: doc_id and its spans over the whole text.

    spans is an array of (kind, start, end, base) in code points, end exclusive,
    by kind and start; ``base`` marks what the patterns found. A null text is
    empty and has none.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field.w)  # WEIGHTS numbers a kind
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiMarkovField(shared.value)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, added = find_spans(text or "", own)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(item))], names=["doc_id", "spans"])

    schema = f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean>>"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


@query("op3_pii_spans")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = detect(docs, train(docs))
    text = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    base = F.expr(f"concat_ws(',', {text.format('filter(spans, s -> s.base)')})")
    return found.select(
        "doc_id",
        *counts,
        F.sha2(base, 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', {text.format('spans')})").alias("spans"),
    )
