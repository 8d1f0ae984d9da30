"""Languages of spans of mixed text: scripts, word scores, Viterbi.

A word's script narrows the languages it may belong to; its character n-grams
score those; a Viterbi pass over the words with a penalty for each switch
labels spans. The pass is vectorised over blocks of words of all texts at once:
a block's best score from each state to each state, then the blocks of a text
in order, then the labels inside the blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.base import bounded_sample, held_out, map_arrow, query, ship_package, table
from listinglens.llm.words import WordRows, in_groups, ngram_buckets

#: Labelled documents a language is learned from, at most about so many each.
TRAIN_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
SWITCH_PENALTY = 12.0
#: A word can favour a language over the next best by this much at most.
WORD_LIMIT = 8.0
#: A script belongs to a language that writes this share of its letters in it.
SCRIPT_SHARE = 0.005
BLOCK = 128
WORD = re.compile(r"[^\W\d_]+")

#: First code points of script ranges, and the script of each.
SCRIPT_STARTS = (
    0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00,
    0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200,
    0x13A0, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400,
    0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0xFF66, 0xFFA0, 0x20000,
)
SCRIPT_NAMES = (
    "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Other", "Devanagari", "Bengali",
    "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai",
    "Lao", "Tibetan", "Myanmar", "Georgian", "Hangul", "Ethiopic", "Other", "Khmer", "Mongolian",
    "Latin", "Greek", "Other", "Hiragana", "Katakana", "Bopomofo", "Hangul", "Other", "Han", "Other",
    "Hangul", "Other", "Han", "Latin", "Hebrew", "Arabic", "Other", "Katakana", "Hangul", "Han",
)
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))


def scripts_of(words: list[str]) -> np.ndarray:
    """Script number of each word, by its first letter."""
    table_ = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])
    first = np.array([ord(w[0]) for w in words], np.int64)
    return table_[np.searchsorted(np.array(SCRIPT_STARTS), first, side="right") - 1]


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  # [BUCKETS, languages] log probabilities
    allowed: np.ndarray  # [scripts, languages]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[words, languages]: 0 for the best language of the word, less for others."""
        owner, bucket = ngram_buckets(words, SIZES, BUCKETS)
        scores = np.zeros((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            scores[:, k] = np.bincount(owner, self.grams[bucket, k], len(words))
        scores /= len(SIZES)
        scores[~self.allowed[scripts_of(words)]] = -np.inf
        scores -= scores.max(axis=1, keepdims=True)
        return np.maximum(scores, -WORD_LIMIT)


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``docs`` with text and lang.

    n-grams are counted in tasks over whole texts of a bounded sample; what
    reaches the driver is at most BUCKETS and the scripts per language.
    """
    rows = docs.filter("text is not null and lang is not null").select("doc_id", "lang", "text")
    sample = bounded_sample(rows, "lang", "doc_id", per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, counter in words.items():
            known = list(counter)
            times = np.array([counter[w] for w in known], np.float64)
            owner, bucket = ngram_buckets(known, SIZES, BUCKETS)
            grams = np.bincount(bucket, times[owner], BUCKETS)
            letters = times * np.array([len(w) for w in known], np.float64) if known else times
            script = np.bincount(scripts_of(known), letters, len(SCRIPTS)) if known else np.zeros(len(SCRIPTS))
            key = np.concatenate([np.flatnonzero(grams), -1 - np.flatnonzero(script)]).astype(np.int64)
            value = np.concatenate([grams[grams > 0], script[script > 0]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(value)], names=["lang", "key", "n"]
            )

    counted = map_arrow(sample, count, "lang string, key long, n double").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found["lang"].unique().tolist())
    grams = np.zeros((BUCKETS, len(languages)))
    script = np.zeros((len(SCRIPTS), len(languages)))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        key, n = own["key"].to_numpy(), own["n"].to_numpy()
        grams[key[key >= 0], k] = n[key >= 0]
        script[-1 - key[key < 0], k] = n[key < 0]
    smooth = 0.5
    log = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * BUCKETS))
    allowed = script >= SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script nobody writes rules nobody out
    return LanguageModel(languages, log.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``counts`` words belong to each text in turn.

    A path's score is the sum of its words' scores less ``penalty`` for every
    change of label inside a text; ties go to staying, then to the lower label.
    """
    states = scores.shape[1]
    if not len(scores):
        return np.zeros(0, np.int64)
    pieces = -(-counts // BLOCK)
    text_of = np.repeat(np.arange(len(counts)), pieces)
    first_block = np.cumsum(pieces) - pieces
    ordinal = np.arange(len(text_of)) - first_block[text_of]
    start = (np.cumsum(counts) - counts)[text_of] + ordinal * BLOCK
    length = np.minimum(counts[text_of] - ordinal * BLOCK, BLOCK)
    steps = int(length.max())
    at = start[:, None] + np.minimum(np.arange(steps), length[:, None] - 1)
    inside = np.arange(steps) < length[:, None]

    def step(t: int) -> np.ndarray:
        return np.where(inside[:, t, None], scores[at[:, t]], 0.0).astype(np.float64)

    # Best score from each entering state to each leaving state of a block.
    through = np.where(np.eye(states, dtype=bool), 0.0, -penalty)[None] + step(0)[:, None, :]
    for t in range(1, steps):
        best = through.max(axis=2, keepdims=True) - penalty
        through = np.maximum(through, best) + step(t)[:, None, :]
    entering = np.zeros((len(text_of), states))
    last = np.zeros((len(counts), states))
    for o in range(int(pieces.max())):
        blocks = first_block[pieces > o] + o
        entering[blocks] = last[pieces > o]
        last[pieces > o] = (entering[blocks][:, :, None] + through[blocks]).max(axis=1)
    leaving = np.zeros(len(text_of), np.int64)
    state = last.argmax(axis=1)
    for o in range(int(pieces.max()) - 1, -1, -1):
        has = pieces > o
        blocks = first_block[has] + o
        leaving[blocks] = state[has]
        state[has] = (entering[blocks] + through[blocks, :, state[has]]).argmax(axis=1)
    # Labels inside the blocks, from their entering scores to the known end.
    came = np.zeros((steps, len(text_of), states), np.int16)
    value, own = entering, np.arange(states)
    for t in range(steps):
        top = value.argmax(axis=1)
        best = value.max(axis=1, keepdims=True) - penalty
        came[t] = np.where(value >= best, own, top[:, None])
        value = np.maximum(value, best) + step(t)
    labels, rows = np.zeros((len(text_of), steps), np.int64), np.arange(len(text_of))
    state = leaving
    for t in range(steps - 1, -1, -1):
        labels[:, t] = state
        state = came[t, rows, state]
    return labels[inside]


def _text_spans(text: str, words: list[str], labels: np.ndarray, languages: list[str]) -> list[dict]:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *cuts.tolist(), len(words)]
    if len(edges) == 2:
        begin = WORD.search(text).start()
        end = text.rindex(words[-1]) + len(words[-1])
        return [{"start": begin, "end": end, "lang": languages[labels[0]]}]
    places = [m.span() for m in WORD.finditer(text)]
    return [
        {"start": places[a][0], "end": places[b - 1][1], "lang": languages[labels[a]]}
        for a, b in zip(edges, edges[1:], strict=False)
    ]


def label_languages(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row per document: doc_id, lang, score and spans.

    lang has the most letters over the spans (ties: the first by name), score is
    its share of the letters, spans are (start, end, lang) in code points of the
    text. A text that is null or has no letter, and any text if nothing was
    learned, has lang ``und``, score 0 and no span.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers per language
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = own.languages
        rows = WordRows(own.word_scores, max(1, len(names)), 400_000)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [WORD.findall(t) if t and names else [] for t in texts]
            for a, b in in_groups(found, 300_000):
                numbers = rows.of([[w.lower() for w in text] for text in found[a:b]])
                counts = np.array([len(x) for x in found[a:b]])
                filled = counts > 0
                labels = viterbi(rows.rows[numbers], counts[filled], penalty)
                letters = np.array([len(w) for text in found[a:b] for w in text], np.int64)
                text_of = np.repeat(np.arange(b - a), counts)
                votes = np.bincount(text_of * max(1, len(names)) + labels, letters, (b - a) * max(1, len(names)))
                votes = votes.reshape(b - a, -1)
                ends = np.cumsum(counts)
                best, share, spans = [], [], []
                for i in range(b - a):
                    if not filled[i]:
                        best.append("und")
                        share.append(0.0)
                        spans.append([])
                        continue
                    top = int(votes[i].argmax())
                    best.append(names[top])
                    share.append(float(votes[i, top] / votes[i].sum()))
                    own_labels = labels[ends[i] - counts[i] : ends[i]]
                    spans.append(_text_spans(texts[a + i], found[a + i], own_labels, names))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(best, pa.string()),
                        pa.array(share, pa.float64()),
                        pa.array(spans, fields),
                    ],
                    names=["doc_id", "lang", "score", "spans"],
                )

    schema = f"doc_id {kind}, lang string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return label_languages(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("lang").alias("lang_pred"),
        "score",
        F.size("spans").alias("n_spans"),
    )
