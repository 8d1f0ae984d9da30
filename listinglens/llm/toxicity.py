"""Toxicity by a bidirectional gated recurrent network, in numpy.

A word enters as its own embedding beside the mean embedding of its character
n-grams; forward and backward gated units run over windows of words; attention
pools a window to one logit. A text is judged by the highest logit over all its
overlapping windows, in training (labels are of texts, not windows) as in use.
The input side of the gates is computed once per distinct word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglens.llm.base import bounded_sample, broadcast_within, held_out, map_arrow, query, ship_package, table
from listinglens.llm.words import WordRows, in_groups, ngram_buckets

WORD = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 12, 12, 8
SIZES, BUCKETS = (3, 4, 5), 1 << 13
#: Bounds of the training sample: documents of each label, their length, and
#: the words that get an embedding of their own.
TRAIN_PER_LABEL, TRAIN_CHARS, VOCABULARY = 2000, 200_000, 20_000
#: Steps of training; a batch is a sixteenth of the sample, within bounds.
STEPS, LEAST_BATCH, MOST_BATCH, RATE, SEED = 128, 16, 256, 0.01, 7
CHUNK = 4096


def window_starts(words: int) -> np.ndarray:
    """Starts of the overlapping windows that cover ``words`` words."""
    count = 0 if words == 0 else 1 if words <= WINDOW else -(-(words - WINDOW) // STRIDE) + 1
    return np.arange(count) * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name, a forward pass, and its gradient."""

    def __init__(self, words: int, rng: np.random.Generator):
        h, d = HIDDEN, WORD_DIM + CHAR_DIM

        def small(*shape):
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": (rng.normal(size=(words, WORD_DIM)) * 0.1).astype(np.float32),
            "char": (rng.normal(size=(BUCKETS, CHAR_DIM)) * 0.5).astype(np.float32),
            "in": small(d, 6 * h),
            "gate": np.zeros(6 * h, np.float32),
            "fwd": small(h, 3 * h),
            "bwd": small(h, 3 * h),
            "attend": small(2 * h, ATTENTION),
            "shift": np.zeros(ATTENTION, np.float32),
            "query": small(ATTENTION),
            "out": small(2 * h),
            "bias": np.zeros(1, np.float32),
        }

    def _direction(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, trace: list | None):
        k, out = HIDDEN, np.zeros((*x.shape[:2], HIDDEN), np.float32)
        h, whole = np.zeros((x.shape[1], k), np.float32), mask.all(axis=1)
        for t in range(len(x) - 1, -1, -1) if back else range(len(x)):
            hu = h @ u
            zr = hu[:, : 2 * k] + x[t, :, : 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :k], zr[:, k:]
            n = r * hu[:, 2 * k :]
            n += x[t, :, 2 * k :]
            np.tanh(n, out=n)
            m = mask[t, :, None]
            new = n - h
            new *= 1 - z
            if not whole[t]:
                new *= m
            new += h
            if trace is not None:
                trace.append((t, h, z, r, n, hu[:, 2 * k :], m))
            h = out[t] = new
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logit of each window; ``x`` [steps, windows, gates], ``mask`` 1 where a word is."""
        p, k = self.p, 3 * HIDDEN
        a, b = ([], []) if trace is not None else (None, None)
        hidden = np.concatenate(
            [self._direction(x[:, :, :k], mask, p["fwd"], False, a), self._direction(x[:, :, k:], mask, p["bwd"], True, b)],
            axis=2,
        )
        u = np.tanh(hidden @ p["attend"] + p["shift"])
        s = np.where(mask > 0, u @ p["query"], -1e9)
        e = np.exp(s - s.max(axis=0))
        alpha = (e / e.sum(axis=0)).astype(np.float32)
        pooled = np.einsum("tn,tnh->nh", alpha, hidden)
        if trace is not None:
            trace.update(a=a, b=b, hidden=hidden, u=u, alpha=alpha, pooled=pooled)
        return pooled @ p["out"] + p["bias"][0]

    def backward(self, trace: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients but for the inputs', gradient of ``x``)."""
        p, hidden, u, alpha = self.p, trace["hidden"], trace["u"], trace["alpha"]
        g = {"out": trace["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_alpha = np.einsum("tnh,nh->tn", hidden, d_pooled)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["query"] = np.einsum("tna,tn->a", u, d_s)
        d_u = d_s[:, :, None] * p["query"] * (1 - u * u)
        g["attend"] = np.einsum("tnh,tna->ha", hidden, d_u)
        g["shift"] = d_u.sum(axis=(0, 1))
        d_hidden = alpha[:, :, None] * d_pooled + d_u @ p["attend"].T
        h, parts = HIDDEN, []
        for name, steps, grad in (("fwd", trace["a"], d_hidden[:, :, :h]), ("bwd", trace["b"], d_hidden[:, :, h:])):
            d_x = np.zeros((*hidden.shape[:2], 3 * h), np.float32)
            d_u_mat, d_h = np.zeros_like(p[name]), np.zeros_like(grad[0])
            for t, before, z, r, n, hun, m in reversed(steps):
                d_h = d_h + grad[t]
                d_new = d_h * m
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (before - n) * z * (1 - z)
                d_r = d_n * hun * r * (1 - r)
                d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u_mat += before.T @ d_hu
                d_h = d_h * (1 - m) + d_new * z + d_hu @ p[name].T
            g[name] = d_u_mat
            parts.append(d_x)
        return g, np.concatenate(parts, axis=2)


@dataclass
class ToxicityModel:
    """What scoring needs: the words with an embedding, the network, its calibration."""

    vocabulary: dict[str, int]
    network: Network
    slope: float = 1.0
    intercept: float = 0.0

    def gates(self, words: list[str]) -> np.ndarray:
        p = self.network.p
        known = np.array([self.vocabulary.get(w, 0) for w in words])
        inputs = np.concatenate([p["word"][known], _gram_means(words, p["char"])], axis=1)
        return inputs @ p["in"] + p["gate"]

    def logits(self, rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Highest window logit of each text; -inf for a text without words."""
        best = np.full(len(counts), -np.inf)
        starts = [window_starts(int(c)) for c in counts]
        owner = np.repeat(np.arange(len(counts)), [len(s) for s in starts])
        if not len(owner):
            return best
        offset = np.cumsum(counts) - counts
        first = np.concatenate(starts) + offset[owner]
        length = np.minimum(WINDOW, (offset + counts)[owner] - first)
        for a in range(0, len(owner), CHUNK):
            f, n = first[a : a + CHUNK], length[a : a + CHUNK]
            x, mask = _inputs(rows, numbers, f, n)
            np.maximum.at(best, owner[a : a + CHUNK], self.network.forward(x, mask))
        return best

    def probability(self, logits: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            p = 1 / (1 + np.exp(-(self.slope * logits + self.intercept)))
        return np.where(np.isneginf(logits), 0.0, p)


def _gram_means(words: list[str], values: np.ndarray) -> np.ndarray:
    owner, bucket = ngram_buckets(words, SIZES, BUCKETS)
    order = np.argsort(owner, kind="stable")  # every word has at least one n-gram
    counts = np.bincount(owner, minlength=len(words))
    sums = np.add.reduceat(values[bucket[order]], np.cumsum(counts) - counts, axis=0)
    return sums / counts[:, None].astype(np.float32)


def _inputs(rows: np.ndarray, numbers: np.ndarray, first: np.ndarray, length: np.ndarray):
    steps = int(length.max())
    at = first + np.minimum(np.arange(steps)[:, None], length - 1)
    return rows[numbers[at]], (np.arange(steps)[:, None] < length).astype(np.float32)


# --- training --------------------------------------------------------------


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED) -> ToxicityModel:
    """Train on labelled texts; a text counts by its highest-scoring window."""
    rng = np.random.default_rng(seed)
    # Texts as numbers of distinct words, and words in how many texts of each label.
    number: dict[str, int] = {}
    spoken, kept = [], []
    for i, text in enumerate(texts):
        some = np.array([number.setdefault(w, len(number)) for w in WORD.findall(text.lower())], np.int32)
        if len(some):
            spoken.append(some)
            kept.append(i)
    labels = np.asarray(labels, np.float32)[kept]
    if not kept or len(set(labels.tolist())) < 2:
        rate = float(labels.mean()) if kept else 0.0
        odds = np.log((rate + 1e-6) / (1 - rate + 1e-6))
        return ToxicityModel({}, Network(1, rng), 0.0, float(odds))
    unique = list(number)
    tally = np.zeros((len(unique), 2))
    for some, label in zip(spoken, labels, strict=True):
        tally[np.unique(some), int(label)] += 1
    often = tally.sum(axis=1)
    frequent = sorted(np.flatnonzero(often >= 5).tolist(), key=lambda i: (-often[i], unique[i]))[: VOCABULARY - 1]
    vocabulary = {unique[i]: at + 1 for at, i in enumerate(frequent)}
    share = np.array([(labels == 0).sum(), (labels == 1).sum()], np.float64)
    own = np.log((tally[:, 1] + 0.5) / share[1]) - np.log((tally[:, 0] + 0.5) / share[0])
    owner, bucket = ngram_buckets(unique, SIZES, BUCKETS)
    gram = np.stack([np.bincount(bucket, tally[owner, k], BUCKETS) for k in (0, 1)], axis=1) + 0.5
    gram_odds = np.log(gram[:, 1] / gram[:, 1].sum()) - np.log(gram[:, 0] / gram[:, 0].sum())
    gram_mean = np.bincount(owner, gram_odds[bucket], len(unique)) / np.bincount(owner, minlength=len(unique))
    odds = np.where(tally.sum(axis=1) >= 3, own, gram_mean)

    counts = np.array([len(w) for w in spoken])
    numbers = np.concatenate(spoken)
    offset = np.cumsum(counts) - counts
    starts = [window_starts(int(c)) for c in counts]
    text_of = np.repeat(np.arange(len(counts)), [len(s) for s in starts])
    first = np.concatenate(starts) + offset[text_of]
    length = np.minimum(WINDOW, (offset + counts)[text_of] - first)
    first_window = np.cumsum([len(s) for s in starts]) - [len(s) for s in starts]

    def chosen(scores: np.ndarray, most: int) -> list[np.ndarray]:
        return [
            first_window[i] + np.argsort(-scores[first_window[i] : first_window[i] + len(s)], kind="stable")[:most]
            for i, s in enumerate(starts)
        ]

    parts = []
    for a in range(0, len(first), CHUNK):
        f, n = first[a : a + CHUNK, None], length[a : a + CHUNK, None]
        parts.append(odds[numbers[np.minimum(f + np.arange(WINDOW), f + n - 1)]].max(axis=1))
    by_odds = chosen(np.concatenate(parts), 3)
    bags = [np.union1d(b, first_window[i] + rng.integers(0, len(starts[i]), 2)) for i, b in enumerate(by_odds)]

    net = Network(len(vocabulary) + 1, rng)
    known = np.array([vocabulary.get(w, 0) for w in unique])
    order = np.argsort(owner, kind="stable")
    grams, gram_counts = bucket[order], np.bincount(owner, minlength=len(unique))
    del order, owner, bucket
    gram_ends = np.cumsum(gram_counts)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def embed(words: np.ndarray):
        """Inputs of distinct words: [words, dims], and which n-grams they have."""
        n = gram_counts[words]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own_grams = grams[np.repeat(gram_ends[words] - n, n) + inside]
        sums = np.add.reduceat(net.p["char"][own_grams], np.cumsum(n) - n, axis=0)
        return np.concatenate([net.p["word"][known[words]], sums / n[:, None]], axis=1), own_grams, n

    batch_size = min(MOST_BATCH, max(LEAST_BATCH, len(counts) // 16))
    epochs = -(-STEPS * batch_size // len(counts))
    for epoch in range(epochs):
        if epoch == epochs // 2:  # the windows that this network finds worst
            now = ToxicityModel(vocabulary, net)
            rows = np.concatenate([now.gates(unique[a : a + 50_000]) for a in range(0, len(unique), 50_000)])
            scores = np.concatenate(
                [
                    net.forward(*_inputs(rows, numbers, first[a : a + CHUNK], length[a : a + CHUNK]))
                    for a in range(0, len(first), CHUNK)
                ]
            )
            bags = [np.union1d(a, b) for a, b in zip(bags, chosen(scores, 3), strict=True)]
        turn = rng.permutation(len(counts))
        for a in range(0, len(turn), batch_size):
            batch = turn[a : a + batch_size]
            windows = np.concatenate([bags[i] for i in batch])
            sizes = np.array([len(bags[i]) for i in batch])
            steps = int(length[windows].max())
            at = first[windows] + np.minimum(np.arange(steps)[:, None], length[windows] - 1)
            words, local = np.unique(numbers[at], return_inverse=True)
            local = local.reshape(at.shape)
            inputs, own_grams, n = embed(words)
            rows = inputs @ net.p["in"] + net.p["gate"]
            mask = (np.arange(steps)[:, None] < length[windows]).astype(np.float32)
            scores = net.forward(rows[local], mask)
            edges = np.cumsum(sizes) - sizes
            top = np.array([e + scores[e : e + s].argmax() for e, s in zip(edges, sizes, strict=True)])
            trace: dict = {}
            logit = net.forward(rows[local[:, top]], mask[:, top], trace)
            d_logit = ((_sigmoid(logit) - labels[batch]) / len(batch)).astype(np.float32)
            g, d_x = net.backward(trace, d_logit)
            used, place = np.unique(local[:, top], return_inverse=True)
            d_rows = np.zeros((len(used), rows.shape[1]), np.float32)
            np.add.at(d_rows, place.reshape(-1), (d_x * mask[:, top, None]).reshape(-1, rows.shape[1]))
            g["in"], g["gate"] = inputs[used].T @ d_rows, d_rows.sum(axis=0)
            d_in = d_rows @ net.p["in"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], known[words[used]], d_in[:, :WORD_DIM])
            ends, n_used = np.cumsum(n)[used], n[used]
            inside = np.arange(n_used.sum()) - np.repeat(np.cumsum(n_used) - n_used, n_used)
            hit = own_grams[np.repeat(ends - n_used, n_used) + inside]
            np.add.at(g["char"], hit, np.repeat(d_in[:, WORD_DIM:] / n_used[:, None], n_used, axis=0))
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] * g[k] - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    out = ToxicityModel(vocabulary, net)
    rows = np.concatenate([out.gates(unique[a : a + 50_000]) for a in range(0, len(unique), 50_000)])
    out.slope, out.intercept = _calibrate(out.logits(rows, numbers, counts), labels)
    return out


def _calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the texts' logits, by Newton steps with a little ridge."""
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hess, x.T @ (p - labels) + 1e-2 * (w - [1.0, 0.0]))
    return float(max(w[0], 1e-3)), float(w[1])


# --- Spark -----------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> ToxicityModel:
    """Learn from a bounded sample: about ``per_label`` documents of each label.

    ``labels`` has doc_id and toxic (0 or 1; other rows are passed over). Longer
    texts than TRAIN_CHARS are not learned from. Scores are for the labels'
    natural odds: the intercept takes back by how much the sample shifts them.
    """
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.distinct()
    counts = dict(marked.groupBy("toxic").count().collect())  # at most two
    chosen = bounded_sample(marked, "toxic", "doc_id", per_label)
    rows = (
        docs.select("doc_id", "text")
        .join(broadcast_within(chosen, 24), "doc_id")
        .filter(F.char_length("text") <= TRAIN_CHARS)
        .select("doc_id", "text", "toxic")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    model = fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.float32))
    if {r["toxic"] for r in rows} == {0, 1}:
        share = {k: min(1.0, per_label / n) for k, n in counts.items()}
        model.intercept -= float(np.log(share[1] / share[0]))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id and score, over all windows of the whole text.

    A text that is null or has no word scores 0. Without labels of both kinds
    every other text gets the share of label 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scores = _text_scores(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, found in scores(batches):
            part = batch.column("doc_id").slice(a, len(found))
            yield pa.RecordBatch.from_arrays([part, pa.array(found)], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay."""
    scores = _text_scores(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, found in scores(batches):
            yield batch.slice(a, len(found)).filter(pa.array(found < limit))

    return map_arrow(docs, run, docs.schema)


def _text_scores(spark: SparkSession, model: ToxicityModel):
    """A function of batches: (batch, first row, scores of the rows from it on)."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed tables, some MB

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        own = shared.value
        table_ = WordRows(own.gates, 6 * HIDDEN, 200_000)
        for batch in batches:
            found = [WORD.findall(t.lower()) if t else [] for t in batch.column("text").to_pylist()]
            for a, b in in_groups(found, 100_000):
                numbers = table_.of(found[a:b])
                logits = own.logits(table_.rows, numbers, np.array([len(f) for f in found[a:b]]))
                yield batch, a, own.probability(logits)

    return scores


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return score_toxicity(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
