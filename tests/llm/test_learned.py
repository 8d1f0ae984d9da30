"""Language, toxicity and personal data: brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listinglens.llm import language, pii, toxicity, words
from listinglens.llm.base import QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


# --- words -----------------------------------------------------------------


def test_ngrams_are_those_of_each_word():
    some = ["a", "abc", "é", "abcabc"]
    owner, bucket = words.ngram_buckets(some, (1, 3), 1 << 20)
    for i, w in enumerate(some):
        one, alone = words.ngram_buckets([w], (1, 3), 1 << 20)
        assert sorted(bucket[owner == i]) == sorted(alone) and set(one) == {0}
        marked = len(w) + 2
        assert len(alone) == marked + max(0, marked - 2)


def test_word_rows_start_anew_without_changing_values():
    rows = words.WordRows(lambda w: np.array([[len(x)] for x in w], np.float32), 1, 10)
    for texts in ([["a", "bb"]], [[f"{'c' * i}" for i in range(1, 12)]], [["a"], ["dddd", "a"]]):
        at = rows.of(texts)
        assert rows.rows[at, 0].tolist() == [len(w) for t in texts for w in t]


# --- language --------------------------------------------------------------


def viterbi_by_force(scores, penalty):
    value, back = scores[0].astype(float), []
    for row in scores[1:].astype(float):
        top = value.argmax()
        back.append(np.where(value >= value[top] - penalty, np.arange(len(value)), top))
        value = np.maximum(value, value[top] - penalty) + row
    labels = [int(value.argmax())]
    for came in reversed(back):
        labels.append(int(came[labels[-1]]))
    return labels[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_over_blocks(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 700, 6)
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    scores += np.repeat(rng.normal(size=(counts.sum() // 60 + 1, 3)), 60, axis=0)[: counts.sum()].astype(np.float32)
    got, at = language.viterbi(scores, counts, 4.0), 0
    for c in counts:
        assert got[at : at + c].tolist() == viterbi_by_force(scores[at : at + c], 4.0)
        at += c


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "это просто русский текст", "ru") for i in range(5)] + [(9 + i, "plain english text", "en") for i in range(5)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scores = model.word_scores(["english", "русский", "ελλάδα"])
    en, ru = model.languages.index("en"), model.languages.index("ru")
    assert scores[0, en] == 0 and scores[0, ru] == -language.WORD_LIMIT
    assert scores[1, ru] == 0 and scores[1, en] == -language.WORD_LIMIT
    assert scores[2].min() > -language.WORD_LIMIT  # a script nobody writes rules nobody out


def test_mixed_text_gets_spans(spark):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = dict(duckdb.sql(f"SELECT lang, max(text) FROM '{SF}/documents.parquet' GROUP BY lang").fetchall())
    french, german = texts["fr"][:400], texts["de"][:300]
    df = spark.createDataFrame([(1, f"{french}\n{german}")], "doc_id long, text string")
    row = language.label_languages(df, model).first()
    assert [s["lang"] for s in row["spans"]] == ["fr", "de"] and row["lang"] == "fr"
    assert abs(row["spans"][1]["start"] - len(french)) < 12


def test_language_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(got) == sorted(i for i, _ in rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [got[i]["lang_pred"] == lang for i, lang in rows if got[i]["held_out"]]
    assert np.mean(held) > 0.97


def test_language_of_odd_rows(spark, odd, empty):
    model = language.train(odd)
    got = language.label_languages(odd, model).collect()
    assert len(got) == len(ODD)
    texts = {r[0]: r[1] for r in ODD}
    for r in got:
        if not any(c.isalpha() for c in texts[r["doc_id"]] or "") and r["doc_id"] is not None:
            assert (r["lang"], r["score"], r["spans"]) == ("und", 0.0, [])
    nothing = language.train(empty)
    assert {r["lang"] for r in language.label_languages(odd, nothing).collect()} == {"und"}
    assert language.label_languages(empty, model).count() == 0


# --- toxicity --------------------------------------------------------------


def test_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network(5, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    length = np.array([6, 3, 1, 5])
    x, y = rng.normal(size=(6, 4, 6 * toxicity.HIDDEN)), np.array([1.0, 0, 1, 0])
    mask = (np.arange(6)[:, None] < length).astype(float)

    def loss():
        logit = net.forward(x, mask)
        return float(np.sum(np.logaddexp(0, logit) - y * logit))

    trace: dict = {}
    logit = net.forward(x, mask, trace)
    grad, d_x = net.backward(trace, 1 / (1 + np.exp(-logit)) - y)
    for name in ("fwd", "bwd", "attend", "query", "out", "shift"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        kept, eps = net.p[name][at], 1e-3  # states are single precision
        net.p[name][at] = kept + eps
        high = loss()
        net.p[name][at] = kept - eps
        low = loss()
        net.p[name][at] = kept
        assert grad[name][at] == pytest.approx((high - low) / 2 / eps, rel=0.02, abs=1e-5)
    assert np.abs(d_x[4, 1]).max() == 0  # past the end of its window


@pytest.mark.parametrize("words_", [0, 1, 31, 32, 33, 48, 49, 1000])
def test_windows_cover_every_word_and_overlap(words_):
    starts = toxicity.window_starts(words_)
    covered = {i for s in starts for i in range(s, min(words_, s + toxicity.WINDOW))}
    assert covered == set(range(words_))
    assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def toy(n, rng):
    plain = ["tree", "river", "house", "walk", "green", "slow", "paper", "stone"]
    texts, labels = [], []
    for i in range(n):
        some = [plain[k] for k in rng.integers(0, len(plain), rng.integers(20, 120))]
        if i % 2:
            some[int(rng.integers(0, len(some)))] = ("nasty", "nastily", "vile")[i % 3]
        texts.append(" ".join(some))
        labels.append(i % 2)
    return texts, np.array(labels)


def test_toxicity_of_toy_texts(spark, odd, empty):
    rng = np.random.default_rng(4)
    model = toxicity.fit(*toy(400, rng))
    texts, labels = toy(100, rng)
    texts.append("stone " * 30_000 + "vile " + "tree " * 30_000)  # somewhere in a long text
    labels = [*labels, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == label for i, label in enumerate(labels)]) > 0.95
    assert got[100] >= 0.5
    left = toxicity.drop_toxic(df, model)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, s in got.items() if s < 0.5)
    scores = toxicity.score_toxicity(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert all(r["score"] == 0 for r in scores if r["doc_id"] in (2, 3, 4))
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_toxicity_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert {r["score"] < 1e-3 for r in toxicity.score_toxicity(odd, model).collect()} == {True}


@pytest.mark.parametrize("per_label, shift", [(1000, 0.0), (200, np.log(800 / 200)), (50, np.log(800 / 200))])
def test_toxicity_scores_are_for_the_natural_odds(spark, monkeypatch, per_label, shift):
    docs = spark.createDataFrame([(i, "tree") for i in range(1000)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) AS toxic")
    monkeypatch.setattr(toxicity, "fit", lambda *_: toxicity.ToxicityModel({}, None, 1.0, 0.0))
    assert toxicity.train(docs, labels, per_label).intercept == pytest.approx(-shift)


def test_toxicity_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert len(got) == 1000 and np.mean([p == t for p, t in held]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


# --- personal data ---------------------------------------------------------


def spans_by_force(text):
    """The patterns as they are written down."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [("ip", *m.span())] if all(int(p) <= 255 for p in m[0].split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(digits) <= 19 and pii.luhn(digits) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", *m.span())] if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab12345678900..@@--++ ()%_é5٣"), max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text) == spans_by_force(text)


def test_base_spans_of_long_runs():
    for part in ("a" * 200_000, "1" * 200_000, "@" * 100_000, "+1" * 50_000, "1." * 100_000, "a@" * 50_000):
        pii.base_spans(part)


def every_segmentation(window, free):
    """(score, segments) of all ways to cut the window."""
    if free >= len(window.tokens):
        yield 0.0, []
        return
    for rest in every_segmentation(window, free + 1):
        yield rest
    for k, (i, j) in enumerate(window.segments):
        if i == free:
            for score, segments in every_segmentation(window, j):
                yield score, [k, *segments]


def test_field_decodes_and_learns_exactly():
    rng = np.random.default_rng(2)
    window = pii.make_windows("x 55 4444 66666 y@z.t at 7.8.9.1 dot q", [])[0]
    field = pii.SemiMarkovField(rng.normal(size=(len(pii.KINDS), pii.WEIGHTS)))
    scores = field.scores(window)
    ways = [segments for _, segments in every_segmentation(window, 0)]
    best = max(ways, key=lambda w: sum(scores[k].max() for k in w))
    want = [
        (pii.KINDS[scores[k].argmax()], window.tokens[window.segments[k][0]][0], window.tokens[window.segments[k][1] - 1][1])
        for k in best
    ]
    assert field.decode(window) == want
    mass = np.array([sum(np.logaddexp.reduce(scores[k]) for k in w) for w in ways])
    gold = {best[0]: 0}
    diff, total = field.gradient(window, gold)
    assert total == pytest.approx(scores[best[0], 0] - np.logaddexp.reduce(mass))
    expected = np.zeros(len(window.segments))
    for w, m in zip(ways, np.exp(mass - np.logaddexp.reduce(mass)), strict=True):
        expected[w] += m
    assert -diff.sum(axis=1) + (np.arange(len(expected)) == best[0]) == pytest.approx(expected)


def test_field_finds_disguised_spans(spark):
    field = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))

    def added(text):
        return [(k, text[a:b]) for k, a, b in pii.find_spans(text, field)[1]]

    assert added("please call (319) 555-5132 today") == [("phone", "(319) 555-5132")]
    assert added("write to kim[at]mail[dot]org ok") == [("email", "kim[at]mail[dot]org")]
    assert added("Nothing here but 12 apples at dawn.") == []


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_pii_spans"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(got) == sorted(i for i, _ in rows)
    for i, text in rows:
        want = spans_by_force(text or "")
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_pii_of_odd_rows(odd, empty):
    field = pii.train(odd)
    got = pii.detect(odd, field).collect()
    assert len(got) == len(ODD) and all(r["spans"] == [] for r in got)
    assert pii.detect(empty, pii.train(empty)).count() == 0
