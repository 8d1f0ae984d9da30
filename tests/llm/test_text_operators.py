"""Extraction, decontamination and repeated passages against brute force."""

from __future__ import annotations

import collections
import hashlib
import html as entities
import random
import re
import time

import duckdb
import numpy as np
import pytest

from listinglens.llm import decontamination, html, suffixes
from listinglens.llm.base import QUERIES
from tests.llm.conftest import ODD
from tests.llm.test_exact_tokens import SF, documents

# --- main text of pages ----------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class=site><h1>Site</h1></header>
<div class="main-content with-sidebar"><div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp;
 line</h1><span class=byline>By X</span></header><p>One <b>bold<br><p>Two
 lines</b> x<div class="ad">Buy</div><ul><li>a<li>b</ul><form><input value=q>Sign up</form><pre> c  d </pre>
<section id="comments"><h2>Comments</h2><p>nice</p></section></article><aside>Side</aside></div>
<footer>&copy; f</footer><script>var t="</p>";</script></body></html> <foot"""


@pytest.mark.parametrize(
    "source, text",
    [
        (PAGE, "Head & line\nOne bold\nTwo lines x\na\nb\nc d"),
        ("", ""),
        ("a < b &am <p>c</p", "a < b &am\nc"),
        ("<div>only</div><nav>x</nav>text<!-- c", "only\ntext"),
        ("<form><article>in a form</article></form>", "in a form"),
        ("<p hidden>x</p><p style='display: none'>y</p><p>&#233;&eacute;&#x1F600;</p>", "éé😀"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<article><p>keep</p><div class='related-posts'>more</div></article><div>loose</div>", "keep"),
        ("<SCRIPT>a</script ><P>B</P>", "B"),
    ],
)
def test_extract(source, text):
    assert html.extract(source) == text


def test_broken_pages_take_linear_time():
    began = time.time()
    for bad in ("<div>" * 50_000, "<b>" * 30_000 + "</i>" * 30_000, "<" * 90_000, "<a '" * 30_000, "<p><b>" * 20_000):
        html.extract(bad)
    assert time.time() - began < 20


def page(host, i, body):
    return (i, f"http://{host}/{i}", f"<body><div class=x>{body}</div><div class=y>Made by the same people</div></body>")


def test_site_styles_cut_what_every_page_says(spark):
    rows = [page("one.example", i, f"<p>story {i}</p><p>of its own {i * 7}</p>") for i in range(12)]
    rows += [page("few.example", 100 + i, f"<p>story {i}</p>") for i in range(3)]
    rows += [page("same.example", 200 + i, "<p>a copy</p>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_pages(df).collect()}
    assert got[3] == "story 3\nof its own 21"
    assert got[101] == "story 1\nMade by the same people"  # a host with few pages says little
    assert got[204] == "a copy\nMade by the same people"  # copies of one page are one page


def test_importance_is_one_less_the_entropy(spark):
    rows = [page("h.example", i, f"<p>{'common' if i < 7 else i}</p>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h.example' AS host")
    # "common" makes seven pages the same, so two different pages are left: too few to tell.
    assert html.site_styles(df).count() == 0
    rows = [page("h.example", i, f"<p>{i}</p>{'<p>often</p>' if i < 18 else ''}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h.example' AS host")
    low = {round(r["importance"], 6) for r in html.site_styles(df).collect()}
    assert round(1 - np.log(18) / np.log(20), 6) in low and 0.0 in low


def article_by_pattern(source):
    """The test pages have one article; its blocks end where these tags stand."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer|$)", source, re.S)[1]
    out = []
    for block in re.split(r"</?(?:p|h1|article|ul|li)>", inner):
        out.append(" ".join(entities.unescape(re.sub(r"<[^>]*>?", "", block.replace("<br>", " "))).split()))
    return "\n".join(filter(None, out))


def test_html_query(spark):
    got = QUERIES["op2_html_extract"](spark, SF).collect()
    pages = {i: (u, h) for i, u, h in duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()}
    assert len(got) == len(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]][0] and r["text"] == article_by_pattern(pages[r["page_id"]][1])
        assert r["n_chars"] == len(r["text"])


def test_html_of_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "not a url", "<p>x"), (2, "http://[bad", ""), (3, "http://a/", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "h", "s") for r in rows], "page_id long, url string, html string, host string, low string")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html.extract_pages(df).collect()), key=str)
    want = [(i, u, (h or "").removeprefix("<p>")) for i, u, h in rows]
    assert got == sorted(want, key=str)
    assert html.extract_pages(df.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------

ITEM = "Tom has 5 apples and gives 3 apples to Mary Smith. How many apples does Tom have after 5 days?"


@pytest.mark.parametrize(
    "text, kind",
    [
        (f"Some text. {ITEM} More text.", "verbatim"),
        (ITEM.upper(), "verbatim"),
        (ITEM.lower(), "verbatim"),
        (ITEM.replace(" ", "\n"), "verbatim"),
        (
            "We know that Bob has 12 apples and gives 7 apples to Lucy Miller. How many apples does Bob have after 12 days?",
            "reparameterised",
        ),
        # Two values for what was one: another question with the same words.
        (
            "We know that Bob has 12 apples and gives 7 apples to Lucy Miller. How many apples does Bob have after 9 days?",
            None,
        ),
        ("Tom has 5 apples and that is all there is to say about Tom and his apples for 5 days.", None),
        ("", None),
    ],
)
def test_align(text, kind):
    got = decontamination.align(ITEM, text)
    assert (got and got[1]) == kind


LETTERS = "".join(chr(97 + i // 6) + chr(97 + i % 6) + "q " for i in range(37)).strip()  # 37 words, 33 windows


def test_align_over_words_put_in_or_left_out():
    words = LETTERS.split()
    for more in (3, 4, 40):
        longer = " ".join(words[:18] + ["zz"] * more + words[18:])
        assert decontamination.align(LETTERS, f"so {longer} end") == (29 / 33, "verbatim")
    assert decontamination.align(LETTERS, " ".join(words[:18] + words[20:])) == (27 / 33, "verbatim")
    assert decontamination.align(LETTERS, " ".join(words[18:] + words[:18])) is None  # not in the item's order
    assert decontamination.align(LETTERS, " ".join(words[:12] + ["zz"] * 9 + words[12:24] + ["zz"] * 9 + words[24:])) is None


SHEET = "Anna buys {} red pens and {} blue pens at the shop. How many pens does she buy in the end?"


@pytest.mark.parametrize(
    "values, kind",
    [
        ([(5, 5), (3, 4)], "verbatim"),
        ([(7, 9), (3, 4)], "verbatim"),
        ([(5, 5), (7, 9), (6, 6)], "reparameterised"),
        ([(5, 5), (6, 6)], None),
    ],
)
def test_align_tries_every_copy_of_the_template(values, kind):
    got = decontamination.align(SHEET.format(3, 4), " ".join(SHEET.format(*v) for v in values))
    assert (got and got[1]) == kind


def test_align_of_many_copies_ends():
    began = time.time()
    clashing = " and then ".join(SHEET.format(i, i).replace("shop.", "shop, it is said by all.") for i in range(2, 300))
    assert decontamination.align(SHEET.format(3, 4), clashing) is None
    assert decontamination.align("word " * 60, "word " * 3000) == (1.0, "verbatim")
    assert time.time() - began < 20


def leaks_by_force(docs, items):
    """Items of which 80 % of the windows of five words are in the document."""
    word, index, total = re.compile(r"\w+"), collections.defaultdict(set), {}

    def windows(text):
        words = word.findall((text or "").lower())
        size = min(5, len(words))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()

    for i, text in items:
        total[i] = len(windows(text))
        for w in windows(text):
            index[w].add(i)
    out = {}
    for i, text in docs:
        hits = collections.Counter(k for w in windows(text) for k in index.get(w, ()))
        found = sorted(k for k, n in hits.items() if n >= 0.8 * total[k])
        if found:
            out[i] = found
    return out


@pytest.mark.parametrize("most", [decontamination.FILTER_WINDOWS, 0])
def test_leak_query(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "FILTER_WINDOWS", most)
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["item_ids"] for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    want = leaks_by_force(documents(sf), items)
    assert len(want) > 10 and got == want


def test_leaks_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "The quick brown fox"), (2, None), (3, ""), (None, "word " * 9), (4, "word " * 7), (1, "The quick brown fox"), (6, "quick brown fox")],
        "item_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(odd, items).collect()}
    assert got == {(1, 1), (None, 1), (5, 4)}
    left = decontamination.drop_leaks(odd, items)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == sorted(
        (i or 0) for i, t, *_ in ODD if i != 5 and t != "the quick brown fox"
    )
    assert decontamination.find_leaks(empty, items).count() == 0
    assert decontamination.find_leaks(odd, items.limit(0)).count() == 0


# --- repeated passages -----------------------------------------------------


def repeats_by_force(rows, length):
    seen = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, data in texts:
        seen.update(data[p : p + length] for p in range(len(data) - length + 1))
    out = []
    for i, data in texts:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        rest = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_sliding_minimum():
    values = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    for width in (1, 2, 7, 100, 300, 301):
        want = [values[i : i + width].min() for i in range(300 - width + 1)]
        assert suffixes.sliding_minimum(values, width).tolist() == want


def test_anchors_do_not_depend_on_the_stretch(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(10):
        sizes = rng.integers(0, 200, 12)
        data, ends = rng.integers(0, 3, sizes.sum()).astype(np.uint8), np.cumsum(sizes)
        monkeypatch.setattr(suffixes, "STRETCH", 1 << 20)
        want = suffixes.anchors(data, ends, 40, 10)
        for stretch in (37, 64, 300):
            monkeypatch.setattr(suffixes, "STRETCH", stretch)
            assert suffixes.anchors(data, ends, 40, 10).tolist() == want.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_pasted_blocks(spark, seed):
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice("abcdef é") for _ in range(n))

    blocks = [some(rng.randint(5, 160)) for _ in range(12)]
    rows = [
        (i, "".join(rng.choice(blocks) if rng.random() < 0.6 else some(rng.randint(1, 40)) for _ in range(rng.randint(0, 6))))
        for i in range(50)
    ]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (77, None), (78, ""), (79, "ab" * 200), (80, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(df, 40, 10, (10, 5, 1)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == repeats_by_force(rows, 40)


def test_repeats_query(spark):
    got = [tuple(r) for r in QUERIES["op7_suffix_dedup"](spark, SF).collect()]
    assert sorted(got, key=str) == repeats_by_force(documents(), 400)


def test_repeats_of_odd_rows(odd, empty):
    got = suffixes.remove_repeats(odd).drop("kept").collect()
    rows = [r[:2] for r in ODD]
    assert [r["n_bytes"] for r in sorted(got, key=str)] == [r[1] for r in repeats_by_force(rows, 400)]
    removed = {r["doc_id"]: r["n_removed"] for r in got}
    assert removed[5] == 150_000 and removed[6] == 120_000 and removed[1] == 0
    assert suffixes.remove_repeats(empty).count() == 0
