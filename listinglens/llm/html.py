"""Main text of web pages by a site style tree.

The DOM trees of a host are merged by path: for every path the tree knows how
its elements are laid out (presentation) and which texts stand there (content),
and on how many different pages. What looks and reads the same on page after
page has a low importance, by entropy; branches whose importance stays below a
threshold all the way down are cut from each page, beside the branches whose
element or class says what they are. The importance of an element is
(1 - GAMMA) times that of its presentation plus GAMMA times the mean of its
children; the importance of a content is 1 - log(pages with it) / log(pages
with its path). A host with few different pages says little and keeps all.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, map_arrow, query, ship_package, stored, table

GAMMA = 0.9
THRESHOLD = 0.05
#: Different pages that must have a path before its importance counts.
LEAST_PAGES = 5
#: Pieces that a host's rows are dealt over when its style table is too large to broadcast.
SALTS = 64

#: Element names by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul caption option optgroup select".split()
)
NOISE = frozenset(
    "head script style noscript template iframe nav footer aside form button select textarea input option "
    "dialog menu search svg canvas object embed audio video title xmp noembed noframes map".split()
)
ALWAYS = NOISE - frozenset("form dialog button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
#: Words of a class, id or role that name what is not the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs pager pagination sidebar footer contentinfo complementary cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations comment comments respond reply replies disqus widget "
    "toolbar search dialog alert alertdialog masthead disclaimer copyright skip".split()
)
HEADER_WORDS = frozenset("header topbar".split())

_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Elements in order of appearance, and the pieces of text of each block."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    label: list[str] = field(default_factory=lambda: [""])
    noise: list[bool] = field(default_factory=lambda: [False])
    article: list[bool] = field(default_factory=lambda: [False])
    header: list[bool] = field(default_factory=lambda: [False])
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)


def _words_of(label: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(label)}


def parse(source: str) -> Page:
    """A forgiving reading of ``source``; never fails, and linear in its length."""
    page, stack, open_tags = Page(), [0], {}
    pieces: list[tuple[int, str]] = []
    low = source.lower() if source.isascii() else None
    at, size = 0, len(source)

    def flush() -> None:
        nonlocal pieces
        if pieces:
            page.blocks.append(pieces)
            pieces = []

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[page.tag[stack.pop()]] -= 1

    def text(part: str) -> None:
        if part:
            pieces.append((stack[-1], part))

    while at < size:
        mark = source.find("<", at)
        if mark < 0:
            text(source[at:])
            break
        text(source[at:mark])
        following = source[mark + 1 : mark + 2]
        if source.startswith("<!--", mark):
            end = source.find("-->", mark + 2)
            at = size if end < 0 else end + 3
            continue
        if following in ("!", "?"):
            end = source.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        if not (following.isalpha() or following == "/"):
            text("<")
            at = mark + 1
            continue
        found = _TAG.match(source, mark) or _PLAIN_TAG.match(source, mark)
        if not found:
            if following == "/" and not source[mark + 2 : mark + 3].isalpha():
                end = source.find(">", mark)
                at = size if end < 0 else end + 1
                continue
            break  # a tag that the end of the page cut off
        at = found.end()
        tag = found[1].lower()
        if following == "/":
            if tag in BLOCK:
                flush()
            if open_tags.get(tag):
                depth = len(stack) - 1
                while page.tag[stack[depth]] != tag and (tag in BLOCK or page.tag[stack[depth]] not in BLOCK):
                    depth -= 1
                if page.tag[stack[depth]] == tag:
                    pop_to(depth)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            flush()
            if open_tags.get("p"):
                depth = len(stack) - 1
                while page.tag[stack[depth]] != "p":
                    depth -= 1
                # Only a paragraph that no other block has closed in around.
                if not any(page.tag[n] in BLOCK for n in stack[depth + 1 :]):
                    pop_to(depth)
        if tag in CLOSES:
            depth = len(stack) - 1
            while depth > 0 and (page.tag[stack[depth]] in CLOSES[tag] or page.tag[stack[depth]] not in BLOCK or page.tag[stack[depth]] == "p"):
                if page.tag[stack[depth]] in CLOSES[tag]:
                    pop_to(depth)
                depth = min(depth, len(stack)) - 1
        attributes = {
            m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(found[2])
        } if found[2].strip("/ ") else {}
        label = " ".join(filter(None, (attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", ""))))
        words = _words_of(label) if label else set()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or (
            "style" in attributes and bool(_HIDDEN.search(attributes["style"]))
        )
        number = len(page.tag)
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.label.append(label)
        page.noise.append(tag in NOISE or hidden or bool(words & NOISE_WORDS))
        page.article.append(tag in ("article", "main") or "main" in attributes.get("role", "").lower().split())
        page.header.append(tag == "header" or bool(words & HEADER_WORDS))
        if tag in VOID:
            continue
        stack.append(number)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            if low is None:
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                end = end.start() if end else -1
            else:
                end = low.find(f"</{tag}", at)
            end = size if end < 0 else end
            text(source[at:end])
            at = end
    flush()
    return page


def cut_by_name(page: Page) -> np.ndarray:
    """Elements that are cut for what they are, with all below them.

    A class, an id or a form only counts if no article or main part lies below:
    a wrapper may mention its sidebar. If the page has such parts, only they stay. Of a
    header inside an article its headings stay, any other header goes.
    """
    count = len(page.tag)
    holds = np.zeros(count, bool)
    for n in range(count - 1, 0, -1):
        if holds[n] or page.article[n]:
            holds[page.parent[n]] = True
    cut, inside = np.zeros(count, bool), np.zeros(count, bool)
    in_header, heading = np.zeros(count, bool), np.zeros(count, bool)
    any_article = False
    for n in range(1, count):
        up = page.parent[n]
        own = page.noise[n] and (page.tag[n] in ALWAYS or not holds[n])
        cut[n] = cut[up] or own
        inside[n] = inside[up] or (page.article[n] and not cut[n])
        any_article |= bool(page.article[n] and not cut[n])
        in_header[n] = in_header[up] or (page.header[n] and not holds[n])
        heading[n] = heading[up] or page.tag[n] in HEADINGS
    cut |= in_header & ~(inside & heading)
    if any_article:
        cut |= ~inside
    return cut


def paths(page: Page) -> list[int]:
    """A hash of the names and classes from the root to each element."""
    import xxhash

    out = [0]
    for n in range(1, len(page.tag)):
        key = f"{out[page.parent[n]]} {page.tag[n]} {page.label[n]}".encode("utf-8", "surrogatepass")
        out.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
    return out


def clean(pieces: list[tuple[int, str]]) -> str:
    return " ".join(entities.unescape("".join(p for _, p in pieces)).split())


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def content(page: Page, cut: np.ndarray) -> list[tuple[int, str]]:
    """(element, text) of every block that has text left, in page order."""
    out = []
    for block in page.blocks:
        kept = [p for p in block if not cut[p[0]]]
        line = clean(kept) if kept else ""
        if line:
            owner = next(n for n, part in kept if part.strip())
            while owner and page.tag[owner] not in BLOCK:
                owner = page.parent[owner]
            out.append((owner, line))
    return out


def styles(page: Page, where: list[int], lines: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """(path, hash of its layout) of the elements that hold any of the ``lines``."""
    holds = {n for n, _ in lines}
    for n in range(len(page.tag) - 1, 0, -1):
        if n in holds:
            holds.add(page.parent[n])
    parts: dict[int, list[str]] = {n: [] for n in holds}
    for n in range(1, len(page.tag)):
        if n in holds and page.parent[n] in parts:
            parts[page.parent[n]].append(page.tag[n])
    for n, _ in lines:
        parts[n].append("#")
    return {(where[n], _hash(" ".join(p))) for n, p in parts.items()}


def importances(
    page: Page, lines: list[tuple[int, str]], where: list[int], low: dict[tuple[int, int], float]
) -> list[float]:
    """For each of ``lines`` the highest importance in its branch, up to its element.

    ``low`` has the importance of contents by (path, hash of the text) and of
    presentations by (path, 0); what it does not list counts as 1. An element is
    GAMMA times the mean of its contents and children plus the rest from its
    presentation. A line stays if it says something itself or stands in an
    element of some importance.
    """
    values = [low.get((where[n], _hash(t)), 1.0) for n, t in lines]
    below: dict[int, list[float]] = {}
    for (n, _), value in zip(lines, values, strict=True):
        below.setdefault(n, []).append(value)
    element: dict[int, float] = {}
    for n in range(len(page.tag) - 1, -1, -1):
        if n in below:
            mean = sum(below[n]) / len(below[n])
            element[n] = (1 - GAMMA) * low.get((where[n], 0), 1.0) + GAMMA * mean
            if n:
                below.setdefault(page.parent[n], []).append(element[n])
    return [max(value, element[n]) for (n, _), value in zip(lines, values, strict=True)]


def extract(source: str, low: dict[tuple[int, int], float] | None = None) -> str:
    """Main text of one page, given what its host says is unimportant.

    If nothing of the page is important its text stays whole: a page of
    boilerplate only, or copies of one article, have nothing to set it off from.
    """
    page = parse(source)
    lines = content(page, cut_by_name(page))
    if low:
        kept = [
            line
            for line, value in zip(lines, importances(page, lines, paths(page), low), strict=True)
            if value >= THRESHOLD
        ]
        lines = kept or lines
    return "\n".join(t for _, t in lines)


def site_styles(pages: DataFrame) -> DataFrame:
    """(host, path, feature, importance) of what is below THRESHOLD on its host.

    ``pages`` has host and html. feature is the hash of a content or 0 for the
    presentation of the path. Pages with the same text count once. A path counts
    from LEAST_PAGES different pages on.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, source in enumerate(batch.column("html").to_pylist()):
                page = parse(source)
                lines = content(page, cut_by_name(page))
                if not lines:
                    continue
                where, sign = paths(page), _hash("\n".join(t for _, t in lines))
                found = {(where[n], _hash(t), True) for n, t in lines}
                found |= {(*s, False) for s in styles(page, where, lines)}
                row += [i] * len(found)
                out += [(sign, *f) for f in found]
            columns = zip(*out, strict=True) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            host = batch.column("host").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [host] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["host", "sign", "path", "feature", "content"],
            )

    seen = stored(
        map_arrow(
            pages.select("host", "html"), nodes, "host string, sign long, path long, feature long, content boolean"
        ).distinct(),
        "html-nodes",
    )
    place = ["host", "path", "content"]
    having = (
        seen.select(*place, "sign").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= LEAST_PAGES)
    )
    counts = seen.groupBy(*place, "feature").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(having, place)
    contents = (
        known.filter("content")
        .withColumn("importance", 1 - F.log("n") / F.log("m"))
        .select("host", "path", "feature", "importance")
    )
    # Pages with several layouts of one path count in each: shares of the layouts seen.
    layouts = known.filter("not content").groupBy("host", "path", "m").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("bits")
    )
    presentations = layouts.select(
        "host", "path", F.lit(0).cast("long").alias("feature"),
        ((F.log("all") - F.col("bits") / F.col("all")) / F.log("m")).alias("importance"),
    )
    return contents.unionByName(presentations).filter(F.col("importance") < THRESHOLD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url and text, of the whole html.

    Null html is empty, and text is empty if nothing is left. Pages whose url is
    null or has no host share one unnamed host. Other columns are ignored.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).cast("string").alias("html"),
        F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))).alias("host"),
    )
    low = stored(site_styles(rows), "html-styles")
    by_host = low.groupBy("host").agg(F.collect_list(F.struct("path", "feature", "importance")).alias("low"))
    size = F.octet_length("host") + 24 * F.size("low")
    bytes_ = by_host.agg(F.sum(size.cast("long"))).first()[0] or 0
    if bytes_ <= 32 << 20:
        joined = rows.join(broadcast_within(by_host, size), "host", "left")
    else:  # a host may have a third of the pages
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(
            salted, ["host", "salt"], "left"
        )
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict] = {}
        for batch in batches:
            hosts, lows = batch.column("host").to_pylist(), batch.column("low")
            texts = []
            for i, source in enumerate(batch.column("html").to_pylist()):
                host = hosts[i]
                if host not in tables:
                    if len(tables) > 1000:
                        tables.clear()
                    tables[host] = {(x["path"], x["feature"]): x["importance"] for x in lows[i].as_py() or ()}
                texts.append(extract(source, tables[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return map_arrow(
        joined.select("page_id", "url", "host", "html", "low"), run, f"page_id {kind}, url string, text string"
    )


@query("op2_html_extract")
def op2(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
