"""Repeated passages by a depth-limited radix sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere.
Only equality through LENGTH bytes matters, so suffixes are told apart by most
significant digits in passes, and a group leaves as soon as it is decided:

* Pass 0. Every window of LENGTH bytes names an anchor, the place in it whose
  next eight bytes hash lowest; equal windows name equal anchors, and few places
  are anchors of any window. The first digit of the windows of an anchor is the
  FEATURE bytes that follow it, which all of them contain.
* Passes 1 to 3. The windows of an anchor are told apart by where they start: in
  classes of 50, of 10 and of one offset. The digit of a class is the string that
  all of its windows share. Groups with one member are dropped.
* In each pass, a member whose whole span (all windows of its class together)
  occurs twice is settled: all its windows are repeated. One such member stays to
  be compared with the others. Exact copies are thus settled in pass 0, and what
  later passes see is only the surroundings of the edges of repeats.

After pass 3 equal groups are exactly the repeated windows. All grouping is by
aggregates with map-side combine; no pass lists pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, discard, map_arrow, query, stored, table
from listinglens.llm.words import runs

LENGTH = 400
FEATURE = 100
WIDTHS = (50, 10, 1)
#: Texts worked off together in a task, and bytes looked at in one go.
GROUP_BYTES, STRETCH = 1 << 20, 1 << 20


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row (van Herk), in linear time."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, feature: int) -> np.ndarray:
    """Places in ``data`` (texts one after another, up to ``ends``) that are anchors.

    Worked off in stretches of STRETCH bytes, however long a text is.
    """
    found = []
    for start in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[start : start + STRETCH + length - 1]
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        gram = np.lib.stride_tricks.as_strided(padded, (len(part), 8), (1, 1)).copy().view("<u8").reshape(-1)
        gram *= np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        # Lowest hash, then leftmost: the low half holds the place.
        gram &= np.uint64(0xFFFFFFFF00000000)
        gram |= np.arange(len(part), dtype=np.uint64)
        count = len(part) - length + 1
        lowest = sliding_minimum(gram, length - feature + 1)[:count]
        inside = np.ones(count, bool)  # windows that end in the text they start in
        first = np.searchsorted(ends, start, side="right")
        for end in ends[first : np.searchsorted(ends, start + len(part)) + 1].tolist():
            inside[max(0, end - length + 1 - start) : max(0, end - start)] = False
        lowest = lowest[inside]
        if len(lowest):
            change = np.concatenate([[True], lowest[1:] != lowest[:-1]])
            found.append(start + np.unique((lowest[change] & np.uint64(0xFFFFFFFF)).astype(np.int64)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


class _Spans:
    """The windows of an anchor by class: strings that are hashed in each pass."""

    def __init__(self, length: int, feature: int, width: int):
        self.length, self.width, self.last = length, width, length - feature

    def of(self, cls: int, left: int, right: int) -> tuple[int, int, int, int, int, int] | None:
        """(first, last offset, digit from, digit to, span from, span to) around the anchor.

        Offsets are how far before the anchor a window starts; ``left`` and
        ``right`` are the bytes of the text on both sides. None if no window of
        the class lies inside the text.
        """
        low, high = cls * self.width, min(cls * self.width + self.width - 1, self.last)
        first, last = max(low, self.length - right), min(high, left)
        if first > last:
            return None
        return first, last, -low, self.length - high, -last, self.length - first


def repeated_spans(docs: DataFrame, length: int = LENGTH, feature: int = FEATURE, widths=WIDTHS) -> DataFrame:
    """(doc_id, key, starts, ends): the maximal repeated runs of each text, in bytes.

    ``key`` is the hash of the text. Only texts with a run appear; rows alike in
    doc_id and text share one line and are repeats of each other.
    """
    import xxhash

    reach = length - feature
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id", F.xxhash64("t").alias("key"), F.col("t").cast("binary").alias("data")
    )
    low_class = widths[0]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch.column("data").to_pylist()
            for a, b in runs([len(t) for t in texts], GROUP_BYTES):
                data = b"".join(texts[a:b])
                ends = np.cumsum([len(t) for t in texts[a:b]])
                found = anchors(np.frombuffer(data, np.uint8), ends, length, feature)
                if not len(found):
                    continue
                owner = np.searchsorted(ends, found, side="right")
                begin = np.concatenate([[0], ends[:-1]])[owner]
                left = np.minimum(found - begin, reach)
                right = np.minimum(ends[owner] - found, length)
                at, lf, rt = found.tolist(), left.tolist(), right.tolist()
                features = [digest(data[p : p + feature]) for p in at]
                spans = [digest(data[p - x : p + y], x << 16 | y) for p, x, y in zip(at, lf, rt, strict=True)]
                rows_of = pa.array(a + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows_of),
                        batch.column("key").take(rows_of),
                        pa.array(found - begin),
                        pa.array(left),
                        pa.array(right),
                        pa.array(_signed(features)),
                        pa.array(_signed(spans)),
                    ],
                    names=["doc_id", "key", "pos", "left", "right", "feature", "span"],
                )

    found = stored(
        map_arrow(
            rows,
            first_pass,
            f"doc_id {kind}, key long, pos long, left long, right long, feature long, span long",
        ),
        "suffix-anchors",
    )
    uid = F.xxhash64("doc_id", "key", "pos")
    by_span = stored(
        found.groupBy("feature", "span").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "pos")).alias("rep")
        ),
        "suffix-spans",
    )
    twice = by_span.filter("n > 1")
    whole = found.join(broadcast_within(twice.select("feature", "span"), 24), ["feature", "span"]).select(
        "doc_id", "key", (F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b")
    )
    covered = [stored(whole, "suffix-covered")]
    mixed = by_span.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter(
        "k > 1 and least = 1"
    )
    members = by_span.join(mixed.select("feature"), "feature", "left_semi").select(
        "rep.*", (F.col("n") == 1).alias("open")
    )
    # The surroundings of what is left, cut out of the texts once.
    wanted = stored(
        members.groupBy("doc_id", "key").agg(F.collect_list(2 * F.col("pos") + F.col("open").cast("long")).alias("places")),
        "suffix-members",
    )
    discard(found, by_span)
    size = 24 + 8 * F.size("places")
    around = rows.join(
        broadcast_within(wanted.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "places"), size),
        F.expr("doc_id <=> d AND key = k"),
    )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, left, opens, data = [], [], [], [], []
            places = batch.column("places").to_pylist()
            for i, text in enumerate(batch.column("data").to_pylist()):
                for p in places[i]:
                    pos, open_ = p >> 1, p & 1
                    begin = max(0, pos - reach)
                    row.append(i)
                    at.append(pos)
                    left.append(pos - begin)
                    opens.append(open_)
                    data.append(text[begin : pos + length])
            rows_of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows_of) for c in ("doc_id", "key")]
                + [pa.array(x, pa.int64()) for x in (at, left, opens)]
                + [pa.array(data, pa.binary())],
                names=["doc_id", "key", "pos", "left", "open", "data"],
            )

    near = stored(
        map_arrow(
            around.select("doc_id", "key", "data", "places"),
            cut_out,
            f"doc_id {kind}, key long, pos long, left long, open long, data binary",
        ).withColumn("uid", uid),
        "suffix-near",
    )
    discard(wanted)
    # A class and whether it is open travel as one number.
    classes = F.sequence(F.lit(0), F.lit(reach // low_class))
    todo = near.select("uid", "left", "data", F.transform(classes, lambda c: 2 * c + F.col("open")).alias("classes"))
    anchor = near.select("uid", "doc_id", "key", "pos")

    for depth, width in enumerate(widths):
        ways = _Spans(length, feature, width)

        def digits(batches: Iterator[pa.RecordBatch], ways=ways) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_64_intdigest
            for batch in batches:
                row, opens, digit, span, lows, highs = [], [], [], [], [], []
                lists, lefts = batch.column("classes").to_pylist(), batch.column("left").to_pylist()
                for i, data in enumerate(batch.column("data").to_pylist()):
                    left = lefts[i]
                    for c in lists[i]:
                        cls = c >> 1
                        got = ways.of(cls, left, len(data) - left)
                        if got:
                            first, last, df, dt, sf, st = got
                            row.append(i)
                            opens.append(c & 1)
                            digit.append(digest(data[left + df : left + dt], cls))
                            span.append(digest(data[left + sf : left + st], first << 16 | last))
                            lows.append(first)
                            highs.append(last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").take(pa.array(row, pa.int64()))]
                    + [pa.array(_signed(x)) for x in (digit, span)]
                    + [pa.array(x, pa.int32()) for x in (opens, lows, highs)],
                    names=["uid", "digit", "span", "open", "first", "last"],
                )

        named = stored(
            map_arrow(
                todo.select("uid", "left", "data", "classes"),
                digits,
                "uid long, digit long, span long, open int, first int, last int",
            ),
            f"suffix-pass{depth + 1}",
        )
        # The digit was hashed with its class, and holds the feature.
        spans = stored(
            named.groupBy("digit", "span").agg(
                F.count(F.lit(1)).alias("n"),
                F.min(F.struct("uid", "first")).alias("rep"),
                F.max("open").alias("open"),
            ),
            f"suffix-spans{depth + 1}",
        )
        settled = spans.filter("n > 1 and open = 1").select("digit", "span")
        done = (
            named.filter("open = 1")
            .join(broadcast_within(settled, 24), ["digit", "span"])
            .groupBy("uid")
            .agg(F.collect_list(F.struct("first", "last")).alias("windows"))  # at most the classes
        )
        part = anchor.join(broadcast_within(done, 16 + 8 * F.size("windows")), "uid").select(
            "doc_id", "key", "pos", F.explode("windows").alias("w")
        )
        covered.append(
            stored(
                part.select(
                    "doc_id", "key", (F.col("pos") - F.col("w.last")).alias("a"), (F.col("pos") - F.col("w.first") + length).alias("b")
                ),
                "suffix-covered",
            )
        )
        if depth + 1 < len(widths):
            undecided = (
                spans.groupBy("digit")
                .agg(F.count(F.lit(1)).alias("k"), F.max(F.expr("n = 1 and open = 1")).alias("need"))
                .filter("k > 1 and need")
            )
            fine = widths[depth + 1]
            low = f"(rep.first div {width}) * {width // fine}"
            # The classes of the next pass inside each class that is not decided.
            inside = f"sequence({low}, least({low} + {width // fine - 1}, {reach // fine}))"
            following = stored(
                spans.join(undecided.select("digit"), "digit", "left_semi")
                .select("rep.uid", F.explode(F.expr(inside)).alias("cls"), F.expr("int(n = 1 and open = 1)").alias("open"))
                .groupBy("uid")
                .agg(F.collect_list(2 * F.col("cls") + F.col("open")).alias("classes")),
                f"suffix-next{depth + 1}",
            )
            todo = near.join(broadcast_within(following, 16 + 8 * F.size("classes")), "uid")
        discard(named, spans)

    places = covered[0]
    for more in covered[1:]:
        places = places.unionByName(more)
    discard(near)
    gathered = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("places"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for some in batch.column("places").to_pylist():
                runs: list[list[int]] = []
                for a, b in sorted((p["a"], p["b"]) for p in some):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                starts.append([r[0] for r in runs])
                ends.append([r[1] for r in runs])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(starts, longs), pa.array(ends, longs)],
                names=["doc_id", "key", "starts", "ends"],
            )

    return map_arrow(gathered, merge, f"doc_id {kind}, key long, starts array<long>, ends array<long>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, feature: int = FEATURE, widths=WIDTHS) -> DataFrame:
    """One row per document: what is left of its bytes once repeats are gone.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes
    that remain) and kept_sha256. Null counts as empty; texts shorter than
    ``length`` and tables without repeats keep all; overlaps inside one text
    count; matches never cross texts. An empty table gives no rows.
    """
    runs = stored(repeated_spans(docs, length, feature, widths), "suffix-runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id", F.xxhash64("t").alias("key"), F.col("t").cast("binary").alias("data")
    )
    both = rows.join(
        broadcast_within(
            runs.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "starts", "ends"),
            32 + 16 * F.size("starts"),
        ),
        F.expr("doc_id <=> d AND key = k"),
        "left",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans, total, digests = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("data", "starts", "ends"))
            for data, starts, ends in zip(*columns, strict=True):
                starts, ends = starts or [], ends or []
                rest = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
                kept.append(rest)
                total.append(len(data))
                removed.append(len(data) - len(rest))
                spans.append(len(starts))
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array(x, pa.int64()) for x in (total, removed, spans)]
                + [pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return map_arrow(both.select("doc_id", "data", "starts", "ends"), cut, schema)


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
