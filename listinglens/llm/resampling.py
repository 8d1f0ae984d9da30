"""Importance resampling towards a target: hashed n-gram features over segments.

A newline separates words, so a text is cut at newlines into lines. What a line
contributes depends on the line alone: the corpus is reduced to distinct lines
with their number of occurrences (combined in the task, then by Spark), each
distinct line's features are counted once and multiplied. The n-grams that cross
a newline are made of the last two and first two words of the lines around it;
they are counted apart and added. Documents are weighed the same way: each
distinct line of a batch once, what crosses lines added.

Features are runs of one to three words, named by the CRC-32 of their bytes.
CRC-32 is linear over GF(2): the checksum of a run is the checksum of its
beginning, moved on by the length of the next word, xor that word's checksum.
So only distinct words are read byte by byte, runs are numpy look-ups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, map_arrow, query, stored, table
from listinglens.llm.words import runs

BUCKETS = 10_000
LONGEST_RUN = 3
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text whose words are in memory together (one text at least).
GROUP_BYTES = 2_000_000

# --- words and checksums ---------------------------------------------------

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz\n") | set(range(128, 256))
#: Byte to byte: letters in lower case, all that separates words (but the newline) to a space.
_FOLD = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def lines_of(text: str | None) -> list[bytes]:
    """The lines of a text, folded; in UTF-8, where every byte from 128 on belongs to a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b"\n")


def _byte_step() -> np.ndarray:
    """The checksum of each single byte, from the polynomial of CRC-32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return value


class Shift:
    """Moves checksums on by a number of zero bytes, many at a time."""

    SHORT = 64  # lengths below it have a table each, longer ones are composed of powers of two

    def __init__(self):
        step = _byte_step()
        low = np.arange(256, dtype=np.uint32)
        tables = [np.stack([low << np.uint32(8 * j) for j in range(4)])]
        for _ in range(self.SHORT):
            tables.append((tables[-1] >> np.uint32(8)) ^ step[tables[-1] & np.uint32(255)])
        self.tables = np.stack(tables)

    @staticmethod
    def _apply(table: np.ndarray, value: np.ndarray) -> np.ndarray:
        eight, low = np.uint32(8), np.uint32(255)
        out = table[0][value & low]
        for j in range(1, 4):
            out = out ^ table[j][(value >> np.uint32(8 * j)) & low]
        return out

    def __call__(self, value: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = length % self.SHORT
        flat = self.tables.reshape(-1)
        at = short * 1024
        out = flat[at + (value & np.uint32(255))]
        for j in range(1, 4):
            out = out ^ flat[at + 256 * j + ((value >> np.uint32(8 * j)) & np.uint32(255))]
        power, rest = self.tables[self.SHORT], length // self.SHORT
        while rest.any():
            odd = (rest & 1).astype(bool)
            out[odd] = self._apply(power, out[odd])
            power, rest = self._apply(power, power), rest >> 1
        return out


class RunBuckets:
    """Buckets of all runs of one to three words that stay inside a stretch."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.shift = buckets, Shift()

    def __call__(self, words: list[bytes]) -> list[np.ndarray]:
        """For each length, the bucket of the run that begins at each word (where one does)."""
        place: dict[bytes, int] = {}
        at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        alone = np.fromiter(map(zlib.crc32, place), np.uint32, len(place))[at]
        spaced = np.fromiter((zlib.crc32(b" " + w) for w in place), np.uint32, len(place))[at]
        length = np.fromiter(map(len, place), np.int64, len(place))[at] + 1
        found, value = [alone], alone
        for n in range(1, min(LONGEST_RUN, len(words))):
            value = self.shift(value[:-1], length[n:]) ^ spaced[n:]
            found.append(value)
        return [(v % np.uint32(self.buckets)).astype(np.int64) for v in found]


def _inside(found: list[np.ndarray], line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, bucket) of the runs that stay in one line."""
    for n, bucket in enumerate(found):
        first = np.flatnonzero(line[: len(bucket)] == line[n:])
        yield first, bucket[first]


class Edges:
    """The words around the newlines of texts, and the runs that cross one.

    Of a line with more than four words only the first two and the last two can
    belong to a run that leaves it; between them is a gap.
    """

    def __init__(self):
        self.words: list[bytes] = []
        self.line: list[int] = []
        self.place: list[int] = []
        self.owner: list[int] = []
        self._line = self._place = 0

    def add(self, owner: int, lines: list[bytes]) -> None:
        for line in lines:
            head = line.split(None, 4)
            if not head:
                continue
            if len(head) > 4:
                ends = [*head[:2], *line.rsplit(None, 2)[-2:]]
                places = [0, 1, 3, 4]
            else:
                ends, places = head, range(len(head))
            self._line += 1
            self.words += ends
            self.line += [self._line] * len(ends)
            self.place += [self._place + p for p in places]
            self.owner += [owner] * len(ends)
            self._place += places[-1] + 1
        self._place += 1  # runs never join two texts
        self._line += 1

    def crossing(self, buckets: RunBuckets) -> tuple[np.ndarray, np.ndarray]:
        """(owner, bucket) of every run over more than one line."""
        line, place, owner = (np.array(x, np.int64) for x in (self.line, self.place, self.owner))
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, bucket in enumerate(buckets(self.words)):
            last = slice(n, None)
            whole = (place[last] - place[: len(bucket)] == n) & (line[last] != line[: len(bucket)])
            owners.append(owner[: len(bucket)][whole])
            found.append(bucket[whole])
        return np.concatenate(owners), np.concatenate(found)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of at most GROUP_BYTES (or one row), with the column's values."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for start, stop in runs(sizes, GROUP_BYTES):
            part = batch.slice(start, stop - start)
            yield part, part.column(column).to_pylist()


# --- counts of a corpus ----------------------------------------------------


def segments(texts: DataFrame) -> DataFrame:
    """(line, bucket, times) of ``texts`` (text): distinct lines, and buckets of what crosses lines.

    A row has either a line or a bucket; ``times`` says how often it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, across = RunBuckets(), np.zeros(BUCKETS, np.int64)
        for _, group in _groups(batches, "text"):
            seen: Counter[bytes] = Counter()
            edges = Edges()
            for text in group:
                lines = [stripped for line in lines_of(text) if (stripped := line.strip())]
                seen.update(lines)
                if len(lines) > 1:
                    edges.add(0, lines)
            across += np.bincount(edges.crossing(buckets)[1], minlength=BUCKETS)
            if seen:
                yield pa.record_batch(
                    {
                        "line": pa.array(seen.keys(), pa.binary()),
                        "bucket": pa.nulls(len(seen), pa.int32()),
                        "times": pa.array(seen.values(), pa.int64()),
                    }
                )
        at = np.flatnonzero(across)
        yield pa.record_batch(
            {"line": pa.nulls(len(at), pa.binary()), "bucket": pa.array(at, pa.int32()), "times": pa.array(across[at])}
        )

    found = map_arrow(texts.select("text"), run, "line binary, bucket int, times long")
    return found.groupBy("line", "bucket").agg(F.sum("times").alias("times"))


def feature_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in ``texts`` (text); null texts have no feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = RunBuckets(), np.zeros(BUCKETS, np.int64)
        for part, lines in _groups(batches, "line"):
            times = part.column("times").to_numpy()
            bucket = part.column("bucket")
            across = bucket.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(total, bucket.drop_null().to_numpy(), times[across])
            words = [(line or b"").split() for line in lines]
            count = np.array([len(w) for w in words])
            line = np.repeat(np.arange(len(words)), count)
            for first, got in _inside(buckets([w for ws in words for w in ws]), line):
                np.add.at(total, got, times[line[first]])
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "times": pa.array(total[at])})

    found = map_arrow(segments(texts), run, "bucket int, times long")
    counts = np.zeros(BUCKETS, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("times").alias("times")).collect():  # at most BUCKETS
        counts[row["bucket"]] = row["times"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the target's over the corpus' smoothed share) of each bucket."""
    s, t = corpus.astype(float), target.astype(float)
    share = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(share)).astype(np.int64)


# --- documents -------------------------------------------------------------


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = RunBuckets()
        for part, texts in _groups(batches, "text"):
            place: dict[bytes, int] = {}
            owner, used = [], []
            edges = Edges()
            for i, text in enumerate(texts):
                lines = [stripped for line in lines_of(text) if (stripped := line.strip())]
                used += [place.setdefault(line, len(place)) for line in lines]
                owner += [i] * len(lines)
                if len(lines) > 1:
                    edges.add(i, lines)
            words = [line.split() for line in place]
            count = np.array([len(w) for w in words], np.int64)
            line = np.repeat(np.arange(len(words)), count)
            worth = np.zeros(len(words), np.int64)
            for first, got in _inside(buckets([w for ws in words for w in ws]), line):
                np.add.at(worth, line[first], gains[got])
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            np.add.at(n, owner, count[used] if used else 0)
            np.add.at(weight, owner, worth[used] if used else 0)
            crossing, got = edges.crossing(buckets)
            np.add.at(weight, crossing, gains[got])
            features = sum(np.maximum(n - longer, 0) for longer in range(LONGEST_RUN))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(features), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The seeded draw of a document: floor(-1000 * log of an exponential variate)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, most: int) -> DataFrame:
    """``scored`` with ``rank``, up to ``most``, by score descending, doc_id ascending.

    The rows are laid out by range of the order; each range is numbered by itself
    and begins after the sizes of those before it, so no task sees all rows.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    pieces = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(
        scored.repartitionByRange(pieces, *order).withColumn("_range", F.spark_partition_id()), "resampled"
    )
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(*order)
    placed = laid.join(broadcast_within(starts, 16), "_range")
    position = F.col("_before") + F.row_number().over(within)
    return (
        placed.withColumn("rank", position)
        .withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
        .drop("_range", "_before")
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null if it is not drawn).

    ``docs`` and ``target`` have ``text``; the weight of a document is the sum of
    its features' gains, its score adds a seeded draw. Of the documents with at
    least ``least_words`` words the ``percent`` with the highest scores are drawn;
    ties go to the smaller doc_id. Null and empty texts have no feature and weight
    0. A null doc_id draws like an empty one and ranks last among ties; repeated
    rows come out, and are drawn, as often as they come in. Extra columns are
    ignored; an empty table gives no rows, an empty target uniform gains.
    """
    gains = bucket_gains(feature_counts(docs), feature_counts(target))
    weighed = stored(weigh(docs, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "weighed")
    enough = F.col("n_words") >= least_words
    most = percent * weighed.filter(enough).count() // 100
    ranked = _ranked(weighed.filter(enough), most)
    rest = weighed.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of the bytes 1, 2, 4, ... 128 alone: fixed values of the checksum's definition.
_ONES = [1996959894, 3993919788, 124634137, 249268274, 498536548, 997073096, 1994146192, 3988292384]
_MOVES = [f"CASE WHEN (xor(c, b) & {1 << i}) > 0 THEN {v} ELSE 0 END" for i, v in enumerate(_ONES)]


def _xor_chain(terms: list[str]) -> str:
    out = terms[0]
    for term in terms[1:]:
        out = f"xor({out}, {term})"
    return out


_SQL = rf"""
WITH texts AS (
    SELECT doc_id AS id, 0 AS side, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT item_id, 1, coalesce(text, '') FROM benchmark
), words AS (
    SELECT id, side, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), placed AS (
    SELECT id, side, unnest(w) AS w1, unnest(range(len(w))) AS pos FROM words
), ahead AS (
    SELECT *, lead(w1, 1) OVER run AS w2, lead(w1, 2) OVER run AS w3 FROM placed
    WINDOW run AS (PARTITION BY side, id ORDER BY pos)
), features AS (
    SELECT id, side, w1 AS feature FROM ahead
    UNION ALL SELECT id, side, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
    UNION ALL SELECT id, side, w1 || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL
), counted AS (
    SELECT id, side, feature, count(*) AS n FROM features GROUP BY ALL
), bytes AS (
    SELECT feature, list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(feature))),
        lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT)) AS b
    FROM (SELECT DISTINCT feature FROM counted)
), named AS (
    SELECT feature, xor(list_reduce(b, lambda c, b: {_xor_chain(["c >> 8", *_MOVES])}), 4294967295) % 10000 AS bucket
    FROM bytes
), totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
    FROM counted JOIN named USING (feature) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000)
        / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000))))::BIGINT AS gain FROM totals
), weights AS (
    SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM counted JOIN named USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
    SELECT words.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || words.id), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words LEFT JOIN weights ON weights.doc_id = words.id WHERE side = 0
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN place <= 5 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query("op13_importance_resampling", _SQL)
def op13(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
