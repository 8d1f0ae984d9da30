"""Phrase collocations: tiles of ranked units, counted densely or as sorted pairs.

Phrases grow by one word a level. A unit (a word, then a frequent pair, then a
frequent triple) followed by a word is a cell of a matrix. Units and words are
ranked by frequency; the tile of the first DENSE ranks of either side is
addressed directly and counted by ``numpy.bincount``; every other cell is counted as
sorted coordinates with counts, merged as they grow. A task hands its cells on
in blocks of sparse tiles, which Spark deals out by tile and adds up. The
frequent phrases of a level are ranked anew and are the units of the next.

Words are named by 64-bit hashes of (language, word), checked to be unique, so
no dictionary travels. Two things of fixed size are sent to the tasks at each
level: the ranked units, and a bitmap of the hashes of all frequent ones, which
keeps cells out that hold an infrequent part (a false hit only costs a row).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, discard, map_arrow, query, stored, table
from listinglens.llm.words import runs

LONGEST = 4
LEAST = 30  # occurrences of a candidate
TOP = 2000
#: A candidate goes if a longer one around it has this share (percent) of its occurrences.
COVERED = 80
#: Ranks on either side of the dense tile.
DENSE = 1024
#: Bits of the bitmap of frequent units: 8 MB.
BITS = 1 << 26
#: Bytes of text in memory as words; cells that are held before they are handed to Spark.
GROUP_BYTES = 2_000_000
HELD_CELLS = 1_000_000
#: Words of the corpus for each sparse tile; it bounds the cells that are added up together.
TILE_WORDS = 250_000
LEAST_TILES = 64
HELD_WORDS = 200_000

_BREAKS = set(b".,;:!?\n\x0b\x0c\r")
#: Byte to byte: letters in lower case, ends of pieces to a newline, tabs to spaces.
_FOLD = bytes(10 if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; a newline for each end of a piece, and empty strings to pass over."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    return folded.replace(b"\n", b" \n ").split(b" ")


class Codes(dict):
    """The 64-bit name of each word of one language; 0 ends a piece, 1 is no word."""

    def __init__(self, lang: str):
        super().__init__({b"\n": 0, b"": 1})
        self.seed = zlib.crc32(lang.encode())

    def __missing__(self, word: bytes) -> int:
        import xxhash

        code = xxhash.xxh64_intdigest(word, self.seed)
        code = code if code > 1 else code + 2
        self[word] = code
        return code


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a phrase, from its beginning's and its last word's."""
    value = left * np.uint64(0x9E3779B97F4A7C15) + right
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def phrase_codes(words: list[np.ndarray]) -> np.ndarray:
    """Names of phrases given as one array per word."""
    value = words[0]
    for word in words[1:]:
        value = joined(value, word)
    return value


def _bits(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a name in the bitmap."""
    other = code * np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64(BITS - 1)
    return (code >> np.uint64(20)) & mask, (other >> np.uint64(30)) & mask


def _marked(bitmap: np.ndarray, code: np.ndarray) -> np.ndarray:
    first, second = _bits(code)
    three, seven = np.uint64(3), np.uint64(7)
    hit = (bitmap[first >> three] >> (first & seven).astype(np.uint8)) & 1
    return (hit & (bitmap[second >> three] >> (second & seven).astype(np.uint8)) & 1).astype(bool)


def _texts_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, at most GROUP_BYTES (or one text) at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for start, stop in runs(sizes, GROUP_BYTES):
            part = batch.slice(start, stop - start)
            found = defaultdict(list)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                found[lang].append(text)
            yield from found.items()


# --- words -----------------------------------------------------------------


def vocabulary(texts: DataFrame) -> DataFrame:
    """(lang, code, word, n) of every word of ``texts`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                codes, every = Codes(lang), [w for w in counts if w not in (b"", b"\n")]
                for start in range(0, len(every), 50_000):
                    words = every[start : start + 50_000]
                    code = np.fromiter((codes[w] for w in words), np.uint64, len(words))
                    yield pa.record_batch(
                        {
                            "lang": pa.array([lang] * len(words), pa.string()),
                            "code": pa.array(code.view(np.int64)),
                            "word": pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string()),
                            "n": pa.array([counts[w] for w in words], pa.int64()),
                        }
                    )
            held.clear()

        for lang, group in _texts_by_lang(batches):
            for text in group:
                held[lang].update(tokens(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from handed()
        yield from handed()

    found = map_arrow(texts, run, "lang string, code long, word string, n long")
    return found.groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))


# --- phrases ---------------------------------------------------------------


def _columns(size: int) -> list[str]:
    return [f"w{i + 1}" for i in range(size)]


def _ranked(frequent: DataFrame, size: int) -> np.ndarray:
    """The DENSE most frequent phrases, one row of word names each."""
    words = _columns(size)
    rows = frequent.orderBy(F.desc("n"), *words).limit(DENSE).select(*words).collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(len(rows), size).view(np.uint64)


def _bitmap(frequent: DataFrame, size: int) -> np.ndarray:
    """The bitmap of the names of all ``frequent`` phrases; of the same size however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            yield pa.record_batch({"bit": pa.array(np.concatenate(_bits(phrase_codes(words))).astype(np.int64))})

    places = map_arrow(frequent.select(*_columns(size)), run, "bit long")
    pieces = places.groupBy(F.expr("shiftright(bit, 15)").alias("piece")).agg(
        F.expr("bitmap_construct_agg(bit & 32767)").alias("bits")
    )
    bitmap = np.zeros(BITS // 8, np.uint8)
    for row in pieces.collect():  # at most BITS / 32768 rows of 4096 bytes
        bitmap[row["piece"] * 4096 :][:4096] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


class Tiles:
    """Counts of (unit, word) cells: the dense tile, and sorted coordinates in sparse tiles beyond it."""

    def __init__(self, units: np.ndarray, words: np.ndarray, tiles: int):
        self.units, self.words, self.tiles = units, words[:, 0], tiles
        names = phrase_codes(list(units.T)) if len(units) else np.zeros(0, np.uint64)
        self.unit_order, self.word_order = np.argsort(names), np.argsort(self.words)
        self.unit_names, self.word_names = names[self.unit_order], self.words[self.word_order]
        self.dense = np.zeros(len(units) * len(words), np.int64)
        self._clear()

    def _clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.cells = 0

    @staticmethod
    def _rank(names: np.ndarray, order: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Rank of each code, -1 if it has none."""
        if not len(names):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(names, code), len(names) - 1)
        return np.where(names[at] == code, order[at], -1)

    def add(self, unit: np.ndarray, words: list[np.ndarray]) -> None:
        """Count the phrases of ``words`` (one array per word) whose beginnings are named ``unit``."""
        row = self._rank(self.unit_names, self.unit_order, unit)
        column = self._rank(self.word_names, self.word_order, words[-1])
        ranked = (row >= 0) & (column >= 0)
        if len(self.dense):
            cell = row[ranked] * len(self.words) + column[ranked]
            self.dense += np.bincount(cell, minlength=len(self.dense))
        rest = np.flatnonzero(~ranked)
        code = joined(unit[rest], words[-1][rest])
        code, first, n = np.unique(code, return_index=True, return_counts=True)
        self.parts.append((code, n, np.stack([w[rest[first]] for w in words])))
        self.cells += len(code)

    def merge(self) -> None:
        code = np.concatenate([p[0] for p in self.parts])
        code, first, place = np.unique(code, return_index=True, return_inverse=True)
        n = np.zeros(len(code), np.int64)
        np.add.at(n, place, np.concatenate([p[1] for p in self.parts]))
        words = np.concatenate([p[2] for p in self.parts], axis=1)[:, first]
        self.parts, self.cells = [(code, n, words)], len(code)

    def blocks(self, code: np.ndarray, words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(tile, words, n): the cells of each tile as arrays."""
        tile = (code % np.uint64(self.tiles)).astype(np.int64)
        order = np.argsort(tile, kind="stable")
        tile, words, n = tile[order], words[:, order], n[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        ends = np.append(starts[1:], len(tile))
        for at in range(0, len(starts), 200):
            spans = list(zip(starts[at : at + 200], ends[at : at + 200], strict=True))
            yield pa.record_batch(
                {
                    "tile": pa.array([tile[a] for a, _ in spans], pa.int64()),
                    "words": pa.array([words[:, a:b].tobytes() for a, b in spans], pa.binary()),
                    "n": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
                }
            )

    def overflow(self, most: int = HELD_CELLS) -> Iterator[pa.RecordBatch]:
        """Hand the sparse cells on once more than ``most`` are held."""
        if self.cells > most:
            self.merge()
            if 2 * self.cells > most:
                code, n, words = self.parts[0]
                yield from self.blocks(code, words, n)
                self._clear()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All that is left: the sparse cells and the dense tile."""
        if self.parts:
            self.merge()
            code, n, words = self.parts[0]
            yield from self.blocks(code, words, n)
        cell = np.flatnonzero(self.dense)
        row, column = np.divmod(cell, max(len(self.words), 1))
        words = np.stack([*self.units[row].T, self.words[column]])
        yield from self.blocks(phrase_codes(list(words)), words, self.dense[cell])


def _added_up(size: int, least: int):
    """Adds up the blocks of one tile; cells with at least ``least`` stay."""

    def add(blocks: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint64).reshape(size, -1) for b in blocks.column("words").to_pylist()]
        words = np.concatenate(parts, axis=1)
        n = np.concatenate([np.frombuffer(b, np.int64) for b in blocks.column("n").to_pylist()])
        code, first, place = np.unique(phrase_codes(list(words)), return_index=True, return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, place, n)
        enough = total >= least
        arrays = [pa.array(np.ascontiguousarray(w[first[enough]]).view(np.int64)) for w in words]
        return pa.table([*arrays, pa.array(total[enough])], names=[*_columns(size), "n"])

    return add


def phrases(
    texts: DataFrame, size: int, frequent: DataFrame, words: np.ndarray, tiles: int, least: int = LEAST
) -> DataFrame:
    """(w1..w``size``, n) of the phrases that occur ``least`` times.

    ``frequent`` has those of one word less; ``words`` are the ranked words.
    """
    context = texts.sparkSession.sparkContext
    units = words if size == 2 else _ranked(frequent, size - 1)
    sent = context.broadcast((_bitmap(frequent, size - 1), units, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, units, ranked = sent.value
        counts = Tiles(units, ranked, tiles)
        codes: dict[str, Codes] = {}
        for lang, group in _texts_by_lang(batches):
            if sum(map(len, codes.values())) > HELD_WORDS:
                codes.clear()
            known = codes[lang] if lang in codes else codes.setdefault(lang, Codes(lang))
            found = [word for text in group for word in (b"\n", *tokens(text))]
            code = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
            code = code[code != 1]
            piece = np.cumsum(code == 0)
            inside = code != 0
            code, piece = code[inside], piece[inside]
            count = len(code) - size + 1
            if count < 1:
                continue
            shorter = phrase_codes([code[i : i + count + 1] for i in range(size - 1)])
            hit = _marked(bitmap, shorter)
            at = np.flatnonzero(hit[:-1] & hit[1:] & (piece[:count] == piece[size - 1 :]))
            counts.add(shorter[at], [code[at + i] for i in range(size)])
            yield from counts.overflow()
        yield from counts.rest()

    blocks = map_arrow(texts, run, "tile long, words binary, n binary")
    schema = ", ".join(f"{c} long" for c in [*_columns(size), "n"])
    return blocks.groupBy("tile").applyInArrow(_added_up(size, least), schema)


def _scored(found: dict[int, DataFrame], size: int) -> DataFrame:
    """(w1.., a, l, r, score) of the phrases of ``size`` words that no longer one covers."""
    words = _columns(size)
    out = found[size].withColumnRenamed("n", "a")
    if size + 1 in found:
        # A phrase around a longer one cannot occur more often than that, so one word more is enough.
        longer = found[size + 1].select(*_columns(size + 1), "n")
        parts = [longer.select(*[F.col(f"w{i + 1 + j}").alias(w) for i, w in enumerate(words)], "n") for j in (0, 1)]
        most = parts[0].unionByName(parts[1]).groupBy(*words).agg(F.max("n").alias("most"))
        out = out.join(most, words, "left").filter(f"most IS NULL OR 100 * most < {COVERED} * a").drop("most")
    cuts = []
    for k in range(1, size):
        for side, cut in (("l", words[:k]), ("r", words[k:])):
            named = {c: cut[i] for i, c in enumerate(_columns(len(cut)))}
            part = found[len(cut)].select(*[F.col(c).alias(n) for c, n in named.items()], F.col("n").alias(f"{side}{k}"))
            out = out.join(broadcast_within(part, 8 * len(cut) + 8), cut)
        # Decimals: the product may pass 64 bits.
        score = f"CAST(CAST(2000000 AS DECIMAL(8)) * CAST(a AS DECIMAL(20)) DIV (CAST(l{k} AS DECIMAL(20)) + r{k}) AS LONG)"
        cuts.append(f"named_struct('score', {score}, 'k', {k}, 'l', l{k}, 'r', r{k})")
    best = F.expr(f"array_min(array({', '.join(cuts)}))").alias("best")
    return out.select(*words, "a", best).select(*words, "a", "best.l", "best.r", "best.score")


def _first(ranked: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each lang, numbered; narrowed over ever fewer pieces, so no task sees a whole lang."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for pieces in (4096, 64, 1):
        piece = F.pmod(F.xxhash64("phrase"), F.lit(pieces))
        within = Window.partitionBy("lang", piece).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(within).cast("long")).filter(F.col("rank") <= top)
    return ranked


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has ``text`` and ``lang`` (null: ``und``). A phrase of two to four
    words inside a piece is a candidate if it occurs ``least`` times; its score is
    that of its lowest cut; one that a longer candidate mostly covers goes. Null,
    empty and very long texts count with the words they have; repeated rows
    count as often as they occur; ties go to the phrase first in byte order.
    Extra columns are ignored. A lang without candidates, and an empty table,
    give no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    known = stored(vocabulary(texts), "words")
    clash = known.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not clash.isEmpty():
        raise ValueError("two words have one name; choose other seeds")
    frequent = stored(known.filter(F.col("n") >= least).withColumnRenamed("code", "w1"), "frequent-words")
    words = _ranked(frequent, 1)
    found = {1: frequent.select("w1", "n")}
    total = known.agg(F.sum("n")).first()[0] or 0
    tiles = max(LEAST_TILES, total // TILE_WORDS)
    for size in range(2, LONGEST + 1):
        found[size] = stored(phrases(texts, size, found[size - 1], words, tiles, least), f"phrases-{size}")
    parts = []
    for size in range(2, LONGEST + 1):
        part = _scored(found, size)
        for i in range(size):
            name = frequent.select(F.col("w1").alias(f"w{i + 1}"), F.col("word").alias(f"s{i}"), *(["lang"] if i == 0 else []))
            part = part.join(broadcast_within(name, F.octet_length(f"s{i}") + 16), f"w{i + 1}")
        phrase = F.concat_ws(" ", *[f"s{i}" for i in range(size)])
        parts.append(part.select("lang", phrase.alias("phrase"), "a", "l", "r", "score"))
    scored = parts[0].unionByName(parts[1]).unionByName(parts[2])
    totals = known.groupBy("lang").agg(F.sum("n").alias("n"))
    first = stored(_first(scored, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(known, frequent, *[found[size] for size in range(2, LONGEST + 1)])
    return first


_LEADS = ", ".join(f"lead(w, {i}) OVER piece_words AS v{i + 1}" for i in range(1, LONGEST))
_GRAMS = "\n    UNION ALL ".join(
    f"SELECT lang, {size} AS size, concat_ws(' ', {', '.join(f'v{i + 1}' for i in range(size))}) AS phrase FROM ahead WHERE v{size} IS NOT NULL"
    for size in range(1, LONGEST + 1)
)

_SQL = rf"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), split AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), pieces AS (
    SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM split
), placed AS (
    SELECT id, lang, unnest(words) AS w, unnest(range(len(words))) AS pos FROM pieces
), ahead AS (
    SELECT lang, w AS v1, {_LEADS} FROM placed WINDOW piece_words AS (PARTITION BY id ORDER BY pos)
), grams AS (
    {_GRAMS}
), f AS (
    SELECT lang, size, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), totals AS (
    SELECT lang, count(*) AS n FROM ahead GROUP BY lang
), cuts AS (
    SELECT lang, phrase, c, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS v FROM f WHERE size >= 2
), scores AS (
    SELECT cuts.lang, cuts.phrase, cuts.c AS a, p.c AS l, q.c AS r, k, 2000000::HUGEINT * cuts.c // (p.c + q.c) AS score
    FROM cuts
    JOIN f AS p ON p.lang = cuts.lang AND p.phrase = array_to_string(v[:k], ' ')
    JOIN f AS q ON q.lang = cuts.lang AND q.phrase = array_to_string(v[k + 1:], ' ')
), best AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), starts AS (
    SELECT lang, size, c, string_split(phrase, ' ') AS v, unnest(range(1, size)) AS first FROM f WHERE size >= 3
), inner_parts AS (
    SELECT lang, c, size, v, first, unnest(range(first + 1, size + 1)) AS last FROM starts
), around AS (
    SELECT lang, array_to_string(v[first:last], ' ') AS phrase, max(c) AS most
    FROM inner_parts WHERE last - first + 1 < size GROUP BY ALL
), kept AS (
    SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE most IS NULL OR 100 * most < {COVERED} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}
"""


@query("op11_collocations", _SQL)
def op11(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
