"""Token ids in packed binary shards: fixed bits per id, block offsets.

A shard is one self-contained byte string holding whole documents in order::

    magic "FWTS" | u16 version | u16 bits | u32 block ids | u64 docs | u64 ids
    u64 x docs    number of ids of each document
    u64 x blocks  byte offset of each block in the payload
    payload       ids, ``bits`` each, least significant bit first

64 ids of w bits fill exactly w 64-bit words, so packing and unpacking are 64
vectorised numpy steps, and any block can be read alone. Shards are rows of a
Parquet table: Spark's commit protocol makes the write safe against lost
executors, and any store that Spark can write will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglens.llm.base import KEPT, map_arrow, query, table
from listinglens.llm.words import runs
from listinglens.session import scratch_path

MAGIC = b"FWTS"
HEADER = struct.Struct("<4sHHIQQ")
BLOCK_IDS = 4096
SHARD_IDS = 1 << 19
#: Distinct words whose ids a Python worker keeps, as written and folded; then it starts anew.
CACHED_WORDS = 1_000_000
#: Characters that are encoded together.
GROUP_CHARS = 1_000_000
END_ID = 2


# --- the file format -------------------------------------------------------


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` each, padded to a multiple of 64 ids."""
    groups = -(-len(ids) // 64)
    full = np.zeros(groups * 64, np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(groups, 64)
    words = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= full[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= full[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(payload: bytes, count: int, bits: int) -> np.ndarray:
    groups = -(-count // 64)
    words = np.frombuffer(payload, "<u8", groups * bits).reshape(groups, bits)
    out = np.zeros((groups, 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)[:count].astype(np.uint32)


def write_shard(docs: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The bytes of a shard; ``block_ids`` is a multiple of 64."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    lengths = np.array([len(d) for d in docs], "<u8")
    blocks = -(-len(ids) // block_ids)
    offsets = np.arange(blocks, dtype="<u8") * (block_ids * bits // 8)
    head = HEADER.pack(MAGIC, 1, bits, block_ids, len(docs), len(ids))
    return head + lengths.tobytes() + offsets.tobytes() + pack(ids, bits)


def id_count(head: bytes) -> int:
    """Ids in the shard that begins with ``head``."""
    return HEADER.unpack_from(head)[5]


class Shard:
    """Reads a shard: ``lengths``, any range of ids, or all of them."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block_ids, docs, self.count = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.lengths = np.frombuffer(data, "<u8", docs, at)
        blocks = -(-self.count // self.block_ids)
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 8 * docs)
        self.payload = memoryview(data)[at + 8 * docs + 8 * blocks :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``; only their blocks are unpacked."""
        stop = self.count if stop is None else min(stop, self.count)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        count = min(self.count, (last + 1) * self.block_ids) - first * self.block_ids
        got = unpack(self.payload[int(self.offsets[first]) :], count, self.bits)
        return got[start - first * self.block_ids : stop - first * self.block_ids]


# --- encoding --------------------------------------------------------------


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words. Texts are cut at spaces and line feeds only,
    which every definition of white space contains.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.tokenizer, self.cached_words = _tokenizer(path), cached_words
        self.known: dict[str, bytes] = {"": b""}
        self.plain: dict[str, bytes] = {"": b""}
        # A special token is cut out before anything else, so words on its two
        # sides are encoded apart, many of them in one call.
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.mark = special[0] if special else None
        # Added tokens are found before case is folded.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized]

    def _pieces(self, words: list[str]) -> list[bytes]:
        if self.mark and not any("<" in w for w in words):
            number, token = self.mark
            got = self.tokenizer.encode_batch_fast([token.content.join(words)], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(ids == number)
            if len(cuts) == len(words) - 1:
                raw, edges = ids.tobytes(), cuts.tolist()
                return [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in edges)], [*edges, len(ids)], strict=True)]
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(g.ids, "<u4").tobytes() for g in got]

    def _learn(self, words: set[str]) -> None:
        # A stop after a letter starts a new piece; case is folded in any event,
        # unless the word would become one with an added token.
        cut = {}
        for word in words:
            stem = word
            if word.isascii() and word[-1] in ".," and word[-2:-1].isalpha():
                stem = word[:-1]
            low = stem.lower() if stem.isascii() else stem
            cut[word] = (stem if any(t in low for t in self.added) else low, word[len(stem) :])
        fresh = list({part for parts in cut.values() for part in parts if part not in self.plain})
        for start in range(0, len(fresh), 20_000):
            part = fresh[start : start + 20_000]
            self.plain.update(zip(part, self._pieces(part), strict=True))
        for word, (stem, tail) in cut.items():
            self.known[word] = self.plain[stem] + self.plain[tail]

    def encode(self, text: str, end_id: int | None = None) -> np.ndarray:
        return self.encode_all([text], end_id)[0]

    def encode_all(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text; what is new in all of them is learned in one call."""
        if len(self.known) > self.cached_words:
            self.known = {"": b""}
        if len(self.plain) > self.cached_words:
            self.plain = {"": b""}
        split, fresh = [t.replace("\n", " ").split(" ") for t in texts], set()
        for words in split:
            fresh.update(set(words).difference(self.known))
        if fresh:
            self._learn(fresh)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, words)) + tail, "<u4") for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def _forget() -> None:
    _ENCODERS.clear()
    _tokenizer.cache_clear()


KEPT[__name__] = _forget


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary_bits(path: str) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, (_tokenizer(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS
) -> None:
    """Encode every whole text and write shards below ``path`` in doc_id order.

    Null texts are empty: just the end id. Null ids come first; rows repeated
    with one id keep a fixed order by their text. Documents are dealt out by
    ranges of doc_id, so partitions are ordered and no task holds more than its
    range; a shard is closed at ``shard_ids`` ids and never splits a document.
    """
    spark = docs.sparkSession
    bits = vocabulary_bits(tokenizer)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(tasks, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq, part, kept = _encoder(tokenizer), 0, 0, None
        ids, rows, held = [], [], 0

        def close() -> pa.RecordBatch:
            shard = write_shard(rows, bits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([ids], pa.list_(kept)),
                    pa.array([shard], pa.binary()),
                ],
                names=["part", "seq", "doc_ids", "shard"],
            )

        for batch in batches:
            kept = batch.schema.field("doc_id").type
            keys, texts, parts = (batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))
            for a, b in runs([len(t) for t in texts], GROUP_CHARS):
                part = parts[a]
                for key, got in zip(keys[a:b], encoder.encode_all(texts[a:b], end_id), strict=True):
                    ids.append(key)
                    rows.append(got)
                    held += len(got)
                    if held >= shard_ids:
                        yield close()
                        ids, rows, held, seq = [], [], 0, seq + 1
        if rows:
            yield close()

    schema = f"part int, seq int, doc_ids array<{kind}>, shard binary"
    map_arrow(ordered, encode, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: where its ids lie and their crc.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, seqs, keys, shards = (batch.column(c) for c in ("part", "seq", "doc_ids", "shard"))
            for row in range(batch.num_rows):
                shard = Shard(shards[row].as_py())
                view = memoryview(shard.ids().astype("<u4")).cast("B")
                lengths = shard.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(crc), parts[row].as_py(), np.int32)),
                        pa.array(np.full(len(crc), seqs[row].as_py(), np.int32)),
                        keys[row].values,
                        pa.array(starts),
                        pa.array(lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    # Offsets in two levels: within a part, a shard at a time; then over the parts.
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array([id_count(b) for b in batch.column("head").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("seq"), counts], names=["part", "seq", "n"]
            )

    head = F.expr(f"substring(shard, 1, {HEADER.size})").alias("head")
    counts = map_arrow(shards.select("part", "seq", head), heads, "part int, seq int, n long")
    ahead = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = [], 0
    for part in sorted(sums):  # one number per partition of the write
        base.append((part, total))
        total += sums[part]
    bases = spark.createDataFrame(base, "part int, base long")
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(
        F.broadcast(bases), "part"
    )
    schema = f"part int, seq int, doc_id {kind}, within long, n_tokens long, ids_crc32 long"
    return (
        map_arrow(shards, decode, schema)
        .join(starts, ["part", "seq"])
        .select("doc_id", (F.col("base") + F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_table(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards and describe what was read back from them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer or tokenizer_path(), path)
    return read_tokens(spark, path)


@query("op8_token_ids")
def op8(spark, sf_dir):
    return token_table(table(spark, sf_dir, "documents"))
