"""SimHash near-duplicates by a segment-popcount embedding and a grid join.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of their bit counts (0, 1 or 2), kept in one long with each count
written in unary: the number of differing bits of two embeddings is then the
Manhattan distance of the vectors, which is at most the Hamming distance of the
fingerprints. The segments form six groups. Fingerprints at most three bits
apart have equal counts in three groups at least, so they meet in one of the
20 grids whose cells are the counts of three groups. In a cell the Manhattan
bound is applied first, then the exact distance.

A cell shared by more than CROWD fingerprints (thousands of near copies) is not
compared pair by pair. Its members are linked through the strings in between:
two fingerprints at most two bits apart share a string within one bit of each,
so one aggregate over 65 strings per member links them all; those three bits
apart share a string within one bit of the one and two of the other, and only
members outside their cell's largest component have to list their two-bit
neighbourhood. Both ways are exact and linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, keep_ids, map_arrow, query, stored, table
from listinglens.operators.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
CROWD = 64
#: Bits of the two-bit segments of each of the six groups.
GROUP_BITS = (10, 10, 10, 10, 12, 12)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits; each is set if it is set in over half of the shingles' hashes.

    Fewer words than a shingle has count as one shingle; no word gives zero.
    """
    import xxhash

    word = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not word:
        return 0
    joined = zip(*(word[i:] for i in range(words)), strict=False) if len(word) >= words else [word]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), 42) for s in joined], np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every whole text, fp as a signed long; null is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return map_arrow(docs.select("doc_id", text), run, f"doc_id {kind}, fp long")


# --- the grid --------------------------------------------------------------

_LOW = "6148914691236517205L"  # every even bit


def embedding(fp: str) -> str:
    """SQL of the unary segment counts of the long ``fp``."""
    half = f"shiftrightunsigned({fp}, 1)"
    return f"((({fp} | {half}) & {_LOW}) | shiftleft(({fp} & {half}) & {_LOW}, 1))"


def grid_masks() -> list[int]:
    """For each choice of three groups, the bits of their segments (signed)."""
    masks, at = [], 0
    for bits in GROUP_BITS:
        masks.append(((1 << bits) - 1) << at)
        at += bits
    chosen = [sum(c) for c in combinations(masks, 3)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]


def grid_cells(fps: DataFrame) -> DataFrame:
    """(grid, cell, fp): each fingerprint once in each of the 20 grids."""
    masks = F.array(*[F.lit(m).cast("long") for m in grid_masks()])
    return (
        fps.select("fp", F.expr(embedding("fp")).alias("e"))
        .select("fp", "e", F.posexplode(masks).alias("grid", "mask"))
        .select("grid", F.expr("e & mask").alias("cell"), "fp")
    )


def _near(a: str, b: str) -> str:
    bound = f"bit_count({embedding(a)} ^ {embedding(b)}) <= {MAX_BITS}"
    return f"{b} > {a} AND {bound} AND bit_count({a} ^ {b}) <= {MAX_BITS}"


def _flips(fp: str, i: str) -> str:
    """``fp`` with bit ``i`` flipped; position 64 flips nothing."""
    return f"({fp} ^ CASE WHEN {i} < 64 THEN shiftleft(1L, {i}) ELSE 0L END)"


def _crowd_links(members: DataFrame) -> DataFrame:
    """(a_id, b_id) that link the ``members`` (grid, cell, fp) of crowded cells."""
    fps = members.select("fp").distinct()
    ball = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select(
        "fp", F.expr(_flips("fp", "i")).alias("z")
    )
    hubs = stored(ball.groupBy("z").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")), "simhash-hubs")
    near = stored(
        ball.join(hubs.filter("n > 1").select("z", "m"), "z")
        .filter("fp <> m")
        .select(F.col("fp").alias("a_id"), F.col("m").alias("b_id"))
        .distinct(),
        "simhash-near",
    )
    parts = connected_components(fps.select(F.col("fp").alias("id")), near)
    placed = stored(members.join(parts.select(F.col("id").alias("fp"), "component"), "fp"), "simhash-placed")
    sizes = placed.groupBy("grid", "cell", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("grid", "cell").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest")
    )
    outside = (
        placed.join(broadcast_within(largest, 24), ["grid", "cell"])
        .filter("component <> largest")
        .select("fp")
        .distinct()
    )
    wide = (
        outside.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        .select("fp", "i", F.explode(F.expr("sequence(i + 1, 64)")).alias("j"))
        .select("fp", F.expr(_flips(_flips("fp", "i"), "j")).alias("z"))
    )
    far = (
        wide.join(hubs.select("z", "m"), "z")
        .filter("fp <> m")
        .select(F.col("fp").alias("a_id"), F.col("m").alias("b_id"))
        .distinct()
    )
    return near.unionByName(far)


def fingerprint_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a_id, b_id) pairs of distinct ``fps`` (fp) at most three bits apart.

    Their connected components are those of all such pairs; inside a crowded
    cell not every pair is listed.
    """
    cells = stored(grid_cells(fps), "simhash-cells")
    counts = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(cells.join(counts, ["grid", "cell"]), "simhash-shared")
    pairs = (
        shared.filter(F.col("n") <= crowd)
        .groupBy("grid", "cell")
        .agg(F.collect_list("fp").alias("fps"))  # at most ``crowd``
        .select(F.explode("fps").alias("a_id"), "fps")
        .select("a_id", F.expr(f"explode(filter(fps, b -> {_near('a_id', 'b')}))").alias("b_id"))
        .distinct()
    )
    crowded = shared.filter(F.col("n") > crowd).select("grid", "cell", "fp")
    if crowded.isEmpty():
        return pairs
    return pairs.unionByName(_crowd_links(crowded))


def simhash_components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id.

    component_id is the smallest doc_id that can be reached over links of at
    most three bits, the row itself included; null ids are no candidates, so it
    is null only where all ids are. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. Repeated rows come out as
    often as they come in; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs), "simhash-fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = stored(fingerprint_links(fps.select("fp"), crowd), "simhash-links")
    ends = links.select(F.col("a_id").alias("id")).union(links.select("b_id")).distinct()
    parts = connected_components(ends, links)
    linked = parts.join(fps.select(F.col("fp").alias("id"), "least"), "id")
    lowest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(lowest, "component").select(F.col("id").alias("fp"), "component_id")
    classes = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(broadcast_within(classes, 24), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the smallest doc_id's.

    Rows alike in doc_id and text are reduced to one; rows of a component
    without any id are one document and stay the same way.
    """
    return keep_ids(docs, simhash_components(docs).filter("doc_id <=> component_id").select("doc_id"))


@query("op10_simhash_components")
def op10(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))
