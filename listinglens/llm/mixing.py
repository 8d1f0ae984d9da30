"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to); a flow routes the words of each pattern to the quotas of its sources. A
pattern's words may be used again, at a cost that rises with each use, so that
the cheapest flow repeats as little as the quotas allow. The flow then says how
many words of which use of a pattern go to which source; documents are laid out
in a seeded order and those whose middle lies in such a stretch are taken.

Only one number per pattern and per source reaches the driver. Positions in the
seeded order come from two levels of sums, so a pattern holding a third of the
rows is spread over many small windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, free_name, query, stored, table

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MAX_USES = 2
SEED = 2024
ROWS_PER_CHUNK = 2000
#: Documents above this share of their pattern's words come first, largest first,
#: so that a stretch ends at a small document.
LARGE_SHARE = 0.01
WORD = r"[^\x20\x09-\x0D]+"


def source_order(source: str | None) -> tuple[bool, str]:
    """By code point, null last."""
    return (source is None, source or "")


def word_targets(
    sizes: dict[str | None, int],
    weights: Sequence[float] = WEIGHTS,
    ratio: float = RATIO,
    cap: float = MAX_USES,
) -> dict[str | None, float]:
    """Share ``ratio`` of all sizes by weight; none above ``cap`` times its size.

    ``weights`` repeat over the sources in order. What a capped source cannot
    take is shared again by weight among the rest until none is above its cap.
    """
    order = sorted(sizes, key=source_order)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = ratio * sum(sizes.values()), list(order)
    targets: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            targets.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            targets[s] = float(cap * sizes[s])
        left -= sum(targets[s] for s in over)
        open_ = [s for s in open_ if s not in targets]
    return {s: targets[s] for s in order}


@dataclass
class _Network:
    """Arcs in pairs: arc ``k ^ 1`` is the reverse of arc ``k``."""

    nodes: int
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.out: list[list[int]] = [[] for _ in range(self.nodes)]

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for tail, head, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[tail].append(len(self.to))
            self.to.append(head)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start: int, end: int) -> None:
        """Fill along cheapest paths until there is none."""
        while True:
            far = [float("inf")] * self.nodes
            came, waiting, queued = [-1] * self.nodes, deque([start]), [False] * self.nodes
            far[start] = 0
            while waiting:
                at = waiting.popleft()
                queued[at] = False
                for k in self.out[at]:
                    if self.room[k] and far[at] + self.cost[k] < far[self.to[k]]:
                        far[self.to[k]], came[self.to[k]] = far[at] + self.cost[k], k
                        if not queued[self.to[k]]:
                            queued[self.to[k]] = True
                            waiting.append(self.to[k])
            if came[end] < 0:
                return
            path, at = [], end
            while at != start:
                path.append(came[at])
                at = self.to[came[at] ^ 1]
            push = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= push
                self.room[k ^ 1] += push


def route(
    patterns: dict[tuple[str | None, ...], int], targets: dict[str | None, float], uses: int = MAX_USES
) -> dict[tuple[str | None, ...], list[tuple[str | None, int]]]:
    """Words that each pattern sends to each of its sources, in source order.

    The k-th use of a pattern's words costs (k - 1) squared a word.
    """
    names, sources = list(patterns), sorted(targets, key=source_order)
    place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    net = _Network(2 + len(names) + len(sources))
    for s in sources:
        net.arc(place[s], 1, round(targets[s]))
    arcs = {}
    for i, pattern in enumerate(names):
        for use in range(uses):
            net.arc(0, 2 + i, patterns[pattern], use * use)
        arcs[pattern] = [
            (s, net.arc(2 + i, place[s], uses * patterns[pattern])) for s in sorted(pattern, key=source_order)
        ]
    net.run(0, 1)
    return {p: [(s, net.room[k ^ 1]) for s, k in arcs[p]] for p in names}


def _stretches(size: int, sent: list[tuple[str | None, int]]) -> list[tuple[str | None, int, int]]:
    """(source, from, to) in words of one use; a stretch never leaves its use."""
    out, at = [], 0
    for source, words in sent:
        while words:
            room = min(words, size - at % size)
            out.append((source, at % size, at % size + room))
            at, words = at + room, words - room
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    ratio: float = RATIO,
    uses: int = MAX_USES,
    seed: int = SEED,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, sources, size, taken_for, copies, taken, ``extra``.

    ``docs`` has ``source`` or an array of strings ``sources`` (of a document in
    several of them). size counts words, a null text has none. ``taken_for`` names the
    source of each use, ``taken`` is copies times size. Every source's words
    come within a document of its target at each end of a stretch, no document
    is used more than ``uses`` times, and a rerun takes the same documents. A
    null source is a source of its own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    several = "sources" in docs.columns and docs.schema["sources"].dataType.simpleString() == "array<string>"
    sources = F.array_sort(F.array_distinct("sources")) if several else F.array(F.col("source").cast("string"))
    sized = stored(
        docs.select(
            "doc_id",
            *extra,
            sources.alias("sources"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_turn"),
        ).withColumn("_key", F.to_json("sources")),
        "mix-sized",
    )
    found = (
        sized.groupBy("_key", "sources").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    )
    patterns = {tuple(r["sources"]): r["size"] for r in found}
    sizes: dict[str | None, int] = {}
    for pattern, size in patterns.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + size
    targets = word_targets(sizes, weights, ratio, uses)
    sent = route(patterns, targets, uses)
    plan = spark.createDataFrame(
        [
            (
                r["_key"],
                r["size"],
                max(1, -(-r["rows"] // ROWS_PER_CHUNK)),
                [
                    {"source": s, "first": a, "last": b}
                    for s, a, b in _stretches(r["size"], sent[tuple(r["sources"])])
                ],
            )
            for r in found
        ],
        "_key string, _total long, _chunks int, _stretches array<struct<source: string, first: long, last: long>>",
    )
    plan = broadcast_within(plan, F.octet_length("_key") + 24 + 40 * F.size("_stretches"))
    # A chunk is a range of the seeded order, so chunks are ordered as their rows.
    part = F.floor((F.col("_turn") / F.lit(float(1 << 64)) + 0.5) * F.col("_chunks")).cast("int")
    large = F.col("size") > LARGE_SHARE * F.col("_total")
    laid = sized.join(plan, "_key").withColumn(
        "_chunk", F.when(large, -1).otherwise(F.least(part, F.col("_chunks") - 1))
    )
    ahead = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        laid.groupBy("_key", "_chunk")
        .agg(F.sum("size").alias("_sum"))
        .select("_key", "_chunk", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    )
    within = (
        Window.partitionBy("_key", "_chunk")
        .orderBy(F.when(F.col("_chunk") < 0, -F.col("size")), "_turn", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    twice_middle = 2 * (F.col("_before") + F.col("_upto")) - F.col("size")
    return (
        laid.withColumn("_upto", F.sum("size").over(within))
        .join(broadcast_within(before, F.octet_length("_key") + 16), ["_key", "_chunk"])
        .withColumn("_middle", twice_middle)
        .withColumn(
            "taken_for",
            F.expr(
                "transform(filter(_stretches, s -> _middle >= 2 * s.first AND _middle < 2 * s.last), s -> s.source)"
            ),
        )
        .withColumn("copies", F.size("taken_for"))
        .select("doc_id", "sources", "size", "taken_for", "copies", (F.col("copies") * F.col("size")).alias("taken"), *extra)
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is used; columns as in ``docs``.

    Rows alike in doc_id and text are used as often as they are all together.
    """
    row, copies, n, use = (free_name(docs, c) for c in ("_row", "_copies", "_n", "_use"))
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    mixed = mix(marked, extra=[row], **options)
    used = stored(
        mixed.groupBy(row).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(n)).filter(F.col(copies) > 0),
        "mix-used",
    )
    if not used.filter(F.col(n) > 1).isEmpty():
        marked = marked.dropDuplicates([row])
    return (
        marked.join(broadcast_within(used, 20), row)
        .withColumn(use, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
        .select(*docs.columns)
    )


def source_targets(mixed: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = MAX_USES) -> DataFrame:
    """(source, source_size, target) of the rows of :func:`mix`."""
    found = mixed.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("n"))
    sizes = {r["source"]: r["n"] for r in found.collect()}
    targets = word_targets(sizes, weights, ratio, cap)
    return mixed.sparkSession.createDataFrame(
        [(s, sizes[s], float(targets[s])) for s in sizes], "source string, source_size long, target double"
    )


@query("op4_mix_sources")
def op4(spark, sf_dir):
    mixed = stored(mix(table(spark, sf_dir, "documents")), "mixed")
    shares = source_targets(mixed)
    return (
        mixed.withColumn("_source", mixed["sources"][0])
        .join(broadcast_within(shares, F.coalesce(F.octet_length("source"), F.lit(0)) + 24), F.expr("_source <=> source"))
        .select("doc_id", "size", "source_size", "target", "taken", "source")
    )
