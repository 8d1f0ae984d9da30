"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Each pass looks at more of a text but only for the rows that the cheaper key
left in a group of two or more. Lengths and prefixes are counted with map-side
combine, so a group that holds a third of the rows is a handful of partial
counts; what is joined back is keys, never groups of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.base import broadcast_within, keep_ids, query, stored, table

PREFIX_CHARS = 64


def exact_groups(
    docs: DataFrame, extra: Sequence[str] = (), prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and ``extra``.

    Texts are equal when identical; null counts as empty, so all null and empty
    texts form one group. keep_id is the largest doc_id of the group (null only
    if every id of it is null) and ``kept`` marks the rows that bear it: rows
    repeated with the same id share one answer. An empty table gives no rows;
    other columns of ``docs`` are ignored unless named in ``extra``.
    """
    rows = docs.select(
        "doc_id", *extra, F.coalesce("text", F.lit("")).alias("_text")
    ).withColumn("_len", F.octet_length("_text"))
    lengths = rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len")
    # There are at most as many lengths as bytes in the longest text.
    by_length = rows.join(broadcast_within(lengths, 8), "_len", "left_semi")
    prefix = F.xxhash64(F.substring("_text", 1, prefix_chars))
    prefixes = (
        by_length.groupBy("_len", prefix.alias("_prefix"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("_len", "_prefix", F.lit(True).alias("_open"))
    )
    # Only the survivors' texts are read to their end.
    marked = stored(
        rows.withColumn("_prefix", prefix)
        .join(broadcast_within(prefixes, 24), ["_len", "_prefix"], "left")
        .select("doc_id", *extra, F.when(F.col("_open"), F.sha2("_text", 256)).alias("_hash")),
        "exact-marked",
    )
    groups = (
        marked.filter("_hash is not null")
        .groupBy("_hash")
        .agg(F.count(F.lit(1)).alias("_size"), F.max("doc_id").alias("_keep"))
        .filter("_size > 1")
    )
    # Rows of no group get a key of their own: nulls must not meet in one task.
    key = F.coalesce("_hash", F.concat(F.lit("#"), F.xxhash64("doc_id").cast("string")))
    return (
        marked.withColumn("_hash", key)
        .join(broadcast_within(groups, 96), "_hash", "left")
        .select(
            "doc_id",
            F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
            F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
            *extra,
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the largest doc_id's.

    Rows repeated with that very id are reduced to one of them.
    """
    return keep_ids(docs, exact_groups(docs).filter("kept").select("doc_id"))


@query(
    "op9_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn(
        "text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)
    )
    return exact_groups(docs, extra=["text_sha256"])
