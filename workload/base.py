"""Registry of queries and of the SQL building blocks they are checked with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listinglens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    """Define a named SQL block that queries and other blocks may select from."""
    BLOCKS[name] = sql


def compose(body: str) -> str:
    """Prefix ``body`` with the blocks it needs, in order of dependency."""
    ordered: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_]+\b", text):
            if word in BLOCKS and word not in open_names:
                open_names.add(word)
                visit(BLOCKS[word])
                ordered.append(word)

    visit(body)
    if not ordered:
        return body
    # A block may be recursive; the keyword is harmless for the others.
    ctes = ",\n".join(f"{name} AS (\n{BLOCKS[name]}\n)" for name in ordered)
    return f"WITH RECURSIVE {ctes}\n{body}"


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The output table of a stage, written once per application and data folder.

    Feed queries read stored stage tables, they do not re-run the stages.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent for the SQL check."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
