"""Every query of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from listinglens.llm import (  # noqa: F401
    collocations,
    decontamination,
    exact,
    html,
    language,
    mixing,
    pii,
    resampling,
    shinglejoin,
    simhash,
    suffixes,
    tokens,
    toxicity,
)
from listinglens.llm.base import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
