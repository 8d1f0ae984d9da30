from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np

import corpus_pipeline
from listinglens.llm import mixing, tokens, toxicity
from listinglens.llm.base import QUERIES, stored
from tests.llm.test_exact_tokens import described, documents
from tests.llm.test_simhash_mixing import components_by_force, fingerprint_by_force
from tests.llm.test_text_operators import leaks_by_force

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [documents(SF)]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        if at < 4:
            assert docs.columns == columns
            steps.append(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    given, clean, distinct, safe, mixed = steps

    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    learned = [(i, t) for i, t in given if i in labels and zlib.crc32(str(i).encode()) % 5]
    model = toxicity.fit([t for _, t in learned], np.array([labels[i] for i, _ in learned]))
    rows = toxicity.WordRows(model.gates, 6 * toxicity.HIDDEN, 1_000_000)
    kept = []
    for i, text in given:
        words = toxicity.WORD.findall((text or "").lower())
        numbers = rows.of([words])
        logit = model.logits(rows.rows, numbers, np.array([len(words)]))
        kept += [(i, text)] if model.probability(logit)[0] < 0.5 else []
    assert clean == sorted(kept)

    parts = components_by_force([fingerprint_by_force(t or "") for _, t in clean], [i for i, _ in clean])
    assert distinct == sorted(d for d, part in zip(clean, parts, strict=True) if d[0] == part)

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    leaks = leaks_by_force(distinct, items)
    assert leaks and safe == [d for d in distinct if d[0] not in leaks]

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in safe}
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF}/documents.parquet'").fetchall())
    sizes, taken = {}, {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    for i, _ in mixed:
        taken[source[i]] = taken.get(source[i], 0) + size[i]
    assert {i for i, _ in mixed} <= set(size) and max(np.unique([i for i, _ in mixed], return_counts=True)[1]) <= 2
    for s, target in mixing.word_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(n for i, n in size.items() if source[i] == s)

    got = [tuple(r) for r in docs.collect()]
    assert sorted(got, key=str) == described(mixed)
    assert tokens.END_ID == 2


def test_pipeline_is_a_query(spark):
    assert QUERIES["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    first = sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()))
    assert first and [r[1] for r in first] == sorted(r[1] for r in first)


def test_stages_take_empty_tables_and_extra_columns(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty, SF).count() == 0
        left = stage(spark, odd, SF)
        assert left.columns == odd.columns and left.count() > 0
