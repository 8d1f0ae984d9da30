from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listinglens.llm import exact, tokens
from listinglens.llm.base import ORACLES, QUERIES
from listinglens.session import scratch_path
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def documents(sf=SF):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


# --- exact duplicates ------------------------------------------------------


def groups_by_force(rows):
    out = []
    for doc_id, text in rows:
        same = [i for i, t in rows if (t or "") == (text or "")]
        known = [i for i in same if i is not None]
        keep = max(known) if known else None
        if len(same) == 1:
            keep = doc_id
        out.append((doc_id, keep, len(same), doc_id == keep))
    return sorted(out, key=str)


def test_exact_groups_of_odd_rows(odd, empty):
    got = exact.exact_groups(odd).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == groups_by_force([r[:2] for r in ODD])
    assert exact.exact_groups(empty).count() == 0


def test_exact_groups_tell_texts_with_one_prefix_and_length_apart(spark):
    stem = "p" * 200
    rows = [(i, stem + t) for i, t in enumerate("abacabb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_groups(df, prefix_chars=8).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == groups_by_force(rows)


def test_drop_exact_duplicates_keeps_the_columns(odd, spark):
    left = exact.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in ODD})


def test_exact_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.execute(f"SELECT {names} FROM ({ORACLES['op9_exact_dedup']}) ORDER BY doc_id").fetchall()
    got = QUERIES["op9_exact_dedup"](spark, SF).select(*names.split(", ")).orderBy("doc_id").collect()
    assert list(map(tuple, got)) == want
    assert want[0][4] == hashlib.sha256(documents()[0][1].encode()).hexdigest()


# --- token shards ----------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=400))
def test_packing_round_trip(bits, values):
    ids = np.array([v & ((1 << bits) - 1) for v in values], np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-len(ids) // 64) * bits * 8
    assert tokens.unpack(data, len(ids), bits).tolist() == ids.tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 49407), max_size=300), max_size=12), st.integers(0, 3000), st.integers(0, 400))
def test_shard_random_access(docs, start, length):
    shard = tokens.Shard(tokens.write_shard([np.array(d, np.uint32) for d in docs], 16, block_ids=64))
    flat = [i for d in docs for i in d]
    assert shard.lengths.tolist() == [len(d) for d in docs]
    assert shard.ids().tolist() == flat
    assert shard.ids(start, start + length).tolist() == flat[start : start + length]


def test_shard_rejects_other_bytes():
    with pytest.raises(ValueError):
        tokens.Shard(b"\0" * 64)


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from(list("aAbz .,;'\n\t0159é ßΣσİ́ \x1c-<|>")) | st.characters(), max_size=60))
def test_words_encode_like_whole_texts(text):
    path = tokens.tokenizer_path()
    whole = tokens._tokenizer(path).encode(text, add_special_tokens=False).ids
    assert tokens.WordEncoder(path, cached_words=50).encode(text).tolist() == whole


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a <|EndOfText|>. B", "X<|STARTOFTEXT|>y <|endoftext|>", "<|endoftext|>Z <B>"])
def test_only_special_tokens_as_written_are_special(text):
    path = tokens.tokenizer_path()
    whole = tokens._tokenizer(path).encode(text, add_special_tokens=False).ids
    assert tokens.WordEncoder(path).encode(text).tolist() == whole


def described(rows):
    """What the query returns, from whole texts in order of id and text."""
    tokenizer, at, out = tokens._tokenizer(tokens.tokenizer_path()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_token_table_of_odd_rows(odd, empty):
    got = [tuple(r) for r in tokens.token_table(odd).collect()]
    assert sorted(got, key=str) == described([r[:2] for r in ODD])
    assert tokens.token_table(empty).count() == 0


def test_small_shards_give_the_same_table(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(df, tokens.tokenizer_path(), path, shard_ids=1000)
    assert spark.read.parquet(path).count() > 8
    got = [tuple(r) for r in tokens.read_tokens(spark, path).collect()]
    assert sorted(got, key=str) == described(rows)


def test_token_query_matches_whole_texts(spark):
    got = [tuple(r) for r in QUERIES["op8_token_ids"](spark, SF).collect()]
    assert sorted(got, key=str) == described(documents())
