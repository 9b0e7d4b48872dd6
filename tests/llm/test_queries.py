"""The registered queries over whole small tables, against plain versions or held-out labels."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries

from . import brute

DATA = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
MOST = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, ''), lang FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    return {i: (t, lang) for i, t, lang in rows}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def collected(spark, name, folder=DATA):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


def test_op2_is_what_its_contract_says(spark, texts):
    found = collected(spark, "op2_spotsigs")
    order = sorted(texts)
    assert set(found) == set(order)
    for k, i in enumerate(order):
        text, after = texts[i][0], texts[order[(k + 1) % len(order)]][0]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        sets = [{x[a : a + 8] for a in range(0, len(x), 8)} for x in (found[i].fingerprint, found[i].edited_fingerprint, found[order[(k + 1) % len(order)]].fingerprint)]
        for other, near in ((sets[1], found[i].near_edited), (sets[2], found[i].near_next)):
            assert near == pytest.approx(len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)
    same = {}
    for i in order:
        assert same.setdefault(texts[i][0], found[i].fingerprint) == found[i].fingerprint


def test_op5_counts_what_the_library_counts(spark, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    found = collected(spark, "op5_token_count")
    wanted = {i: (len(t.encode()), len(model.encode(t))) for i, (t, _) in texts.items()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in found.items()} == wanted
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found.values())


def test_op8_base_scores_are_exact_and_the_model_beats_them(spark, texts):
    found = collected(spark, "op8_recurrent_lm")
    tokens = {i: [*brute.WORDS.findall(t.translate(brute.LOWER)), None] for i, (t, _) in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if crc(i, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 5) == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9, abs=1e-6)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4_finds_held_out_languages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    found = collected(spark, "op4_language_id", MORE)
    assert set(found) == set(docs)
    held = [i for i in docs if crc(i, 5) == 0 and docs[i].lang is not None and any(c.isalpha() for c in docs[i].text or "")]
    assert all(found[i].held_out == (crc(i, 5) == 0) and 0 <= found[i].score <= 1 for i in found)
    assert sum(found[i].lang_pred == docs[i].lang for i in held) >= 0.98 * len(held) > 100


def test_op1_finds_held_out_toxic_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MOST}/labels.parquet").collect()}
    found = collected(spark, "op1_toxicity", MOST)
    assert all(r.held_out == (crc(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in found.items())
    held = [i for i in toxic if i in found and found[i].held_out and toxic[i] is not None]
    right = sum(found[i].predicted for i in held if toxic[i] == 1)
    assert right >= 0.9 * sum(toxic[i] == 1 for i in held) > 100
    assert sum(found[i].predicted for i in held if toxic[i] == 0) <= 0.01 * len(held)


def test_op7_reads_back_what_it_wrote(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n")).collect()
    rows = queries.QUERIES["op7_chat_format"](spark, DATA).collect()
    given = Counter()
    for r in rows:
        given[r.conv_id] += r.n_given
        assert len(r.roles.split(",")) == r.n_turns and r.n_right <= min(r.n_given, r.n_turns)
    assert given == {r.conv_id: r.n for r in turns}
    assert sum(r.n_right for r in rows) >= 0.75 * sum(r.n_given for r in rows)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_rendezvous_shards", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    connection = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    wanted = connection.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(wanted.columns)
    cell = lambda x: None if pd.isna(x) else x if isinstance(x, str) else int(x)
    assert sorted(found.columns) == columns
    rows = [sorted((tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr) for frame in (found.toPandas(), wanted)]
    assert rows[0] == rows[1] and rows[0]
