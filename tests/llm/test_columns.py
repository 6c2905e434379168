"""Columns of the input come out of every stage with their values and types, whatever their names; pieces and ties."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from test_tokens import JSON, ids_of, odd_texts

import corpus_pipeline
from marketlens.llm import id_files, wordwise

NAMES = "_key _id _k _row _rows _spans __spans _score _kept key id row other wanted text_key root component_id position _mid label weight".split()


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_of_any_name(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    text = "The quiet morning light fell over the old harbour while people spoke of simple things"
    rows = [(i, t) for i, t in enumerate([text, text + " again.", text.upper(), f"{text} mail a.b@c.org", None, ""])] + [(0, text), (None, text)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES) + ", n_chars int"
    full = [(i, t, *[f"{n}{i}" for n in NAMES], len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, schema)
    out = stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    found = out.collect()
    assert found
    given = {(r.doc_id, r._key): r for r in docs.collect()}
    for row in found:
        before = given[row.doc_id, row._key].asDict()
        same = [n for n in docs.columns if n not in ("text", "n_chars") or name != "PII"]
        assert {n: row[n] for n in same} == {n: before[n] for n in same}


@pytest.mark.parametrize("chunk", [40, 1 << 23])
def test_pieces_with_one_hash_are_told_apart(monkeypatch, chunk):
    monkeypatch.setattr(wordwise, "_MIX", [np.uint64(0)] * 5)
    monkeypatch.setattr(wordwise, "CHUNK_BYTES", chunk)
    encoder = wordwise.json_encoder(JSON)
    encoder.forget()
    texts = odd_texts(400) + ["the cat sat on the mat the end the cat\nThe x. The x, the"] * 2
    for text, ids in zip(texts, encoder(texts)):
        assert ids.tolist() == ids_of(text), text[:80]
    encoder.forget()


def test_few_pieces_remembered():
    encoder = wordwise.json_encoder(JSON)
    encoder.forget()
    encoder.max_words, before = 3, encoder.max_words
    texts = [f"one word{i % 7} two word{i % 5}, three.\nFour word{i}" for i in range(50)]
    for some in (texts[:1], texts[1:20], texts[20:], []):
        assert [a.tolist() for a in encoder(some)] == [ids_of(text) for text in some]
    encoder.max_words = before
    encoder.forget()


def test_documents_without_an_id_are_spread(spark, tmp_path):
    rows = [(None, f"text number {i % 40}") for i in range(300)] + [(7, f"other {i}") for i in range(300)] + [(i, "same") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = f"{tmp_path}/ids"
    id_files.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    shards = {}
    for row in spark.read.parquet(f"{path}/segments").collect():
        for doc_id in row.doc_ids:
            shards.setdefault(doc_id, set()).add(row["shard"])
    assert len(shards[None]) > 1 and len(shards[7]) > 1
    got = sorted(id_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in expected]
    assert sum(r.n_tokens for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])

    def crc(text):
        return zlib.crc32(np.array(ids_of(text) + [0], dtype="<u4").tobytes())

    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, crc(t)) for i, t in rows)
    ranks = [r.id for r in spark.read.parquet(f"{path}/codebook").orderBy("rank").collect()]
    assert len(ranks) == len(set(ranks)) == len({i for _, t in rows for i in ids_of(t)} | {0})
