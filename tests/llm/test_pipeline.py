"""The pipeline against the stages written out plainly, each on its own input."""

import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marketlens.llm import pii


def test_stages_by_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, tables = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '')}"
        out = stage(spark, docs, small)
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append({r.doc_id: r for r in docs.collect()})
    raw, good, single, apart, masked = tables
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert all(i in good for i, label in labels.items() if label.quality == 1)
    assert sum(i in good for i, label in labels.items() if label.quality == 0) <= 1
    assert all(good[i] == raw[i] for i in good)
    best = {}
    for i, r in good.items():
        best[brute.lower_ascii(r.text)] = max(i, best.get(brute.lower_ascii(r.text), -1))
    assert single == {i: good[i] for i in best.values()}
    groups = brute.near_components([(i, r.text) for i, r in single.items()])
    assert apart == {i: single[i] for i in {root for _, root in groups.values()}}
    assert set(masked) == set(apart)
    for i, r in masked.items():
        spans, text = brute.base_spans(apart[i].text), apart[i].text
        if not spans:
            assert r == apart[i]
            continue
        assert r.n_chars == len(r.text) and not brute.base_spans(r.text)
        for start, _, span in spans:
            value = text[start : int(span.split(":")[2])]
            assert value not in r.text
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final = corpus_pipeline.run(spark, small).collect()
    lengths = {}
    for r in final:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in masked.items()}
    spots = {(r.sequence_id, r.offset + k) for r in final for k in range(r.length)}
    assert len(spots) == sum(lengths.values()) and max(at for _, at in spots) < 1024


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, make, number):
    _, stage = corpus_pipeline.STAGES[number]
    docs = make([(None, None), (1, "some text here to keep"), (1, "some text here to keep"), (2, ""), (3, None)])
    out = stage(spark, docs, "")
    assert out.count() >= 2
    assert stage(spark, docs.limit(0), "").count() == 0
    if number < 4:
        assert out.columns == docs.columns


def test_kinds_are_masked_by_name():
    assert [kind.name for kind in pii.KINDS[:4]] == ["email", "ip", "card", "phone"]
