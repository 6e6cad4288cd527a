"""The stages in order: what each keeps, held against its operator and brute force."""

from collections import Counter

import corpus_pipeline
from tidewatch.llm import common, rules, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, SF)
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "test")
        results.append(docs)
    kept, single, clean, mixed, packed = results
    source = common.documents(spark, SF)
    assert all(r.columns == source.columns for r in results[:4])
    verdicts = {r.doc_id for r in rules.op8(source, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdicts
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in clean.collect()} <= verdicts
    assert all(len(r.text) == r.n_chars for r in clean.collect())
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    enc = tokens.encoder(tokens.default_tokenizer())
    lengths = Counter()
    for r in packed.collect():
        lengths[r.doc_id] += r.length
    assert lengths == {r.doc_id: len(enc.ids(r.text)) // 4 + 1 for r in mixed.collect()}
