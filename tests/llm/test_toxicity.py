"""The chain against enumeration, spans and scores of held-out documents, odd rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import common, crf, toxicity


def enumerate_chain(scores, trans):
    """P(toxic) of each word and log of the sum over all labelings, clean words before and after."""
    n, total, on = len(scores), 0.0, np.zeros(len(scores))
    pairs = np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        path = (0, *y, 0)
        steps = list(zip(path, path[1:]))
        weight = math.exp(sum(s for s, k in zip(scores, y) if k) + sum(trans[a, b] for a, b in steps))
        total += weight
        on += weight * np.array(y)
        for a, b in steps:
            pairs[a, b] += weight
    return on / total, pairs / total


@pytest.mark.parametrize("sizes", [[5], [0], [3, 0, 4, 1, 6], [1] * 9, [8, 8]])
def test_marginals(sizes):
    rng = np.random.default_rng(len(sizes))
    scores, trans = rng.normal(0, 2, sum(sizes)), np.array([[0.0, -1.2], [0.4, 0.9]])
    chain = toxicity.Chain(np.array(sizes))
    p, pairs = chain.marginals(scores, trans)
    cuts = np.cumsum([0, *sizes])
    want = [enumerate_chain(scores[i:j], trans) for i, j in zip(cuts[:-1], cuts[1:])]
    assert np.allclose(p, np.concatenate([w for w, _ in want]) if sum(sizes) else [])
    filled = chain.side * chain.columns - sum(sizes) - len(sizes)  # clean places that complete the last column
    assert np.allclose(pairs, sum(w for _, w in want) + np.array([[filled, 0], [0, 0]]))
    h = np.array([-np.log1p(-w).sum() for w, _ in want])
    assert np.allclose(chain.evidence(p, len(sizes))[h > 0], np.log(np.expm1(h[h > 0])))


SLURS = ["blorg", "snarfle", "vequ"]


def text(rng, bad, n=40):
    words = ["".join(rng.choice(["ta", "lo", "mi", "re", "sun", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    if bad:
        for _ in range(2):
            slur = rng.choice(SLURS)
            words[rng.randrange(n)] = (slur + rng.choice(["ta", "lo", "re", "xo", "pi"]) if slur == "vequ" else slur) + rng.choice(["", ",", "!"])
    return " ".join(words).capitalize()


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(7)
    rows = [(k, text(rng, k % 4 == 0)) for k in range(1200)]
    rows += [(5000 + k, t) for k, t in enumerate([None, "", " \n\t", "x" * 5000, "blorg", "Blorg, blorg ta", "blorg \n" * 3000, "ta lo " * 9000 + "snarfle"])]
    docs = spark.createDataFrame([(d, t, 1.0, "s") for d, t in rows], "doc_id long, text string, score double, spans string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(1200)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    return dict(rows), docs, labels


def test_held_out_documents_and_spans(spark, made):
    texts, docs, labels = made
    got = {r.doc_id: r for r in toxicity.tag_documents(docs, labels).collect()}
    assert got.keys() == texts.keys()
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in range(1200))
    assert all((got[k].score >= 0.5) == (k % 4 == 0) for k in held)
    for k in held:
        for s in got[k].spans:
            assert any(w in texts[k][s.start : s.end].lower() for w in SLURS) and 0.5 < s.probability <= 1
    assert all(got[k].spans for k in held if k % 4 == 0) and not any(got[k].spans for k in held if k % 4)
    clean = got[5001].score
    assert got[5000].score == got[5002].score == clean < 0.5 and got[5000].spans == []
    assert got[5005].spans[0].start == 0 and texts[5005][: got[5005].spans[0].end] in ("Blorg, blorg", "Blorg,")
    assert got[5006].score > 0.5 and got[5007].score > 0.5  # beyond any prefix
    assert texts[5007][got[5007].spans[-1].start :] == "snarfle"


def test_query_columns_and_repeats(spark, made):
    _, docs, labels = made
    twice = docs.unionByName(docs.filter("doc_id < 40")).unionByName(spark.createDataFrame([(None, "blorg", 0.0, "")], docs.schema))
    rows = toxicity.op11(twice, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted", "n_spans"]
    got = rows.collect()
    assert len(got) == 1200 + 8 + 40 + 1
    for k in range(40):
        same = {(r.score, r.predicted) for r in got if r.doc_id == k}
        assert len(same) == 1 and same.pop()[1] == int(k % 4 == 0)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_no_labels_and_no_documents(spark, made):
    _, docs, labels = made
    assert {r.predicted for r in toxicity.op11(docs.limit(20), labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.op11(docs.limit(20), labels.filter("toxic = 0")).collect()} == {0}
    assert toxicity.op11(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, made):
    _, docs, labels = made
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    few = docs.filter("doc_id % 10 = 0")
    scores = lambda x: {r.doc_id: r.score for r in toxicity.op11(few, x).collect()}
    assert scores(labels) == scores(flipped)


def test_a_long_document_costs_the_sample_only_itself(spark):
    docs = spark.createDataFrame([(k, "ab cd\n" * (10_000 if k % 7 == 0 else 3)) for k in range(1, 60)] + [(1, "zz")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, quality int")
    every = common.F.lit(True)
    sample, counts = common.labelled_sample(docs, labels, "quality", every, 100, 2000)
    assert len(sample) == 51 and sum(len(t) for t, _ in sample) < 1000 and counts == {0: 29, 1: 30}
    sample, _ = common.labelled_sample(docs, labels, "quality", every, 20, 2000, balanced=True)
    assert 12 <= len(sample) <= 20 and abs(2 * sum(y for _, y in sample) - len(sample)) <= 6


def test_line_field_passes_over_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(crf, "LABEL_BYTES", 60_000)
    good, bad = "Plain words of a line that says something.\n" * 3, "### $$$ !!! BUY NOW\n" * 3
    docs = spark.createDataFrame([(k, good if k % 2 else bad) for k in range(40)] + [(100, bad * 2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(100, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in crf.score_documents(docs, labels).collect()}
    assert all((got[k] > 0.5) == bool(k % 2) for k in range(40))
