"""Stages of the pipeline on rows with null and repeated doc_ids and columns named as the stages' own."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from tidewatch.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, copy int, kept boolean, component_id long, clean string, tag int"


def _texts():
    rng = random.Random(7)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n))
    base, other, passage = fresh(120), fresh(90), fresh(20)
    near = base + " " + fresh(2)
    return [
        (None, fresh(80)), (None, fresh(70) + " " + passage), (None, near), (None, None), (None, ""),
        (10**9, base), (10**9, base), (10**9, base), (10**9, other), (10**9 + 1, fresh(60) + " " + passage),
        (10**9 + 2, other), (10**9 + 3, "short"), (10**9 + 3, "short"), (10**9 + 4, "a b " * 100), (10**9 + 5, fresh(200)), (10**9 + 5, fresh(75) + " " + passage),
    ]


ROWS = [(d, t, "en", f"s{k % 2}" if k % 5 else None, len(t or ""), "x", 9, False, -1, "y", k) for k, (d, t) in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(1).sortWithinPartitions("tag")


def in_order():
    return sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))


def test_quality_rules_keep_rows_without_doc_id(spark, docs):
    def passes(text):  # none of the labels is about these rows
        w = (text or "").split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)

    got = corpus_pipeline.quality_rules(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.tag for r in got.collect()) == [r[-1] for r in ROWS if passes(r[1])]


def test_near_duplicates_keep_one_row_a_group(spark, docs):
    rows = in_order()
    sets = []
    for r in rows:
        w = (r[1] or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = sorted(rows[k][-1] for k in range(len(rows)) if group[k] == k)
    assert sorted(r.tag for r in got.collect()) == want and len(want) < len(rows)


def test_repeated_passages_keep_every_row_once(spark, docs):
    first, want = {}, {}
    for k, r in enumerate(in_order()):
        text = r[1] or ""
        gone = set()
        for q in range(len(text) - 49):
            if first.setdefault(text[q : q + 50], k) < k:
                gone.update(range(q, q + 50))
        want[r[-1]] = "".join(c for i, c in enumerate(text) if i not in gone)
    got = corpus_pipeline.repeated_passages(spark, docs, SF)
    rows = got.collect()
    assert got.columns == docs.columns and len(rows) == len(ROWS)
    assert {r.tag: (r.doc_id, r.text, r.n_chars) for r in rows} == {r[-1]: (r[0], want[r[-1]], len(want[r[-1]])) for r in ROWS}


def test_mixture_takes_each_row_as_often_as_its_share(spark, docs):
    words = {r[-1]: len((r[1] or "").split()) for r in ROWS}
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += words[r[-1]]
    target = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    got = corpus_pipeline.mixture(spark, docs, SF)
    assert got.columns == docs.columns
    ids = defaultdict(list)
    for r in got.collect():
        ids[r.tag].append(r.doc_id)
    highest, taken, largest = max(r[0] for r in ROWS if r[0]), Counter(), Counter()
    for r in ROWS:
        n, rate = words[r[-1]], target[r[3]] / sizes[r[3]]
        assert len(ids[r[-1]]) in ((int(rate), int(rate) + 1) if n else (0,))
        taken[r[3]] += n * len(ids[r[-1]])
        largest[r[3]] = max(largest[r[3]], n)
        if r[0] is None:
            assert not any(ids[r[-1]])
        elif ids[r[-1]]:
            assert sorted(ids[r[-1]])[0] == r[0] and all(d > highest for d in sorted(ids[r[-1]])[1:])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
