"""Histogram boosting against a booster that holds the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boosting


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 20)), 3)
    x[:, 3], x[:, 4] = np.floor(x[:, 3] * 2), 7.0
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 0) + 0.5 * rng.normal(size=n) > 0.8).astype(int)
    return x, y, np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * (n - y.sum())))


def frame(spark, x, y, w, parts):
    return spark.createDataFrame([(r.tolist(), int(a), float(b)) for r, a, b in zip(x, y, w)], "features array<double>, label int, weight double").repartition(parts)


def brute(x, y, w, edges, rounds, depth, rate, l2, least):
    bins = np.stack([(x[:, k, None] > e).sum(axis=1) for k, e in enumerate(edges)], axis=1)
    margin = np.full(len(x), np.log((w * y).sum() / (w * (1 - y)).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        step = np.zeros(len(x))

        def grow(at, left):
            best = (0.0, None)
            side = lambda i: g[i].sum() ** 2 / (h[i].sum() + l2)
            for f in range(x.shape[1]) if left else ():
                for b in range(len(edges[f])):
                    go = bins[at, f] <= b
                    a, z = at[go], at[~go]
                    if min(len(a), len(z)) >= least and min(h[a].sum(), h[z].sum()) >= 1e-3:
                        gain = side(a) + side(z) - side(at)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (a, z))
            if best[1] is None:
                step[at] = -rate * g[at].sum() / (h[at].sum() + l2)
            else:
                for part in best[1]:
                    grow(part, left - 1)

        grow(np.arange(len(x)), depth)
        margin = margin + step
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("l2", [5.0, 0.0])
def test_equals_a_booster_of_the_whole_table(spark, monkeypatch, l2):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    monkeypatch.setattr(boosting, "PART_BYTES", 4000)
    x, y, w = table(400, 5)
    rows = frame(spark, x, y, w, 3)
    model = boosting.fit(rows, 5, 3, 0.3, l2, 20, bins=12)
    assert len(model.trees) == 5 and all(len(e) <= 11 for e in model.edges) and len(model.edges[4]) == 0
    want = brute(x, y, w, model.edges, 5, 3, 0.3, l2, 20)
    got = np.array([r.score for r in boosting.score(frame(spark, x, y, w, 1), model).collect()])
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-9)
    again = boosting.Boosted.from_json(model.to_json())
    assert np.allclose([r.score for r in boosting.score(frame(spark, x, y, w, 1), again).collect()], got)


def test_l2_shrinks_leaves(spark):
    x, y, w = table(300, 2)
    rows = frame(spark, x, y, w, 2)
    free, held = (boosting.fit(rows, 1, 3, 0.1, l2, 20).trees[0] for l2 in (0.0, 50.0))
    assert np.abs(held[held[:, 0] < 0, 4]).max() < np.abs(free[free[:, 0] < 0, 4]).max()


def test_little_to_learn(spark):
    x, y, w = table(30, 1)
    rows = frame(spark, x, y, w, 2)
    assert boosting.fit(rows, 3).trees == []  # no cut leaves 20 rows on both sides
    scores = {round(r.score, 9) for r in boosting.score(rows, boosting.fit(rows, 3)).collect()}
    assert scores == {0.5}
    none = rows.limit(0)
    assert boosting.fit(none).trees == [] and boosting.score(none, boosting.fit(none)).count() == 0
    assert boosting.fit(rows.withColumn("label", F.lit(1)), 3).base > 10


def test_a_pass_is_dealt_to_cores_before_parts_grow_large(spark, monkeypatch):
    x, y, w = table(20_000, 4)
    parts, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda data, *rest: parts.append(data.rdd.getNumPartitions()) or level(data, *rest))
    model = boosting.fit(frame(spark, x, y, w, 1), rounds=2)
    assert min(parts) > 1
    bins = model.bins(x)
    for tree in model.trees:
        for row in range(0, len(x), 499):
            at = 0
            while tree[at, 0] >= 0:
                at = int(tree[at, 2] if bins[row, int(tree[at, 0])] <= tree[at, 1] else tree[at, 3])
            assert boosting.leaves(tree, bins[row : row + 1])[0] == at
