"""Whitening against exact integers and a dense eigensolver."""

import math

import numpy as np
import pytest

from tidewatch.llm import whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def reference(pairs):
    """{(id, vector): (n, deviation, [|whitened|], [explained])} by whole matrices."""
    xs = [(d, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for d, v in pairs if sound(v)]
    size = max((len(x) for _, x in xs), default=0)
    xs = [(d, x + (0,) * (size - len(x))) for d, x in xs]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit]).reshape(n, size)
    cov = centred.T @ centred / max(n, 1)
    values, vectors = np.linalg.eigh(cov) if size else (np.zeros(0), np.zeros((0, 0)))
    keep = [k for k in range(size - 1, -1, -1) if values[k] > 1e-9 * np.trace(cov)][:4]
    out = []
    for d, x in xs:
        y = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out.append((d, n, deviation, [abs(y @ vectors[:, k]) / math.sqrt(values[k]) for k in keep], [values[k] / np.trace(cov) for k in keep]))
    return out


def compare(got, want, tolerance=1e-9):
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation), []).append(r)
    for d, n, deviation, whitened, explained in want:
        mine = sorted(rows[d, deviation], key=lambda r: r.component)
        copies = sum(1 for w in want if (w[0], w[2]) == (d, deviation))
        assert len(mine) == copies * len(whitened)
        for k, (w, e) in enumerate(zip(whitened, explained)):
            for r in mine[k * copies : (k + 1) * copies]:
                assert (r.component, r.n) == (k + 1, n)
                assert abs(abs(r.whitened) - w) <= tolerance * max(1, w) and abs(r.explained - e) <= 1e-9
                assert r.identity_error <= 1e-9


def frame(spark, pairs):
    return spark.createDataFrame([(d, v, 3, "z") for d, v in pairs], "vec_id long, embedding array<float>, n int, x string")


def test_query_over_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = whitening.op12(table)
    assert rows.columns == "vec_id component n deviation whitened explained identity_error".split()
    pairs = [(r.vec_id, r.embedding) for r in table.collect()]
    got = rows.collect()
    assert len(got) == 4 * len(pairs)
    compare(got, reference(pairs))
    signs = {}
    vectors = {r.vec_id: np.floor(256 * np.array(r.embedding, float)) for r in table.collect()}
    ids = sorted(vectors)
    y = {k: np.array([next(r.whitened for r in got if r.vec_id == d and r.component == k) for d in ids]) for k in (1, 2)}
    x = np.array([vectors[d] for d in ids])
    for k in y:  # one component for all rows: whitened is linear in the rows
        fitted = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y[k], rcond=None)[0]
        signs[k] = np.abs(np.c_[x, np.ones(len(x))] @ fitted - y[k]).max()
    assert max(signs.values()) < 1e-6


ODD = [(1, None), (2, [1.0, None, 2.0]), (3, [1.0, NAN, 0.0]), (4, [INF, 0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (6, [-0.001, 0.5, 0.25]), (7, [4.0]), (8, []), (9, [-3.0, 0.1, 9.0]), (10, [0.0, -0.0, 0.7])]


def test_odd_rows(spark):
    got = whitening.op12(frame(spark, ODD)).collect()
    compare(got, reference(ODD))
    assert {r.vec_id for r in got} == {5, None, 6, 7, 8, 9, 10}
    kept = whitening.whiten(frame(spark, ODD))
    assert kept.columns == ["vec_id", "embedding", "n", "deviation", "components", "identity_error"] and kept.count() == 8


@pytest.mark.parametrize("pairs", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_without_variance_there_is_no_component(spark, pairs):
    assert whitening.op12(frame(spark, pairs)).count() == 0
    rows = whitening.whiten(frame(spark, pairs)).collect()
    assert len(rows) == sum(sound(v) for _, v in pairs) and all(r.components == [] for r in rows)


def test_few_vectors_and_large_offsets(spark):
    two = [(1, [1000.0, 2.0]), (2, [1000.5, 2.0])]
    compare(whitening.op12(frame(spark, two)).collect(), reference(two))
    far = [(k, [1e6 + (k % 7) / 4, (k * k % 11) / 8, 5.0]) for k in range(40)]
    compare(whitening.op12(frame(spark, far)).collect(), reference(far))


def test_huge_entries_have_no_deviation(spark):
    rows = whitening.op12(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert len(rows) == 3 and all(r.deviation is None and math.isfinite(r.whitened) for r in rows)


def test_equal_deviations_are_all_found(spark):
    cross = [(2 * k + s, [float(4 * (1 - 2 * s)) if j == k else 0.0 for j in range(6)]) for k in range(6) for s in (0, 1)]
    rows = whitening.op12(frame(spark, cross)).collect()
    assert len(rows) == 48 and all(abs(r.explained - 1 / 6) < 1e-12 and r.identity_error < 1e-12 for r in rows)


def test_many_dimensions_end_early(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ALL_STEPS", 8)
    rng = np.random.default_rng(3)
    spread = np.r_[[40, 30, 20, 10], np.ones(36)]
    pairs = [(k, [float(np.float32(c)) for c in rng.standard_normal(40) * spread]) for k in range(300)]
    compare(whitening.op12(frame(spark, pairs)).collect(), reference(pairs), 1e-7)
