"""Models on made-up samples with known answers, and sums that must not depend on partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import attribution, evaluation, models, profile, protocol
from tidewatch.plans import more
from tidewatch.schema import STATE_FEATURES

SAMPLE = "capture_id long, window long, context array<array<double>>, target_state array<double>, target_stage array<int>, target_infil array<int>, target_mask array<boolean>"


@pytest.fixture(scope="module")
def samples(spark):
    """Three features that follow the two windows before them; the stage of the next windows is told by the last one's first."""
    rng = np.random.default_rng(0)
    rows = []
    for capture in range(4):
        x = [rng.normal(size=3), rng.normal(size=3)]
        for _ in range(70):
            x.append(0.7 * x[-1] + 0.2 * (x[-1] - x[-2]) + 0.1 * rng.normal(size=3))
        for t in range(3, 68):
            late = [2 if x[t][0] > 0 else 0] * 2
            rows.append((capture, t, [v.tolist() for v in x[t - 2 : t + 1]], x[t + 1].tolist(), late, [int(s == 2) for s in late], [True, True]))
    return spark.createDataFrame(rows, SAMPLE).repartition(5).cache()


def part(samples, *captures):
    return samples.filter(F.col("capture_id").isin(*captures))


def error(rows):
    return np.mean([(np.array(r.forecast) - np.array(r.target_state)) ** 2 for r in rows.collect()])


def test_dynamics_beat_persistence_and_can_be_saved(spark, samples, tmp_path):
    train, val, test = part(samples, 0, 1), part(samples, 2), part(samples, 3)
    model = models.fit_dynamics(train, val)
    got = error(models.predict_next(test, model))
    assert got < 0.9 * error(models.persistence(test))  # the noise alone is 0.01
    # the same by plain least squares
    rows = train.collect()
    x = np.array([np.ravel((np.array(r.context) - model.mean) / model.scale) for r in rows])
    y = np.array([(np.array(r.target_state) - np.array(r.context[-1])) / model.scale for r in rows])
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert np.allclose(model.weights, np.linalg.solve(xc.T @ xc + model.alpha * np.eye(9), xc.T @ yc))
    model.save(spark, f"file://{tmp_path}/model")
    again = models.Dynamics.load(spark, f"file://{tmp_path}/model")
    assert np.allclose(again.weights, model.weights) and again.alpha == model.alpha and np.allclose(again.bias, model.bias)


def test_the_query_forecasts_every_feature_after_every_context(spark, monkeypatch):
    rng = np.random.default_rng(3)
    f, n = len(STATE_FEATURES), 40
    x = {c: np.cumsum(rng.normal(size=(n, f)), axis=0) for c in range(4)}
    x = {c: np.where(np.arange(f) == 50, 7.0, v) for c, v in x.items()}  # a feature that never changes
    rows = [(c, t, *map(float, v[t])) for c, v in x.items() for t in range(n)]
    made = spark.createDataFrame(rows, ", ".join(["capture_id long", "window long", *(f"`{c}` double" for c in STATE_FEATURES)])).withColumn("rst_share", F.lit(0.0)).repartition(3)
    monkeypatch.setattr(more, "states_of_packets", lambda spark, sf_dir: made)
    got = more.predict_next(spark, "").toPandas()
    assert len(got) == 4 * (n - 15) * f and not got.duplicated(["capture_id", "window", "feature"]).any()
    assert set(got["window"]) == set(range(15, n)) and set(got["feature"]) == set(range(f))
    # the same in the dual form, over samples with five windows ahead; einsum needs no threads of BLAS
    dot = lambda a, b: np.einsum("ik,kj->ij", a, b)
    cut = lambda c, last: np.array([x[c][t - 15 : t + 1] for t in range(15, last)])
    train = np.concatenate([cut(c, n - 5) for c in (0, 1)])
    mean, scale = train.reshape(-1, f).mean(0), train.reshape(-1, f).std(0)
    scale = np.where(scale < 1e-8, 1.0, scale)
    flat = lambda a: ((a - mean) / scale).reshape(len(a), -1)
    change = lambda *captures: np.concatenate([(x[c][16 : n - 4] - x[c][15 : n - 5]) / scale for c in captures])
    xc, yc = flat(train) - flat(train).mean(0), change(0, 1) - change(0, 1).mean(0)
    tried = []
    for alpha in models.ALPHAS:
        weights = dot(xc.T, np.linalg.solve(dot(xc, xc.T) + alpha * np.eye(len(xc)), yc))
        bias = change(0, 1).mean(0) - dot(flat(train).mean(0)[None], weights)[0]
        tried.append((((dot(flat(cut(2, n - 5)), weights) + bias - change(2)) ** 2).sum(), weights, bias))
    _, weights, bias = min(tried, key=lambda m: m[0])
    for c in range(4):
        whole = cut(c, n)
        want = whole[:, -1] + (dot(flat(whole), weights) + bias) * scale
        mine = got[got["capture_id"] == c].sort_values(["window", "feature"])["value"].to_numpy().reshape(-1, f)
        assert np.allclose(mine, want, rtol=1e-6, atol=1e-6)


def test_standardiser_counts_a_window_as_often_as_contexts_hold_it(spark):
    x = np.cumsum(np.random.default_rng(4).normal(size=(60, 3)), axis=0)
    x[:, 1] = 1e9 + 0.1
    rows = [x[t - 3 : t + 1] for t in range(3, 60)]
    mean, scale, lo, hi = models.standardiser(spark.createDataFrame([(r.tolist(),) for r in rows], "context array<array<double>>"))
    every = np.concatenate(rows)
    assert np.allclose(mean, every.mean(0)) and np.allclose(scale, [every[:, 0].std(), 1.0, every[:, 2].std()])
    assert np.allclose(lo, (np.quantile(every, 0.005, axis=0) - mean) / scale - 1) and np.allclose(hi, (np.quantile(every, 0.995, axis=0) - mean) / scale + 1)
    assert mean[1] == 1e9 + 0.1


def test_gram_does_not_depend_on_partitions(samples):
    make = lambda b: models._matrix(b.column("target_state"))
    one = models.gram(samples.select("target_state"), 3, make)
    assert np.allclose(one, models.gram(samples.select("target_state").repartition(17), 3, make))
    assert np.allclose(models.gram(samples.limit(0).select("target_state"), 3, make), 0)


def test_heads_and_rollout(samples):
    train, val, test = part(samples, 0, 1), part(samples, 2), part(samples, 3)
    heads, dynamics = models.fit_heads(train, val, (0.03, 0.5)), models.fit_dynamics(train, val)
    rows = models.predict_heads(test, heads).collect()
    assert np.mean([(r.infiltration > 0.5) == r.target_infil[0] for r in rows]) > 0.8
    assert all(abs(sum(r.stage_probs) - 1) < 1e-6 and r.stage in ("Benign", "InitialAccess") for r in rows)
    rolled = models.rollout(test, 3, lambda r: models.predict_next(r, dynamics, clamp=True), lambda r: models.predict_heads(r, heads), length=3)
    got = {(r.window, r.step): r for r in rolled.collect()}
    assert len(got) == 65 * 3
    by_hand = {r.window: dynamics.next_state(np.array([np.ravel(r.context)]), True)[0] for r in test.collect()}
    assert all(np.allclose(got[w, 1].state, s) for w, s in by_hand.items())
    short = models.rollout(test.withColumn("context", F.slice("context", 1, 1)), 1, models.persistence, length=3)
    assert short.count() == 65
    _, peak = models.forecast_timeline(rolled, 30_000_000)
    assert all(r.peak == max(got[r.window, k].infiltration for k in (1, 2, 3)) for r in peak.collect())


def test_baselines(samples):
    train, test = part(samples, 0, 1, 2), part(samples, 3)
    for mode in ("static", "context"):
        rows = models.baseline_scores(test, models.logistic_baseline(train, 2, mode), mode).collect()
        assert np.mean([(r.p1 > 0.5) == r.target_infil[0] for r in rows]) > 0.8
    with pytest.raises(ValueError):
        models.baseline_features(test, "both")


def test_benchmark_has_every_model_at_every_step(spark, samples):
    split = spark.createDataFrame([(0, "train"), (1, "train"), (2, "val"), (3, "test")], "capture_id long, split string")
    rows = {(r.model, r.step): r for r in protocol.benchmark_models(samples, split, 2, alphas=(1.0,)).collect()}
    assert len(rows) == 8 and rows["persistence", 1].auc == 0.5 and rows["linear dynamics", 1].auc > 0.8


@pytest.fixture(scope="module")
def onsets(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        bad = k % 10 == 0
        last = rng.normal(size=3) + (4 if bad else 0)
        rows.append((1, k, int(bad), [rng.normal(size=3).tolist(), last.tolist()]))
    return spark.createDataFrame(rows, "capture_id long, window long, label int, context array<array<double>>").cache()


def test_anomaly_scores_tell_outliers(onsets):
    model = models.fit_mahalanobis(onsets)
    calm = np.array([r.context[-1] for r in onsets.filter("label = 0").collect()])
    z = (calm - calm.mean(0)) / (calm.std(0) + 1e-6)
    s = z.T @ z / len(z)
    mu = np.trace(s) / 3
    noise = np.mean([((np.outer(v, v) - s) ** 2).sum() for v in z]) / len(z) / 3
    spread = ((s - mu * np.eye(3)) ** 2).sum() / 3
    assert model["shrinkage"] == pytest.approx(min(noise, spread) / spread)
    scored = models.mahalanobis_score(onsets, model).collect()
    first = scored[0]
    v = (np.array(first.context[-1]) - model["mean"]) / model["scale"]
    assert first.score == pytest.approx(v @ model["precision"] @ v)
    forest = models.fit_isolation(onsets, 40)
    for rows in (scored, models.isolation_score(onsets, forest).collect()):
        bad, good = ([r.score for r in rows if r.label == y] for y in (1, 0))
        assert np.mean([b > g for b in bad for g in good]) > 0.95


def test_hazard_and_calibration(onsets):
    p = {"centre": [0.0] * 3, "scale": [1.0] * 3}
    features = models.hazard_features(onsets, p).first().features
    assert len(features) == 4 * 3 + 4
    scored = models.hazard_score(onsets, models.fit_hazard(onsets, p, rounds=8), p)
    rows = models.probability(scored, models.calibrate(scored)).orderBy("score").collect()
    assert all(0 <= r.probability <= 1 for r in rows) and all(a.probability <= b.probability + 1e-9 for a, b in zip(rows, rows[1:]))
    with pytest.raises(ValueError):
        models.fit_hazard(onsets.filter("label = 0"), p)


def test_shapley_values_of_a_linear_scorer(onsets):
    w = [0.5, -2.0, 1.0]
    score = lambda rows: rows.withColumn("score", sum(F.get(F.element_at("context", -1), F.lit(k)) * w[k] for k in range(3)))
    some, back = onsets.filter("window < 4"), onsets.filter("window BETWEEN 100 AND 120")
    got = attribution.feature_attribution(some, back, score).collect()
    mean = np.mean([r.context[-1] for r in back.collect()], axis=0)
    last = {r.window: np.array(r.context[-1]) for r in some.collect()}
    for r in got:
        assert r.contribution == pytest.approx(w[r.feature] * (last[r.window][r.feature] - mean[r.feature]))
    for k in last:
        mine = [r for r in got if r.window == k]
        assert sum(r.contribution for r in mine) == pytest.approx(mine[0].prediction - mine[0].base_value)
    drivers = attribution.top_drivers(attribution.feature_attribution(some, back, score), F.lit("syn_ratio__max"), 1).collect()
    assert len(drivers) == 4 and drivers[0].description == "peak SYN flag ratio"
    shares = attribution.temporal_attribution(some, back, score).collect()
    assert {r.lag for r in shares} == {0, 1} and all(r.share == (1.0 if r.lag == 0 else 0.0) for r in shares)
    assert attribution.key_windows(attribution.temporal_attribution(some, back, score), 1).count() == 4


def test_sampled_coalitions_keep_the_sum(onsets):
    masks, weights = attribution.coalitions(20, 64)
    assert len(masks) == len(weights) == 64 and not masks.all(axis=1).any() and masks.any(axis=1).all()


def test_false_alarm_bounds(spark):
    assert protocol.upper_rate(0, 100) == pytest.approx(1 - 0.025**0.01)
    assert protocol.upper_rate(5, 5) == 1.0
    assert protocol.upper_rate(3, 50) == pytest.approx(0.1655, abs=1e-3)
    for x, a, b in ((0.3, 2, 5), (0.9, 2, 5), (0.01, 4, 3)):
        n = a + b - 1
        assert protocol.incomplete_beta(x, a, b) == pytest.approx(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)))
    for k, n in ((10**7, 10**9), (1, 2), (999, 1000), (0, 10**9)):
        assert protocol.incomplete_beta(protocol.upper_rate(k, n), k + 1, n - k) == pytest.approx(0.975, abs=1e-5)
    row = protocol.false_alarm_bound(spark.createDataFrame([(0.1,), (0.9,)], "score double"), 0.5, 1.0).first()
    assert (row.windows, row.alerts, row.verified) == (2, 1, False)


def test_evaluation_of_a_forecaster(spark):
    rows = [(1, 0, 0.1, 0, None), (1, 0, 0.4, 0, None), (1, 1, 0.9, 3, 7), (1, 1, 0.3, 2, 7), (2, 1, 0.2, 1, 9)]
    scored = spark.createDataFrame(rows, "capture_id long, y int, score double, steps_to_onset int, onset long")
    got = protocol.evaluate_forecaster(scored, threshold=0.35).first()
    assert (got.n, got.n_pos, got.fpr, got.n_events, got.event_recall, got.median_lead_s) == (5, 3, 0.5, 2, 0.5, 90.0)
    assert got.tpr == pytest.approx(1 / 3) and got.threshold_source == "given" and not got.budget_resolvable
    assert protocol.evaluate_forecaster(scored).first().threshold == 0.4
    none = protocol.evaluate_forecaster(scored.filter("y = 1")).first()
    assert none.fpr is None and none.tpr == 0 and none.auc is None


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40, list(range(1000)), [1.0] * 500 + list(range(7))])
def test_quantiles_are_those_of_sorting(spark, values):
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", -1.0), ("b", None)], "g string, v double")
    got = {(r.g, r.q): r.v for r in profile.quantiles(rows, ["g"], "v", (0.0, 0.005, 0.5, 0.9, 1.0)).collect()}
    assert all(got["a", q] == pytest.approx(np.quantile(values, q)) for q in (0.0, 0.005, 0.5, 0.9, 1.0)) and got["b", 0.5] == -1.0


def brute_auc(rows):
    pos, neg = ([s for _, y, s in rows if y == v] for v in (1, 0))
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def test_curves_and_intervals(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(c), int(y), round(float(rng.normal() + y), 1)) for c, y in zip(rng.integers(0, 6, 400), rng.random(400) < 0.2)]
    scored = spark.createDataFrame(rows, "capture_id long, y int, score double").repartition(7)
    assert evaluation.roc_auc(scored).first().auc == pytest.approx(brute_auc(rows))
    by = sorted({s for _, _, s in rows}, reverse=True)
    ap = sum(sum(y for _, y, s in rows if s == v) * np.mean([y for _, y, s in rows if s >= v]) for v in by) / sum(y for _, y, _ in rows)
    assert evaluation.average_precision(scored).first().average_precision == pytest.approx(ap)
    got = evaluation.cluster_bootstrap(scored, 40, 3).first()
    times = evaluation._draws(40, 6, 3)
    aucs = [brute_auc([r for c in range(6) for _ in range(int(t[c])) for r in rows if r[0] == c]) for t in times]
    assert (got.draws, got.auc_low, got.auc_high) == (40, pytest.approx(np.percentile(aucs, 2.5)), pytest.approx(np.percentile(aucs, 97.5)))
    two = evaluation.cluster_bootstrap(scored.filter("capture_id < 2"), 40).first()
    assert (two.draws, two.auc_low, two.auc_high) == (0, None, None)
    none = evaluation.cluster_bootstrap(scored.limit(0), 5, threshold=0.5).first()
    assert none.draws == 0 and none.event_recall_high is None


def test_intervals_of_rates_and_events(spark):
    rows = [(c, y, s, o) for c in range(4) for y, s, o in ((1, 0.9, 5), (1, 0.1 + c / 5, 5), (1, c / 4, 9), (0, 0.2, None), (0, 0.6, None))]
    scored = spark.createDataFrame(rows, "capture_id long, y int, score double, onset long")
    got = evaluation.cluster_bootstrap(scored, 30, threshold=0.5).first()
    tprs, recalls = [], []
    for t in evaluation._draws(30, 4, 0):
        picked = [(k, *r) for c in range(4) for k in range(int(t[c])) for r in rows if r[0] == c]
        tprs.append(np.mean([s >= 0.5 for _, _, y, s, _ in picked if y]))
        events = {}
        for k, c, _, s, o in picked:
            if o is not None:
                events[k, c, o] = events.get((k, c, o), False) or s >= 0.5
        recalls.append(np.mean(list(events.values())))
    assert (got.tpr_low, got.tpr_high) == tuple(pytest.approx(x) for x in np.percentile(tprs, [2.5, 97.5]))
    assert (got.event_recall_low, got.event_recall_high) == tuple(pytest.approx(x) for x in np.percentile(recalls, [2.5, 97.5]))


def test_attribution_within_batches_equals_that_of_rows(spark, onsets):
    w = np.array([0.5, -2.0, 1.0])
    rows = lambda r: r.withColumn("score", 1 / (1 + F.exp(-sum(F.get(F.element_at("context", -1), F.lit(k)) * float(w[k]) for k in range(3)))))
    matrix = lambda x: 1 / (1 + np.exp(-(x[:, -1] @ w)))
    some, back = onsets.filter("window < 4"), onsets.filter("window BETWEEN 100 AND 120")
    for link in ("identity", "logit"):
        key = lambda r: (r.capture_id, r.window, r.feature)
        a = sorted(attribution.feature_attribution(some, back, rows, link).collect(), key=key)
        b = sorted(attribution.matrix_attribution(some, back, matrix, link).collect(), key=key)
        assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 3
        assert np.allclose([[r.contribution, r.base_value, r.prediction] for r in a], [[r.contribution, r.base_value, r.prediction] for r in b])
    assert attribution.matrix_attribution(some.limit(0), back, matrix).count() == 0
    one = spark.createDataFrame([(1, 2, [[3.0], [5.0]])], "capture_id long, window long, context array<array<double>>")
    got = attribution.matrix_attribution(one, one.withColumn("context", F.array(F.array(F.lit(0.0)), F.array(F.lit(1.0)))), lambda x: x[:, -1, 0] * 2).first()
    assert (got.contribution, got.base_value, got.prediction) == (8.0, 2.0, 10.0)


def test_attribution_of_many_features(spark):
    rng = np.random.default_rng(4)
    f = 103
    w = rng.normal(size=f)
    rows = [(1, k, rng.normal(size=(3, f)).tolist()) for k in range(6)]
    table = spark.createDataFrame(rows, "capture_id long, window long, context array<array<double>>").repartition(2)
    got = attribution.matrix_attribution(table.filter("window < 2"), table.filter("window >= 2"), lambda x: x[:, 0] @ w).collect()
    mean = np.mean([np.array(c)[0] for _, k, c in rows if k >= 2], axis=0)
    assert len(got) == 2 * f
    for r in got:
        assert r.contribution == pytest.approx(w[r.feature] * (rows[r.window][2][0][r.feature] - mean[r.feature]))


def test_every_isolation_tree_has_its_rows(spark):
    rows = [(1, k, [[float(k % 977), 1.0]] if k % 2 else [[0.0, 0.0]], 0) for k in range(4000)]
    table = spark.createDataFrame(rows, "capture_id long, window long, context array<array<double>>, label int").repartition(5)
    forest = models.fit_isolation(table, 40).collect()
    assert sorted(r.tree for r in forest) == list(range(40)) and {r.n for r in forest} == {256}
    assert {r.n for r in models.fit_isolation(table.limit(100), 3).collect()} == {100}
    scored = models.isolation_score(table, models.fit_isolation(table, 40)).collect()
    common, rare = ([r.score for r in scored if (r.context[0][1] == 0) == same] for same in (True, False))
    assert max(common) < min(rare)


def test_tables_of_features_are_kept(spark, tmp_path):
    long = spark.createDataFrame([(1, w, f, float(w * f)) for w in range(9) for f in range(3)], "capture_id long, window long, feature int, value double")
    fitted = profile.fit_profile(long)
    models.save_table(fitted, str(tmp_path / "p"))
    again = models.load_table(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, again.select(*fitted.columns).collect())) == sorted(map(tuple, fitted.collect()))


def test_quantiles_see_one_sketch(spark, tmp_path, monkeypatch):
    """A sketch of many pieces comes out otherwise each time that it is made."""
    values = np.random.default_rng(3).normal(size=2000)
    rows = [(0, k, f, float(x) * (f + 1)) for f in range(3) for k, x in enumerate(values)]
    spark.createDataFrame(rows, "capture_id long, window long, feature int, value double").repartition(8).write.parquet(str(tmp_path / "long"))
    sketch, shaken = F.percentile_approx, F.udf(lambda cuts: sorted(c + random.SystemRandom().uniform(-0.3, 0.3) for c in cuts), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: shaken(sketch(*a)))
    got = profile.fit_profile(spark.read.parquet(str(tmp_path / "long"))).collect()
    assert len(got) == 3
    for r in got:
        v = values * (r.feature + 1)
        centre = np.median(v)
        scale = max(1.4826 * np.median(abs(v - centre)), 0.5 * v.std(), 1e-3 + 0.01 * abs(centre))
        assert (r.centre, r.scale) == pytest.approx((centre, scale), abs=1e-12)
