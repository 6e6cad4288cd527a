"""Whole evaluations of forecasters, bounds on false alarms, and studies that run several arms over one split."""

from __future__ import annotations

from math import exp, lgamma, log, log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STATE_FEATURES, WINDOW_US
from ..sources.shared import materialised
from . import evaluation, models, studies, windows

FPR_BUDGETS = (0.005, 0.01, 0.02, 0.05)


def evaluate_forecaster(scored: DataFrame, threshold: float | None = None, validation: DataFrame | None = None, budget: float = 0.01, draws: int = 0) -> DataFrame:
    """One row with everything about a forecaster's scores on quiet samples (capture_id, y, score, steps_to_onset, onset).

    The threshold is the given one, else the smallest that keeps the false-positive rate of
    ``validation`` (y, score) within ``budget``, else that of ``scored`` itself, named optimistic.
    A threshold from data is one that scores must exceed. Rates without samples are null.
    """
    source, strict = "given", False
    counts = materialised(evaluation.running_counts(scored), "counts")
    cut = lambda b: F.coalesce(F.min(F.when((F.col("n") > 0) & (F.col("fp") - F.col("n") <= F.floor(F.col("nn") * b)), F.col("score"))), F.lit(float("inf")))
    if threshold is None:
        source, strict = ("validation", True) if validation is not None else ("test (optimistic)", True)
        threshold = (evaluation.running_counts(validation) if validation is not None else counts).agg(cut(budget)).first()[0]
    alert = (F.col("score") > threshold) if strict else (F.col("score") >= threshold)
    of = lambda value, cond: F.sum(F.when(cond, F.col(value)).otherwise(0))
    rate = lambda a, b: F.when(b > 0, a / b)
    sums = counts.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), of("p", alert).alias("_hits"), of("n", alert).alias("_false"),
        F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("_u"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"), *(cut(b).alias(f"_cut{k}") for k, b in enumerate(FPR_BUDGETS)),
    )
    pos, neg = F.col("n_pos"), F.col("n_neg")
    row = sums.select((pos + neg).alias("n"), "n_pos", "n_neg", rate(pos, pos + neg).alias("prevalence"), rate(F.col("_false"), neg).alias("fpr"), rate(F.col("_hits"), pos).alias("tpr"), F.when((pos > 0) & (neg > 0), F.col("_u") / (pos * neg)).alias("auc"), rate(F.col("_ap"), pos).alias("average_precision"), *(f"_cut{k}" for k in range(len(FPR_BUDGETS))))
    events = scored.filter("onset IS NOT NULL").groupBy("capture_id", "onset").agg((F.max(F.when(alert, F.col("steps_to_onset"))) * (WINDOW_US / 1e6)).alias("lead"))
    events = events.agg(F.count("*").alias("n_events"), rate(F.count("lead"), F.count("*")).alias("event_recall"), F.percentile("lead", 0.5).alias("median_lead_s"))
    row = row.crossJoin(F.broadcast(events))  # one row each
    row = row.withColumns({"threshold": F.lit(float(threshold)), "threshold_source": F.lit(source), "fpr_budget": F.lit(budget), "chance_ap": F.col("prevalence"), "false_alerts_per_day": F.col("fpr") * (86_400_000_000 / WINDOW_US), "fpr_resolution": F.when(F.col("n_neg") > 0, 3.0 / F.col("n_neg"))})
    row = row.withColumn("budget_resolvable", F.coalesce(F.lit(budget) >= F.col("fpr_resolution"), F.lit(False)))
    hit = lambda p: F.col("tpr") * p
    row = row.withColumns({f"ppv_{k}": F.when(hit(p) + F.col("fpr") * (1 - p) > 0, hit(p) / (hit(p) + F.col("fpr") * (1 - p))) for k, p in enumerate(studies.PREVALENCES, 2)})
    names = [f"tpr_at_{b:g}".replace(".", "_") for b in FPR_BUDGETS]
    above = counts.crossJoin(F.broadcast(row.select(*(f"_cut{k}" for k in range(len(names)))))).agg(*(of("p", F.col("score") > F.col(f"_cut{k}")).alias(c) for k, c in enumerate(names)))  # one row beside the counts
    row = row.drop(*(f"_cut{k}" for k in range(len(names)))).crossJoin(F.broadcast(above))
    row = row.withColumns({c: rate(F.col(c), F.col("n_pos")) for c in names})
    return row.crossJoin(F.broadcast(evaluation.cluster_bootstrap(scored, draws, threshold=threshold, strict=strict))) if draws else row


def _log_beta(a: float, b: float) -> float:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast: about the square root of a and b in steps."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    value, c, d, k = 1.0, 1.0, 0.0, 1
    while True:  # 1 + t1 / (1 + t2 / (1 + ...)) from the front
        m = k // 2
        t = m * (b - m) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))
        d = 1 / ((1 + t * d) or 1e-300)
        c = (1 + t / c) or 1e-300
        value *= c * d
        k += 1
        if abs(c * d - 1) < 1e-15 or k > 1_000_000:
            return exp(a * log(x) + b * log1p(-x) - _log_beta(a, b)) / a / value


def upper_rate(k: int, n: int, level: float = 0.975) -> float:
    """Clopper and Pearson's upper limit of a rate with ``k`` of ``n``: the ``level`` quantile of the beta distribution of k + 1 and n - k, by Newton's steps within a bracket."""
    if k >= n:
        return 1.0
    a, b = k + 1, n - k
    low, high = k / n, 1.0
    p = min((k + 1) / (n + 1) + 2 * (((k + 1) * (n - k)) ** 0.5 / (n + 1) / (n + 2) ** 0.5), (low + 1) / 2)
    for _ in range(200):
        off = incomplete_beta(p, a, b) - level
        low, high = (p, high) if off < 0 else (low, p)
        slope = exp((a - 1) * log(p) + (b - 1) * log1p(-p) - _log_beta(a, b))
        step = p - off / slope if slope > 0 else low
        following = step if low < step < high else (low + high) / 2
        if abs(following - p) <= 1e-13 * p:
            return following
        p = following
    return p


def false_alarm_bound(negatives: DataFrame, threshold: float, budget_per_hour: float, window_us: int = WINDOW_US) -> DataFrame:
    """Alerts among benign windows (score), the upper limit of alerts an hour that they support, and whether it is within the budget."""
    n, k = negatives.agg(F.count("*"), F.coalesce(F.sum((F.col("score") >= threshold).cast("long")), F.lit(0))).first()
    per_hour = upper_rate(k, n) * 3_600_000_000 / window_us if n else float("inf")
    return negatives.sparkSession.createDataFrame([(n, k, per_hour, per_hour <= budget_per_hour)], "windows long, alerts long, upper_per_hour double, verified boolean")


def _one_step(samples: DataFrame, model, heads) -> dict:
    """Next-state error in standardised units, and AUC and F1 of the infiltration head on the next window."""
    scored = models.predict_heads(models.predict_next(samples, model), heads)
    scale = F.array(*map(F.lit, model.scale.tolist()))
    err = F.aggregate(F.transform(F.arrays_zip(F.col("forecast").alias("a"), F.col("target_state").alias("b"), scale.alias("s")), lambda t: F.pow((t["a"] - t["b"]) / t["s"], F.lit(2.0))), F.lit(0.0), lambda a, x: a + x) / F.size("target_state")
    rows = scored.filter(F.get("target_mask", F.lit(0))).select(F.get("target_infil", F.lit(0)).alias("y"), F.col("infiltration").alias("score"))
    auc, at = evaluation.roc_auc(rows).first(), evaluation.binary_metrics(rows, 0.5).first()
    return {"mse": scored.agg(F.avg(err)).first()[0], "auc": auc.auc if auc else None, "f1": at.f1, "fpr": at.fpr, "n": scored.count()}


ARM = "arm string, features int, context int, n long, mse double, auc double, f1 double, fpr double"


def ablation(states: DataFrame, labels: DataFrame, split: DataFrame, length: int = 16, horizon: int = 5, contexts: tuple[int, ...] = (1, 4), alphas: tuple = models.ALPHAS, strengths: tuple = (0.03,)) -> DataFrame:
    """The same captures and rule for flow features, packet features, both, and shorter contexts; ``split`` has capture_id, split. One row an arm."""
    levels = windows.feature_levels()
    arms = [("flow", levels["flow"], length), ("packet", levels["packet"], length), ("both", list(STATE_FEATURES), length), *((f"last {n}", list(STATE_FEATURES), n) for n in contexts)]
    rows = []
    for name, features, n in arms:
        features = [c for c in features if c in states.columns]
        every = models.sequence_samples(states, labels, features, length, horizon).join(split, "capture_id")
        every = every.withColumn("context", F.slice("context", -n, n))
        part = {s: every.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
        model, heads = models.fit_dynamics(part["train"], part["val"], alphas), models.fit_heads(part["train"], part["val"], strengths)
        got = _one_step(part["test"], model, heads)
        rows.append((name, len(features), n, got["n"], got["mse"], got["auc"], got["f1"], got["fpr"]))
    return states.sparkSession.createDataFrame(rows, ARM)


def benchmark_models(samples: DataFrame, split: DataFrame, horizon: int = 5, alphas: tuple = models.ALPHAS, strengths: tuple = (0.03,), c: float = 0.5) -> DataFrame:
    """Persistence, two logistic baselines and linear dynamics over one split: AUC and F1 of infiltration at every step. A row per model and step."""
    every = samples.join(split, "capture_id")
    part = {s: every.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    test = part["test"]
    dynamics, heads = models.fit_dynamics(part["train"], part["val"], alphas), models.fit_heads(part["train"], part["val"], strengths)
    rolled = models.rollout(test, horizon, lambda r: models.predict_next(r, dynamics, clamp=True), lambda r: models.predict_heads(r, heads))
    scored = {"linear dynamics": rolled.select("capture_id", "window", "step", F.col("infiltration").alias("score"))}
    steps = lambda rows, p: rows.select("capture_id", "window", F.posexplode(F.array(*(p(k) for k in range(1, horizon + 1)))).alias("step", "score")).withColumn("step", F.col("step") + 1)
    scored["persistence"] = steps(test, lambda k: F.lit(0.0))
    for mode in ("static", "context"):
        fitted = models.logistic_baseline(part["train"], horizon, mode, c)
        scored[f"logistic ({mode})"] = steps(models.baseline_scores(test, fitted, mode), lambda k: F.col(f"p{k}"))
    truth = test.select("capture_id", "window", F.posexplode("target_infil").alias("step", "y"), "target_mask").filter(F.get("target_mask", F.col("step"))).select("capture_id", "window", (F.col("step") + 1).alias("step"), "y")
    out = None
    for name, rows in scored.items():
        joined = truth.join(rows, ["capture_id", "window", "step"]).withColumn("hit", F.col("score") >= 0.5)
        auc = evaluation.roc_auc(joined, "step")
        n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
        y = F.col("y") == 1
        counts = joined.groupBy("step").agg(n(F.col("hit") & y).alias("tp"), n(F.col("hit") & ~y).alias("fp"), n(~F.col("hit") & y).alias("fn"), F.count("*").alias("n"))
        f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
        rows = counts.join(auc, "step").select(F.lit(name).alias("model"), "step", "n", "auc", f1.alias("f1"))
        out = rows if out is None else out.unionByName(rows)
    return out
