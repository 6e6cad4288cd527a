"""Reports over scored windows: horizons, budgets, background alarms, held-out stages, risk by capture; simple detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import running_counts
from .profile import quantiles
from .samples import ewma

BUDGETS = (0.005, 0.01, 0.02, 0.05)


def _div(a, b) -> F.Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def horizon_thresholds(validation: DataFrame) -> DataFrame:
    """(step, threshold): of each forecast step's scores to 4 digits, the first with the best F1 on ``validation`` (step, y, score). A step has 10,001 candidates at most where scores are chances."""
    g = validation.groupBy("step", F.round("score", 4).alias("threshold")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    down, whole = Window.partitionBy("step").orderBy(F.desc("threshold")), Window.partitionBy("step")
    tp, fp = F.sum("p").over(down), F.sum("n").over(down)
    f1 = _div(2 * tp, tp + fp + F.sum("p").over(whole))
    return g.select("step", "threshold", f1.alias("f1")).groupBy("step").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"))


def horizon_metrics(scored: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """Per forecast step: precision, recall, F1, false-positive rate and the accuracy of the stage; ``scored`` has step, y, score, stage_true, stage_pred. ``threshold`` is a number, or (step, threshold) from validation."""
    if isinstance(threshold, DataFrame):
        scored, threshold = scored.join(F.broadcast(threshold), "step"), F.col("threshold")  # a row a step
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    m = scored.groupBy("step").agg(
        F.count("*").alias("n"), n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & ~pos).alias("tn"), n(~hit & pos).alias("fn"),
        F.avg((F.col("stage_true") == F.col("stage_pred")).cast("double")).alias("stage_accuracy"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    m = m.select("*", _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), _div(fp, fp + tn).alias("fpr"))
    return m.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def budget_table(scored: DataFrame, budgets: tuple[float, ...] = BUDGETS, windows_per_day: int = 2880) -> DataFrame:
    """For each false-positive budget: the cut that scores must exceed, the rates there and false alerts a day.

    Rows are counted by score before they are ordered.
    """
    g = running_counts(scored).select("score", (F.col("fp") - F.col("n")).alias("fp"), (F.col("tp") - F.col("p")).alias("tp"), "n", "nn", "np")
    # only scores that a negative has are cuts
    g = g.filter("n > 0").withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).filter(F.col("fp") <= F.floor(F.col("nn") * F.col("budget")))
    low = g.groupBy("budget").agg(F.min_by(F.struct("score", "fp", "tp", "nn", "np"), "score").alias("at"))
    fpr = _div(F.col("at.fp"), F.col("at.nn"))
    return low.select("budget", F.col("at.score").alias("cut"), fpr.alias("fpr"), _div(F.col("at.tp"), F.col("at.np")).alias("tpr"), (fpr * windows_per_day).alias("false_alerts_per_day"))


def background_false_alarms(scored: DataFrame, threshold: float, window_s: float = 30.0) -> DataFrame:
    """Alerts of captures known to be benign, per capture and hour."""
    g = scored.groupBy("capture_id").agg(F.count("*").alias("n_windows"), F.sum((F.col("score") >= threshold).cast("int")).alias("alerts"))
    return g.withColumn("alerts_per_hour", F.col("alerts") / (F.col("n_windows") * window_s / 3600))


def holdout_study(scored: DataFrame, threshold: float, held_out: int, n_stages: int, benign: int = 0) -> DataFrame:
    """Per stage: windows, detection rate, mean score, area under the curve against benign windows, and whether it was trained on.

    Benign windows are counted by score before each of the ``n_stages`` takes its copy of the counts.
    """
    stage = F.col("stage_true")
    g = scored.filter(stage != benign).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.avg((F.col("score") >= threshold).cast("double")).alias("detection_rate"), F.avg("score").alias("mean_score"))
    counts = scored.groupBy(stage.alias("stage"), "score").agg(F.count("*").alias("c"))
    others = F.array(*(F.lit(k) for k in range(n_stages) if k != benign))
    counts = counts.select(F.explode(F.when(F.col("stage") == benign, others.cast("array<bigint>")).otherwise(F.array(F.col("stage").cast("long")))).alias("stage"), "score", F.when(F.col("stage") == benign, 0).otherwise(F.col("c")).alias("p"), F.when(F.col("stage") == benign, F.col("c")).otherwise(0).alias("n"))
    counts = counts.groupBy("stage", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    tp = F.sum("p").over(Window.partitionBy("stage").orderBy(F.desc("score")))
    u = counts.withColumn("tp", tp).groupBy("stage").agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))
    return g.join(u, "stage").withColumn("trained_on", F.col("stage") != held_out)


def holdout_names(scored: DataFrame, threshold: float, held_out: int, benign: int = 0) -> DataFrame:
    """What windows of the held-out stage are called, and benign ones that alert: (true_stage, predicted_stage, windows, alerts, share of alerts)."""
    rows = scored.filter(F.col("stage_true").isin(held_out, benign)).groupBy(F.col("stage_true").alias("true_stage"), F.col("stage_pred").alias("predicted_stage"))
    g = rows.agg(F.count("*").alias("windows"), F.sum((F.col("score") >= threshold).cast("long")).alias("alerts"))
    return g.withColumn("alert_share", F.col("alerts") / F.col("windows"))


def capture_standing(z: DataFrame, levels: DataFrame, low: DataFrame, least: int = 20) -> DataFrame:
    """Per capture: the median of |z| over its windows and features, the share of windows with ``least`` features or more outside the range, and CONFIRMED windows.

    ``z`` has capture_id, window, feature, value, z; ``levels`` capture_id, window, level; ``low`` feature, lo, hi.
    """
    outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    per = z.join(F.broadcast(low), "feature").groupBy("capture_id", "window").agg(F.sum(outside.cast("int")).alias("outside"))  # a row a feature
    share = per.groupBy("capture_id").agg(F.avg((F.col("outside") >= least).cast("double")).alias("share_outside"))
    middle = quantiles(z.withColumn("far", F.abs("z")), ["capture_id"], "far", (0.5,)).select("capture_id", F.col("v").alias("median_abs_z"))
    confirmed = levels.groupBy("capture_id").agg(F.sum((F.col("level") == "CONFIRMED").cast("long")).alias("confirmed"))
    return middle.join(share, "capture_id").join(confirmed, "capture_id", "left").fillna(0, ["confirmed"])


def capture_risk_profile(scored: DataFrame, cut: float) -> DataFrame:
    """Per capture: mean, 90th percentile and maximum of the score, windows at or over the cut, and the two commonest stages."""
    g = scored.groupBy("capture_id").agg(F.avg("score").alias("mean"), F.percentile("score", 0.9).alias("p90"), F.max("score").alias("peak"), F.sum((F.col("score") >= cut).cast("int")).alias("over"))
    kinds = scored.groupBy("capture_id", "stage_pred").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("c"), "stage_pred"))
    top = kinds.withColumn("place", place).filter("place <= 2").groupBy("capture_id").agg(F.max(F.when(F.col("place") == 1, F.col("stage_pred"))).alias("stage_1"), F.max(F.when(F.col("place") == 2, F.col("stage_pred"))).alias("stage_2"))
    return g.join(top, "capture_id")


def label_persistence_score(scored: DataFrame) -> DataFrame:
    """The label of the window before as the score; a capture's first window has none."""
    back = F.lag("y").over(Window.partitionBy("capture_id").orderBy("t"))
    return scored.withColumn("score", back.cast("double")).filter("score IS NOT NULL")


def cusum_score(long: DataFrame, benign: DataFrame, length: int = 16) -> DataFrame:
    """Per window: the largest exponential average, over features, of the context's distance from benign values in deviations.

    Both tables have capture_id, window, feature, value; windows without a whole context have no row.
    """
    calm = benign.groupBy("feature").agg(F.avg("value").alias("_m"), (F.stddev_pop("value") + 1e-6).alias("_s"))
    z = long.join(F.broadcast(calm), "feature")  # one row a feature
    order = Window.partitionBy("capture_id", "feature").orderBy("window")
    z = z.withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s")).withColumn("context", F.collect_list("z").over(order.rowsBetween(-(length - 1), 0)))
    z = z.filter(F.size("context") == length).withColumn("score", ewma(F.col("context")))
    return z.groupBy("capture_id", "window").agg(F.max("score").alias("score"))
