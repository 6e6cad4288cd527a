"""Queries of the reports over scored windows, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, reports
from ..sources.shared import materialised
from .registry import _LONG, _SC, _long, _scores, query, rounded


@query(
    _SC + """m AS (SELECT t % 5 + 1 AS step, count(*) AS n, count(*) FILTER (score >= 0.6 AND y = 1) AS tp, count(*) FILTER (score >= 0.6 AND y = 0) AS fp, count(*) FILTER (score < 0.6 AND y = 0) AS tn, count(*) FILTER (score < 0.6 AND y = 1) AS fn, avg(CASE WHEN stage_true = stage_pred THEN 1.0 ELSE 0.0 END) AS acc FROM s GROUP BY 1),
    r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM m)
    SELECT step, n, tp, fp, tn, fn, round(acc, 6) AS stage_accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM r""",
    "scores_v",
)
def horizon_metrics(spark, sf_dir):
    return rounded(reports.horizon_metrics(_scores(spark, sf_dir).withColumn("step", F.col("t") % 5 + 1), 0.6))


@query(
    _SC + """c AS (SELECT DISTINCT score AS cut FROM s WHERE y = 0), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1), a AS (SELECT score AS cut, n, sum(n) OVER q - n AS fp, sum(p) OVER q - p AS tp, sum(n) OVER () AS nn, sum(p) OVER () AS np FROM g WINDOW q AS (ORDER BY score DESC)),
    b AS (SELECT unnest([0.005, 0.01, 0.02, 0.05]::DOUBLE[]) AS budget), l AS (SELECT budget, min(cut) AS cut FROM a, b WHERE n > 0 AND fp <= floor(nn * budget) GROUP BY 1)
    SELECT budget, round(l.cut, 6) AS cut, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr, round(fp / nn * 2880, 6) AS false_alerts_per_day FROM l JOIN a ON a.cut = l.cut""",
    "scores_v",
)
def budget_table(spark, sf_dir):
    return rounded(reports.budget_table(_scores(spark, sf_dir)))


@query(
    _SC + """v AS (SELECT t % 5 + 1 AS step, round(score, 4) AS threshold, sum(y) AS p, sum(1 - y) AS n FROM s WHERE capture_id < 3 GROUP BY 1, 2), r AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY step) AS np FROM v WINDOW d AS (PARTITION BY step ORDER BY threshold DESC)),
    b AS (SELECT step, arg_max(threshold, (CASE WHEN tp + fp + np = 0 THEN 0.0 ELSE 2 * tp / (tp + fp + np) END, -threshold)) AS threshold FROM r GROUP BY 1),
    m AS (SELECT s.t % 5 + 1 AS step, any_value(threshold) AS threshold, count(*) AS n, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn FROM s JOIN b ON b.step = s.t % 5 + 1 WHERE capture_id >= 3 GROUP BY 1)
    SELECT step, round(threshold, 6) AS threshold, n, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM m""",
    "scores_v",
)
def horizon_validated(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("step", F.col("t") % 5 + 1)
    chosen = materialised(reports.horizon_thresholds(s.filter("capture_id < 3")), "thresholds")
    return rounded(reports.horizon_metrics(s.filter("capture_id >= 3"), chosen).join(chosen, "step").select("step", "threshold", "n", "tp", "fp", "fn", "f1"))


@query(_SC + "g AS (SELECT stage_true AS true_stage, stage_pred AS predicted_stage, count(*) AS windows, count(*) FILTER (score >= 0.6) AS alerts FROM s WHERE stage_true IN (0, 3) GROUP BY 1, 2) SELECT *, round(alerts / windows, 6) AS alert_share FROM g", "scores_v")
def holdout_names(spark, sf_dir):
    return rounded(reports.holdout_names(_scores(spark, sf_dir), 0.6, 3))


@query(
    _LONG + """f AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM l GROUP BY 1),
    z AS (SELECT l.*, (value - m) / s AS z, value < lo OR value > hi AS far FROM l JOIN f USING (feature)), w AS (SELECT capture_id, win, sum(CAST(far AS INTEGER)) AS n FROM z GROUP BY 1, 2),
    a AS (SELECT capture_id, round(quantile_cont(abs(z), 0.5), 6) AS median_abs_z FROM z GROUP BY 1), b AS (SELECT capture_id, round(avg(CASE WHEN n >= 14 THEN 1.0 ELSE 0.0 END), 6) AS share_outside, count(*) FILTER (win % 3 = 0) AS confirmed FROM w GROUP BY 1) SELECT * FROM a JOIN b USING (capture_id)"""
)
def capture_standing(spark, sf_dir):
    long = materialised(_long(spark, sf_dir), "long")
    fit = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    edges = profile.quantiles(long, ["feature"], "value", (0.1, 0.9)).groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    z = materialised(long.join(fit, "feature").withColumn("z", (F.col("value") - F.col("m")) / F.col("s")), "z")
    levels = long.select("capture_id", "window").distinct().withColumn("level", F.when(F.col("window") % 3 == 0, "CONFIRMED").otherwise("CLEAR"))
    return rounded(reports.capture_standing(z, levels, edges, 14))


@query(_SC + "g AS (SELECT capture_id, count(*) AS n_windows, count(*) FILTER (score >= 0.9) AS alerts FROM s WHERE y = 0 GROUP BY 1) SELECT *, round(alerts / (n_windows * 30.0::DOUBLE / 3600), 6) AS alerts_per_hour FROM g", "scores_v")
def background_false_alarms(spark, sf_dir):
    return rounded(reports.background_false_alarms(_scores(spark, sf_dir).filter("y = 0"), 0.9))


@query(
    _SC + """b AS (SELECT score, count(*) AS c FROM s WHERE stage_true = 0 GROUP BY 1), p AS (SELECT stage_true AS stage, score, count(*) AS c FROM s WHERE stage_true > 0 GROUP BY 1, 2),
    u AS (SELECT stage, sum(p.c * b.c * CASE WHEN p.score > b.score THEN 1.0 WHEN p.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE) / sum(p.c * b.c) AS auc FROM p, b GROUP BY 1)
    SELECT stage_true AS stage, count(*) AS n, round(avg(CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS detection_rate, round(avg(score), 6) AS mean_score, round(any_value(auc), 6) AS auc, stage_true <> 3 AS trained_on FROM s JOIN u ON u.stage = s.stage_true GROUP BY stage_true""",
    "scores_v",
)
def holdout_study(spark, sf_dir):
    return rounded(reports.holdout_study(_scores(spark, sf_dir), 0.6, 3, 7))


@query(
    _SC + """k AS (SELECT capture_id, stage_pred, row_number() OVER (PARTITION BY capture_id ORDER BY count(*) DESC, stage_pred) AS place FROM s GROUP BY 1, 2)
    SELECT s.capture_id, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.9), 6) AS p90, round(max(score), 6) AS peak, count(*) FILTER (score >= 0.9) AS over, any_value(a.stage_pred) AS stage_1, any_value(b.stage_pred) AS stage_2
    FROM s LEFT JOIN k a ON a.capture_id = s.capture_id AND a.place = 1 LEFT JOIN k b ON b.capture_id = s.capture_id AND b.place = 2 GROUP BY 1""",
    "scores_v",
)
def capture_risk_profile(spark, sf_dir):
    return rounded(reports.capture_risk_profile(_scores(spark, sf_dir), 0.9))


@query(_SC + "p AS (SELECT capture_id, t, y, lag(y) OVER (PARTITION BY capture_id ORDER BY t) AS back FROM s) SELECT capture_id, t, y, CAST(back AS DOUBLE) AS score FROM p WHERE back IS NOT NULL", "scores_v")
def label_persistence_score(spark, sf_dir):
    return reports.label_persistence_score(_scores(spark, sf_dir)).select("capture_id", "t", "y", "score")


@query(
    _LONG + """m AS (SELECT feature, avg(value) AS m, stddev_pop(value) + 1e-6 AS s FROM l WHERE capture_id = 0 GROUP BY 1),
    c AS (SELECT capture_id, win, list((value - m) / s) OVER (PARTITION BY capture_id, l.feature ORDER BY win ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS x FROM l JOIN m USING (feature)),
    e AS (SELECT capture_id, win, list_reduce(list_prepend(0.0::DOUBLE, x), lambda a, v: 0.5::DOUBLE * v + 0.5::DOUBLE * a) AS score FROM c WHERE len(x) = 16)
    SELECT capture_id, win AS "window", round(max(score), 6) AS score FROM e GROUP BY 1, 2"""
)
def cusum_score(spark, sf_dir):
    long = _long(spark, sf_dir)
    return rounded(reports.cusum_score(long, long.filter("capture_id = 0")))
