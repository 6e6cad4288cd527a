"""Stage labels, graded rules, verdicts and alert episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clean_label, rule_support, stage_from_label
from ..schema import OUT_OF_SCOPE, RULE_TEXTS, RULES, STAGES, STATE_FEATURES, WINDOW_US

HIGH, FLOOR, LOW, STRONG, WEAK, RETAIN = 0.70, 0.55, 0.40, 0.35, 0.18, 0.55
BIN_US = 60_000_000


def _index(stage) -> F.Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage).cast("int") - 1


def stage_at(points: DataFrame, timeline: DataFrame) -> DataFrame:
    """``points`` (capture_id, t_us, ...) with the stage of the closed interval that covers it; the highest rank wins, of equals the earlier interval; Impact ranks lowest.

    Intervals are spread over bins of BIN_US, so that the join is an equality on capture and bin.
    """
    rank = F.when(F.col("stage") == "Impact", 0).otherwise(_index(F.col("stage")))
    spread = timeline.select(F.col("capture_id").alias("_c"), "start_us", "end_us", "stage", rank.alias("_rank"), F.explode(F.sequence(F.expr(f"start_us div {BIN_US}"), F.expr(f"end_us div {BIN_US}"))).alias("_bin"))
    ids = [c for c in points.columns]
    hit = (F.col("capture_id") == F.col("_c")) & (F.expr(f"t_us div {BIN_US}") == F.col("_bin")) & F.col("t_us").between(F.col("start_us"), F.col("end_us"))
    joined = points.join(spread, hit, "left").groupBy(*ids).agg(F.max_by("stage", F.struct("_rank", -F.col("start_us"), -F.col("end_us"))).alias("stage"))
    return joined.withColumn("stage", F.coalesce("stage", F.lit("Benign")))


def label_windows_timeline(windows: DataFrame, timeline: DataFrame, stride_us: int = WINDOW_US) -> DataFrame:
    """Most severe stage at the start, middle and last microsecond of each window; ``windows`` has capture_id, window, t0."""
    start = F.col("t0") + F.col("window") * stride_us
    probes = windows.select("capture_id", "window", F.explode(F.array(start, start + stride_us // 2, start + stride_us - 1)).alias("t_us"))
    return stage_at(probes, timeline).groupBy("capture_id", "window").agg(F.max(_index(F.col("stage"))).alias("stage"))


def label_windows_flows(flows: DataFrame) -> DataFrame:
    """Most severe in-scope stage of the window's flows; unsure windows are masked. ``flows`` has capture_id, window, label."""
    stage = stage_from_label(clean_label(F.col("label")))
    g = flows.select("capture_id", "window", stage.alias("s")).groupBy("capture_id", "window")
    g = g.agg(F.max(F.when(F.col("s") != OUT_OF_SCOPE, _index(F.col("s")))).alias("top"), F.sum((F.col("s") == OUT_OF_SCOPE).cast("int")).alias("outside"))
    return g.select("capture_id", "window", F.coalesce("top", F.lit(0)).alias("stage"), (F.col("top").isNotNull() & ~((F.col("top") == 0) & (F.col("outside") > 0))).alias("valid"))


def label_source(labels: DataFrame, timeline: bool, dataset_labels: bool) -> DataFrame:
    """Labels with where they come from; without a source no window counts as labelled."""
    source = "ground-truth timeline" if timeline else "dataset labels" if dataset_labels else "unlabelled"
    return labels.withColumn("label_source", F.lit(source)).withColumn("valid", F.col("valid") if source != "unlabelled" else F.lit(False))


RULE_STAGES = tuple(dict.fromkeys(r[0] for r in RULES))


def _value(states: DataFrame, feature: str) -> Column | None:
    """A feature as a finite number or null; None where the table lacks it."""
    if feature not in states.columns:
        return None
    c = F.col(feature).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _fires(value: Column, op: str, threshold: float) -> Column:
    return F.coalesce(value > threshold if op == ">" else value < threshold, F.lit(False))


def stage_scores(states: DataFrame, graded: bool = True) -> dict[str, Column]:
    """Score of each stage as an expression over a window's features: the share of the stage's rule weight that they support."""
    scores = {}
    for stage in RULE_STAGES:
        rules = [r for r in RULES if r[0] == stage]
        got = F.lit(0.0)
        for _, feature, op, threshold, weight in rules:
            value = _value(states, feature)
            if value is not None:
                support = rule_support(value, F.lit(op), F.lit(threshold)) if graded else _fires(value, op, threshold).cast("double")
                got = got + weight * F.when(value.isNotNull(), support).otherwise(0.0)
        scores[stage] = got / sum(r[4] for r in rules)
    return scores


def score_stages(states: DataFrame, graded: bool = True) -> DataFrame:
    """(capture_id, window, stage, score); rules on absent or non-finite features add nothing but stay in the denominator."""
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), e.alias("score")) for s, e in stage_scores(states, graded).items()))
    return states.select("capture_id", "window", F.inline(rows))


def _reasons(states: DataFrame, stage: Column) -> Column:
    """Texts of the rules of a stage that fire, in their order."""
    texts = []
    for (rule_stage, feature, op, threshold, _), text in zip(RULES, RULE_TEXTS):
        value = _value(states, feature)
        if value is not None:
            texts.append(F.when((stage == rule_stage) & _fires(value, op, threshold), text))
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def explain_rules(states: DataFrame) -> DataFrame:
    """(capture_id, window, stage, rules): the texts of the hard-threshold rules that fire, for each stage that has some."""
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), _reasons(states, F.lit(s)).alias("rules")) for s in RULE_STAGES))
    return states.select("capture_id", "window", F.inline(rows)).filter(F.size("rules") > 0)


def verdicts(forecasts: DataFrame, states: DataFrame) -> DataFrame:
    """CONFIRMED, PREDICTED, WATCH or CLEAR per window from forecasts (capture_id, window, probability, stage) and the windows' features.

    Forecasts without a window of features are left out. The best stage is the first of the rules' stages with the highest score.
    """
    key = ["capture_id", "window"]
    rows = forecasts.select(*key, "probability", F.col("stage").alias("forecast_stage")).join(states, key)
    every = F.array(*(F.struct(e.alias("score"), F.lit(-k).alias("order"), F.lit(s).alias("stage")) for k, (s, e) in enumerate(stage_scores(states).items())))
    rows = rows.withColumn("_scores", every).withColumn("_best", F.array_max("_scores"))
    own = F.coalesce(F.get(F.filter("_scores", lambda x: x["stage"] == F.col("forecast_stage")), F.lit(0))["score"], F.lit(0.0))
    rows = rows.withColumns({"_own": own, "_first": _reasons(states, F.col("forecast_stage")), "_second": _reasons(states, F.col("_best.stage"))})
    p, e, best, benign = F.col("probability"), F.col("_own"), F.col("_best.score"), F.col("forecast_stage") == "Benign"
    bar = HIGH - (HIGH - FLOOR) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), e / STRONG))
    corroborated = ~benign & (e >= STRONG)
    level = F.when(benign, F.when(best >= STRONG, "WATCH").otherwise("CLEAR")).when(corroborated & (p >= bar), "CONFIRMED").when(p >= HIGH, "PREDICTED").when((p >= LOW) | (best >= STRONG), "WATCH").otherwise("CLEAR")
    damp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (e - WEAK) / (STRONG - WEAK)))
    risk = F.when(benign, p * RETAIN).when(corroborated, p).otherwise(p * (RETAIN + (1 - RETAIN) * damp))
    reasons = F.when((e > 0) & (F.size("_first") > 0), F.col("_first")).when(best > 0, F.col("_second")).otherwise(F.array().cast("array<string>"))
    return rows.select(
        *key, "forecast_stage", "probability", F.round(e, 4).alias("observed_score"), F.col("_best.stage").alias("observed_stage"), F.round(best, 4).alias("observed_best_score"),
        corroborated.alias("corroborated"), level.alias("level"), F.round(risk, 4).alias("risk"), F.slice(reasons, 1, 4).alias("reasons"),
    )


def score_timeline(timeline: DataFrame, states: DataFrame) -> DataFrame:
    """Verdicts of every forecast row by the state vector alone, whose names not all rules know; the row's alert is that it is CONFIRMED."""
    features = states.select("capture_id", "window", *STATE_FEATURES)
    return verdicts(timeline, features).withColumn("alert", F.col("level") == "CONFIRMED")


def headline(scored: DataFrame, novelty: DataFrame | None = None) -> DataFrame:
    """One line per capture that tells what is seen from what is expected; ``novelty`` has capture_id, verdict.

    Of equal risks the earliest window is named.
    """
    top = lambda level: F.max(F.when(F.col("level") == level, F.struct("risk", (-F.col("window")).alias("order"), "forecast_stage", "observed_score")))
    rows = scored.groupBy("capture_id").agg(top("CONFIRMED").alias("c"), top("PREDICTED").alias("p"), F.max("risk").alias("peak"), F.max("probability").alias("raw"))
    if novelty is not None:
        rows = rows.join(novelty.select("capture_id", "verdict"), "capture_id", "left")
    else:
        rows = rows.withColumn("verdict", F.lit(None).cast("string"))
    two = lambda c: F.format_string("%.2f", c)
    withheld = F.concat(F.lit("VERDICT WITHHELD -- traffic outside the model's training distribution (peak raw probability "), two(F.col("raw")), F.lit(", not trustworthy here)"))
    seen = F.concat(F.lit("CONFIRMED "), F.col("c.forecast_stage"), F.lit(" in window "), (-F.col("c.order")).cast("string"), F.lit(" at "), two(F.col("c.risk")), F.lit(" (corroborated by "), two(F.col("c.observed_score")), F.lit(" rule evidence)"))
    next_ = F.when(F.col("p").isNotNull(), F.concat(F.lit("; model forecasts "), F.col("p.forecast_stage"), F.lit(" next (not yet corroborated)"))).otherwise("")
    foreseen = F.concat(F.lit("PREDICTED "), F.col("p.forecast_stage"), F.lit(" at "), two(F.col("p.risk")), F.lit(" -- forecast only, no corroborating evidence in the capture yet"))
    none = F.concat(F.lit("no confirmed intrusion; peak credible risk "), two(F.col("peak")))
    text = F.when(F.col("verdict") == "outside", withheld).when(F.col("c").isNotNull(), F.concat(seen, next_)).when(F.col("p").isNotNull(), foreseen).otherwise(none)
    return rows.select("capture_id", text.alias("headline"))


def peaks(scored: DataFrame) -> DataFrame:
    """Per capture: the first window of the highest credible risk, that risk, and the highest raw probability."""
    return scored.groupBy("capture_id").agg(F.max_by("window", F.struct("risk", -F.col("window"))).alias("window"), F.max("risk").alias("peak_risk"), F.max("probability").alias("raw_peak_probability"))


def rule_agreement(states: DataFrame, peak: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` stages that the rules score highest in each capture's peak window (capture_id, window), the first rules' stage of equals."""
    at = states.join(peak.select("capture_id", "window"), ["capture_id", "window"])
    every = F.array(*(F.struct((-e).alias("order"), F.lit(n).alias("place"), F.lit(s).alias("stage"), e.alias("score")) for n, (s, e) in enumerate(stage_scores(states).items())))
    best = at.select("capture_id", "window", F.posexplode(F.slice(F.array_sort(every), 1, k)).alias("at", "s"))
    return best.select("capture_id", "window", (F.col("at") + 1).alias("place"), "s.stage", "s.score")


def alert_episodes(scored: DataFrame, threshold: float) -> DataFrame:
    """Runs of consecutive windows at or above the threshold: first, last, count and peak."""
    alerts = scored.filter(F.col("score") >= threshold)
    island = F.col("window") - F.row_number().over(Window.partitionBy("capture_id").orderBy("window"))
    return alerts.withColumn("_i", island).groupBy("capture_id", "_i").agg(F.min("window").alias("first_window"), F.max("window").alias("last_window"), F.count("*").alias("n_windows"), F.max("score").alias("peak")).drop("_i")


def peak_window(scored: DataFrame) -> DataFrame:
    """First window with the highest score, per capture."""
    return scored.groupBy("capture_id").agg(F.max_by("window", F.struct("score", -F.col("window"))).alias("window"), F.max("score").alias("peak"))
