"""Studies over captures: splits by time, overlays, context features, baselines and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import flags_to_str
from ..schema import TCP_FLAGS, WINDOW_US
from . import profile
from .samples import ewma

PREVALENCES = (1e-2, 1e-3, 1e-4)


def time_segment(packets: DataFrame, low: float, high: float) -> DataFrame:
    """Packets from the fraction ``low`` up to, not including, ``high`` of their capture's time."""
    span = packets.groupBy("capture_id").agg(F.min("ts_us").alias("_a"), F.max("ts_us").alias("_z"))
    at = F.col("_a") + (F.col("_z") - F.col("_a")) * F.lit(low)
    to = F.col("_a") + (F.col("_z") - F.col("_a")) * F.lit(high)
    return packets.join(span, "capture_id").filter((F.col("ts_us") >= at) & (F.col("ts_us") < to)).drop("_a", "_z")


def segment_split(packets: DataFrame, val: float = 0.55, test: float = 0.72) -> DataFrame:
    """Packets with their split: train, val and test follow each other in time; the last instant is in none."""
    span = packets.groupBy("capture_id").agg(F.min("ts_us").alias("_a"), F.max("ts_us").alias("_z"))
    rows = packets.join(span, "capture_id").filter(F.col("ts_us") < F.col("_z"))
    bar = lambda f: F.col("_a") + (F.col("_z") - F.col("_a")) * F.lit(f)
    return rows.withColumn("split", F.when(F.col("ts_us") < bar(val), "train").when(F.col("ts_us") < bar(test), "val").otherwise("test")).drop("_a", "_z")


def overlay_union(background: DataFrame, injected: DataFrame, timeline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Background and injected packets as one capture, and the timeline cut at the background's end.

    Injected packets outside the background's span go, as do intervals that start after it.
    """
    span = background.groupBy("capture_id").agg(F.min("ts_us").alias("_a"), F.max("ts_us").alias("_z"))
    inside = injected.join(span, "capture_id").filter(F.col("ts_us").between(F.col("_a"), F.col("_z"))).drop("_a", "_z")
    packets = background.withColumn("injected", F.lit(False)).unionByName(inside.withColumn("injected", F.lit(True)))
    cut = timeline.join(span, "capture_id").filter(F.col("start_us") <= F.col("_z"))
    cut = cut.withColumn("truncated", F.col("end_us") > F.col("_z")).withColumn("end_us", F.least("end_us", "_z")).drop("_a", "_z")
    return packets, cut


def flag_summary(counts: dict[str, Column]) -> Column:
    """Flag names whose counts are above 0; ``counts`` maps a flag's name to its count."""
    bits = F.lit(0)
    for bit, name in TCP_FLAGS:
        if name in counts:
            bits = bits + F.when(counts[name] > 0, bit).otherwise(0)
    return flags_to_str(bits)


def flagged_flows(flows: DataFrame, peaks: DataFrame, limit: int = 25) -> DataFrame:
    """The flows most worth a look in each capture's peak window; ``flows`` has their window and ratios, ``peaks`` capture_id, window."""
    size = F.log1p(F.col("total_bytes")) / 20.0
    score = 2.0 * F.col("syn_ratio") + 1.5 * F.col("rst_ratio") + F.col("payload_zero_ratio") + size + F.col("retransmission_ratio")
    rows = flows.join(peaks.select("capture_id", "window"), ["capture_id", "window"]).withColumn("score", F.round(score, 9))
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("score"), "flow_no"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def group_stages(stages: DataFrame) -> DataFrame:
    """The stages that each capture holds, sorted; ``stages`` has capture_id, stage."""
    return stages.groupBy("capture_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def min_context_check(windows: DataFrame, length: int = 16) -> DataFrame:
    """Windows per capture and whether they fill one context."""
    g = windows.groupBy("capture_id").agg(F.count_distinct("window").alias("n_windows"))
    return g.withColumn("note", F.when(F.col("n_windows") < length, F.concat(F.lit("needs "), F.lit(length), F.lit(" windows, has "), F.col("n_windows"))))


def context_features(long: DataFrame, length: int = 16) -> DataFrame:
    """Per window and feature: last, exponential average, recent maximum and slope over the context; per window: how many stand out.

    ``long`` has capture_id, window, feature, value; windows without a whole context have no rows.
    """
    order = Window.partitionBy("capture_id", "feature").orderBy("window")
    rows = long.withColumn("context", F.collect_list("value").over(order.rowsBetween(-(length - 1), 0))).filter(F.size("context") == length)
    last = F.element_at("context", -1)
    rows = rows.select(
        "capture_id", "window", "feature", last.alias("last"), ewma(F.col("context")).alias("ewma"),
        F.array_max(F.slice("context", -3, 3)).alias("recent_max"), (last - F.element_at("context", -min(8, length))).alias("slope"),
        F.aggregate("context", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("_abs"),
    )
    every = Window.partitionBy("capture_id", "window")
    far = lambda c: F.sum((F.abs(F.col(c)) > 3).cast("int")).over(every)
    return rows.select("capture_id", "window", "feature", "last", "ewma", "recent_max", "slope", far("last").alias("far_last"), far("ewma").alias("far_ewma"), F.avg(F.abs("last")).over(every).alias("mean_last"), (F.avg("_abs").over(every) / length).alias("mean_all"))


def persistence_forecast(long: DataFrame) -> DataFrame:
    """Each value with the forecast that it stays as in the window before; first windows have none."""
    back = F.lag("value").over(Window.partitionBy("capture_id", "feature").orderBy("window"))
    return long.withColumn("forecast", back).filter("forecast IS NOT NULL")


def dynamics_metrics(forecasts: DataFrame) -> DataFrame:
    """Squared and absolute errors of ``forecast`` against ``value`` per feature."""
    e = F.col("forecast") - F.col("value")
    g = forecasts.groupBy("feature").agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return g.withColumn("rmse", F.sqrt("mse"))


def worst_features(long: DataFrame, standardiser: DataFrame, k: int = 6) -> DataFrame:
    """Per capture, the features most outside the envelope, with their range in original units."""
    g = profile.outside(long, standardiser).groupBy("capture_id", "feature", "mean", "scale", "lo", "hi")
    g = g.agg(F.avg("value").alias("value"), F.avg("z").alias("_z"), F.avg("outside").alias("windows_outside")).filter("windows_outside > 0")
    excess = F.greatest(F.col("_z") - F.col("hi"), F.col("lo") - F.col("_z"), F.lit(0.0))
    order = Window.partitionBy("capture_id").orderBy(F.desc(F.round(F.col("windows_outside") + excess / 1e3, 9)), "feature")
    unit = lambda c: (F.col(c) * F.col("scale") + F.col("mean"))
    g = g.select("capture_id", "feature", "value", unit("lo").alias("train_low"), unit("hi").alias("train_high"), "windows_outside", F.row_number().over(order).alias("place"))
    return g.filter(F.col("place") <= k)


def find_best_threshold(scored: DataFrame, metric: str = "f1", max_fpr: float | None = None) -> DataFrame:
    """First candidate with the best ``metric`` (f1, precision or recall), under a limit on false positives where given.

    Candidates are the distinct scores to 4 digits, or 400 quantiles where there are more. Rows are
    counted between candidates, so what is ordered has 401 rows at most.
    """
    rounded = scored.select(F.round("score", 4).alias("c")).distinct().limit(401).collect()  # 401 at most: more than 400 means quantiles
    candidates = sorted(r.c for r in rounded if r.c is not None)
    if len(rounded) > 400:
        candidates = sorted({r.v for r in profile.quantiles(scored.withColumn("_all", F.lit(0)), ["_all"], "score", tuple(i / 399 for i in range(400))).collect()})  # 400 rows at most
    spark = scored.sparkSession
    table = spark.createDataFrame(list(enumerate(candidates, 1)), "bin int, threshold double")
    # the number of candidates at or below a score: distinct scores are fewer than rows
    counts = scored.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    bins = F.size(F.filter(F.array(*map(F.lit, candidates)) if candidates else F.array().cast("array<double>"), lambda c: c <= F.col("score")))
    counts = counts.groupBy(bins.alias("bin")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = counts.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    down = Window.orderBy(F.desc("bin"))
    m = table.join(counts, "bin", "left").fillna(0, ["p", "n"]).select("threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    m = m.crossJoin(F.broadcast(total))  # one row
    m = m.select("threshold", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("np")).alias("recall"), div(F.col("fp"), F.col("nn")).alias("fpr"))
    m = m.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if max_fpr is not None:
        m = m.filter(F.col("fpr") <= max_fpr)
    best = m.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(metric), "threshold")))
    return best.filter("_r = 1").drop("_r")


def operating_points(scored: DataFrame, thresholds: tuple[float, ...], window_us: int = WINDOW_US) -> DataFrame:
    """Rates, false alerts a day and precision at fixed prevalences for each threshold, in one pass."""
    share = lambda t, y: F.avg(F.when(F.col("y") == y, (F.col("score") >= t).cast("double")))
    one = scored.agg(*(share(t, y).alias(f"r{k}_{y}") for k, t in enumerate(thresholds) for y in (0, 1)))
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{k}_0").alias("fpr"), F.col(f"r{k}_1").alias("tpr")) for k, t in enumerate(thresholds)))))
    hit = lambda p: F.col("tpr") * p
    ppv = {f"ppv_{k}": F.when(hit(p) + F.col("fpr") * (1 - p) > 0, hit(p) / (hit(p) + F.col("fpr") * (1 - p))) for k, p in enumerate(PREVALENCES, 2)}
    return rows.withColumn("false_alerts_per_day", F.col("fpr") * (86_400_000_000 / window_us)).withColumns(ppv)


def event_points(scored: DataFrame, thresholds: tuple[float, ...], window_us: int = WINDOW_US) -> DataFrame:
    """Events, the share warned of and the median lead in seconds for each threshold, in one pass; ``scored`` has capture_id, onset, steps_to_onset, score."""
    lead = lambda t: F.max(F.when(F.col("score") >= t, F.col("steps_to_onset"))) * (window_us / 1e6)
    per = scored.filter("onset IS NOT NULL").groupBy("capture_id", "onset").agg(F.array(*(lead(t) for t in thresholds)).alias("leads"))
    rows = per.select(F.posexplode("leads").alias("k", "lead")).groupBy("k").agg(F.count("*").alias("n_events"), (F.count("lead") / F.count("*")).alias("event_recall"), F.percentile("lead", 0.5).alias("median_lead_s"))
    return rows.select(F.get(F.array(*map(F.lit, thresholds)), F.col("k")).alias("threshold"), "n_events", "event_recall", "median_lead_s")


def label_distribution(samples: DataFrame, by: str = "capture_id") -> DataFrame:
    """Samples, positives and distinct onsets per capture, or per other column such as the split."""
    onset = F.when(F.col("onset").isNotNull(), F.struct("capture_id", "onset"))
    return samples.groupBy(by).agg(F.count("*").alias("samples"), F.sum("label").alias("positives"), F.count_distinct(onset).alias("onsets"))


def stage_distribution(labels: DataFrame, by: str = "capture_id") -> DataFrame:
    """Valid windows of each stage, per capture or other column."""
    return labels.filter("valid").groupBy(by, "stage").agg(F.count("*").alias("windows"))


def serialise_result(windows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One JSON timeline per capture, in window order."""
    row = F.struct("window", *columns)
    return windows.groupBy("capture_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("timeline"))


def serialise_analysis(headlines: DataFrame, timeline: DataFrame, flagged: DataFrame, novelty: DataFrame | None = None, forecast: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(capture_id, result): one JSON object per capture with its headline, and its timeline, flagged flows, novelty, forecast and notes in order.

    ``headlines`` has a row per capture; the others as many as there are, and a capture without any
    has an empty list. A capture's rows meet in one task: they are windows and top flows, not packets.
    """
    out = headlines
    parts = {"timeline": (timeline, "window"), "flagged_flows": (flagged, "place"), "novelty": (novelty, None), "forecast": (forecast, "step"), "notes": (notes, None)}
    for name, (rows, first) in parts.items():
        if rows is None:
            continue
        columns = [c for c in rows.columns if c != "capture_id"]
        columns = [first, *(c for c in columns if c != first)] if first else columns
        listed = rows.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(listed, "capture_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out.select("capture_id", F.to_json(F.struct(*(c for c in out.columns if c != "capture_id"))).alias("result"))


def long_view(states: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(capture_id, window, feature, value) of the named features."""
    return states.unpivot(["capture_id", "window"], list(features), "feature", "value")
