"""Evaluation of scores (capture_id, t, y, score): every metric is grouped counts and running sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binary_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    m = scored.agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & ~pos).alias("tn"), n(~hit & pos).alias("fn"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    m = m.select("*", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(fp, fp + tn).alias("fpr"), div(tp + tn, tp + fp + tn + fn).alias("accuracy"))
    return m.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def running_counts(scored: DataFrame, parts: int = 64) -> DataFrame:
    """(score, p, n, tp, fp, np, nn) of each distinct score: positives and negatives there, and from there upwards, and in all.

    Rows are counted by score first. Running sums go by ``parts`` of the range of scores, whose
    totals are few, then within the parts: no task orders all scores. Null scores are left out.
    """
    g = scored.filter("score IS NOT NULL").groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    cuts = F.lit(sorted(set(scored.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 50 * parts)).first()[0] or [])))  # at most ``parts`` - 1
    g = g.withColumn("part", F.size(F.filter(cuts.cast("array<double>"), lambda c: c < F.col("score"))))
    sums = g.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))
    above, whole = Window.orderBy(F.desc("part")), Window.partitionBy()  # over at most ``parts`` rows
    sums = sums.select("part", (F.sum("pp").over(above) - F.col("pp")).alias("tp0"), (F.sum("pn").over(above) - F.col("pn")).alias("fp0"), F.sum("pp").over(whole).alias("np"), F.sum("pn").over(whole).alias("nn"))
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    return g.join(F.broadcast(sums), "part").select("score", "p", "n", (F.col("tp0") + F.sum("p").over(down)).alias("tp"), (F.col("fp0") + F.sum("n").over(down)).alias("fp"), "np", "nn")


def _by_score(scored: DataFrame, *by: str) -> DataFrame:
    if not by:
        return running_counts(scored)
    g = scored.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("score"))
    return g.select(*by, "score", "p", "n", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"))


def auc_of(counts: DataFrame, *by: str) -> DataFrame:
    g = counts.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("u"))
    return g.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def precision_of(counts: DataFrame, *by: str) -> DataFrame:
    g = counts.groupBy(*by).agg(F.sum("p").alias("np"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"))
    return g.select(*by, F.when(F.col("np") > 0, F.col("s") / F.col("np")).alias("average_precision"))


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """Tie-aware area under the curve over distinct scores; null with one class."""
    return auc_of(_by_score(scored, *by), *by)


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    return precision_of(_by_score(scored, *by), *by)


def threshold_for_fpr(scored: DataFrame, fpr: float) -> DataFrame:
    """Per capture, the score that at most floor(fpr * negatives) negatives exceed."""
    neg = scored.filter("y = 0").groupBy("capture_id", "score").agg(F.count("*").alias("c"))
    down = Window.partitionBy("capture_id").orderBy(F.desc("score"))
    neg = neg.select("capture_id", "score", (F.sum("c").over(down) - F.col("c")).alias("above"), F.sum("c").over(Window.partitionBy("capture_id")).alias("n"))
    return neg.filter(F.col("above") <= F.floor(F.col("n") * fpr)).groupBy("capture_id").agg(F.min("score").alias("cut"))


def stage_metrics(pairs: DataFrame, n_classes: int) -> DataFrame:
    """Precision, recall, F1 and support of each class from (stage_true, stage_pred)."""
    counts = pairs.groupBy("stage_true", "stage_pred").agg(F.count("*").alias("c"))
    both = counts.select(F.explode(F.array(F.struct(F.col("stage_true").alias("stage"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("stage_pred").alias("stage"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "c", (F.col("stage_true") == F.col("stage_pred")).alias("ok")).select("s.*", "c", "ok")
    g = both.groupBy("stage").agg(F.sum(F.col("t") * F.col("c")).alias("support"), F.sum(F.col("p") * F.col("c")).alias("predicted"), F.sum(F.when(F.col("ok"), F.col("t") * F.col("c")).otherwise(0)).alias("correct"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    g = g.select("stage", "support", div(F.col("correct"), F.col("predicted")).alias("precision"), div(F.col("correct"), F.col("support")).alias("recall"))
    return g.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """(stage_true, stage_pred, n), pairs that occur."""
    return pairs.groupBy("stage_true", "stage_pred").agg(F.count("*").alias("n"))


def stage_summary(pairs: DataFrame, n_classes: int) -> DataFrame:
    """Accuracy, and F1 over the classes that occur, plain and by support."""
    m = stage_metrics(pairs, n_classes)
    right = F.avg((F.col("stage_true") == F.col("stage_pred")).cast("double"))
    of = m.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return pairs.agg(F.count("*").alias("n"), right.alias("accuracy")).crossJoin(of)  # one row each


def event_stats(onsets: DataFrame, threshold: float, window_s: float = 30.0) -> DataFrame:
    """Per capture: events, events warned of, median lead seconds; ``onsets`` has capture_id, onset, steps_to_onset, score."""
    warned = F.max(F.when(F.col("score") >= threshold, F.col("steps_to_onset")))
    per = onsets.filter("onset IS NOT NULL").groupBy("capture_id", "onset").agg((warned * window_s).alias("lead"))
    return per.groupBy("capture_id").agg(F.count("*").alias("events"), F.count("lead").alias("warned"), F.percentile("lead", 0.5).alias("median_lead_s"))


def _draws(n: int, m: int, seed: int) -> np.ndarray:
    """How often each of ``m`` captures is in each of ``n`` draws of as many, by digests of seed and place."""
    picks = [int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], 16) % m for k in range(n * m)]
    return np.stack([np.bincount(picks[d * m : (d + 1) * m], minlength=m) for d in range(n)]).astype(float)


def _wins(per: DataFrame, times: np.ndarray, place: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each draw: positives, negatives, and pairs in which the positive scores higher, ties for half; ``per`` has capture_id, score, p, c.

    Scores are dealt to tasks by range and read there in order, with running sums for all draws at
    once; a task returns three sums a draw, and those of lower ranges count as its lower negatives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(len(times))
        pos, neg, wins, first, held = zero.copy(), zero.copy(), zero.copy(), None, None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                score, p, c = (part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("score", "p", "c"))
                k = times[:, [place[x] for x in part.column("capture_id").to_pylist()]]
                first = score[0] if first is None else first
                cuts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
                up, down = np.add.reduceat(k * p, cuts, axis=1), np.add.reduceat(k * (c - p), cuts, axis=1)
                values = score[cuts]
                if held is not None:  # a score may go on in the next slice
                    if held[0] == values[0]:
                        up[:, 0] += held[1]
                        down[:, 0] += held[2]
                    else:
                        values, up, down = np.r_[held[0], values], np.c_[held[1], up], np.c_[held[2], down]
                held = values[-1], up[:, -1], down[:, -1]
                up, down = up[:, :-1], down[:, :-1]
                lower = neg[:, None] + np.cumsum(down, axis=1) - down / 2
                wins += (up * lower).sum(axis=1)
                pos, neg = pos + up.sum(axis=1), neg + down.sum(axis=1)
        if held is not None:
            wins += held[1] * (neg + held[2] / 2)
            pos, neg = pos + held[1], neg + held[2]
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([pos.tolist()]), pa.array([neg.tolist()]), pa.array([wins.tolist()])], names=["first", "pos", "neg", "wins"])

    dealt = per.select("capture_id", F.col("score").cast("double").alias("score"), "p", "c").repartitionByRange(int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")), "score").sortWithinPartitions("score")
    parts = sorted(dealt.mapInArrow(run, "first double, pos array<double>, neg array<double>, wins array<double>").collect())  # a row a task
    pos, neg, wins = (np.zeros(len(times)) for _ in range(3))
    for r in parts:
        p = np.array(r.pos)
        wins += np.array(r.wins) + p * neg
        pos, neg = pos + p, neg + np.array(r.neg)
    return pos, neg, wins


def _interval(values: np.ndarray) -> list[float | None]:
    values = values[~np.isnan(values)]
    return [float(x) for x in np.percentile(values, [2.5, 97.5])] if len(values) else [None, None]


def cluster_bootstrap(scored: DataFrame, n: int = 300, seed: int = 0, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """95 % intervals over ``n`` draws of captures with replacement; draws with one class are left out.

    Always of the AUC, from scored (capture_id, y, score). With a ``threshold``, which alerts reach
    (exceed where ``strict``), also of the true-positive rate and of the share of events warned of;
    ``scored`` then has onset as well, and a capture drawn twice counts its events twice. Under three
    captures there is no interval and no draw. Numbers for each capture come to the driver, a few.
    """
    spark = scored.sparkSession
    alert = F.lit(False) if threshold is None else (F.col("score") > threshold if strict else F.col("score") >= threshold)
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    by_capture = scored.groupBy("capture_id").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), hit(alert & (F.col("y") == 1)).alias("hits")).orderBy("capture_id").collect()  # a row a capture
    place = {r.capture_id: k for k, r in enumerate(by_capture)}
    m = len(place)
    schema = "draws int, auc_low double, auc_high double" + (", tpr_low double, tpr_high double, event_recall_low double, event_recall_high double" if threshold is not None else "")
    if m < 3:
        return spark.createDataFrame([(0, *[None] * (schema.count(",")))], schema)
    times = _draws(n, m, seed)
    per = scored.groupBy("capture_id", "score").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    pos, neg, wins = _wins(per, times, place)
    both = (pos > 0) & (neg > 0)
    row = [int(both.sum()), *_interval(wins[both] / (pos * neg)[both])]
    if threshold is not None:
        ratio = lambda a, b: (times @ a)[both] / np.where(times @ b > 0, times @ b, np.nan)[both]
        row += _interval(ratio(np.array([r.hits for r in by_capture], float), np.array([r.p for r in by_capture], float)))
        events = scored.filter("onset IS NOT NULL").groupBy("capture_id", "onset").agg(F.max(alert.cast("int")).alias("warned")).groupBy("capture_id").agg(F.sum("warned").alias("warned"), F.count("*").alias("events")).collect()  # a row a capture
        warned, count = np.zeros(m), np.zeros(m)
        for r in events:
            warned[place[r.capture_id]], count[place[r.capture_id]] = r.warned, r.events
        row += _interval(ratio(warned, count))
    return spark.createDataFrame([tuple(row)], schema)
