"""Sequence and onset samples, splits and class weights over windows (capture_id, window, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STAGES


def _order():
    return Window.partitionBy("capture_id").orderBy("window")


def contexts(states: DataFrame, length: int, value: str) -> DataFrame:
    """Every sliding context of ``length`` windows (array), at its last window."""
    rows = states.withColumn("context", F.collect_list(value).over(_order().rowsBetween(-(length - 1), 0)))
    return rows.filter(F.size("context") == length)


def context_slice(context: Column, n: int) -> Column:
    return F.slice(context, -n, n)


ESCALATION = ("LateralMovement", "CommandAndControl", "Exfiltration", "Impact")


def escalation_task(windows: DataFrame) -> DataFrame:
    """Windows (capture_id, window, stage as its index, valid) as onset input whose activity is what follows a foothold."""
    return windows.select("capture_id", "window", F.col("stage").isin(*(STAGES.index(s) for s in ESCALATION)).cast("int").alias("active"), "valid")


def build_sequences(states: DataFrame, length: int, horizon: int, value: str, stage: str) -> DataFrame:
    """Context, next value and the stages of the next ``horizon`` windows, where both are whole.

    Columns ``valid`` and ``infiltration``, where ``states`` has them, come as arrays over the same windows.
    """
    ahead = _order().rowsBetween(1, horizon)
    rows = states.select("capture_id", "window", F.collect_list(value).over(_order().rowsBetween(-(length - 1), 0)).alias("context"), F.lead(value).over(_order()).alias("target_state"), F.collect_list(stage).over(ahead).alias("target_stage"), *(F.collect_list(c).over(ahead).alias(f"target_{c}") for c in ("valid", "infiltration") if c in states.columns))
    return rows.filter((F.size("context") == length) & (F.size("target_stage") == horizon))


def build_onset_samples(windows: DataFrame, length: int, horizon: int, quiet_gap: int = 3) -> DataFrame:
    """Quiet windows with whether, and in how many steps, activity starts; ``windows`` has capture_id, window (0..), active, valid."""
    n = F.count("*").over(Window.partitionBy("capture_id"))
    back, ahead = _order().rowsBetween(-(quiet_gap - 1), 0), _order().rowsBetween(1, horizon)
    near = _order().rowsBetween(-(quiet_gap - 1), horizon)
    rows = windows.select(
        "capture_id", "window", n.alias("_n"), F.max("active").over(back).alias("_busy"), F.min(F.col("valid").cast("int")).over(near).alias("_valid"),
        F.min(F.when(F.col("active") == 1, F.col("window"))).over(ahead).alias("onset"),
    )
    rows = rows.filter((F.col("window") >= max(length, quiet_gap) - 1) & (F.col("window") <= F.col("_n") - horizon - 1) & (F.col("_busy") == 0) & (F.col("_valid") == 1))
    return rows.select("capture_id", "window", F.col("onset").isNotNull().cast("int").alias("label"), F.coalesce(F.col("onset") - F.col("window"), F.lit(0)).alias("steps_to_onset"), "onset")


def time_split(samples: DataFrame, val: float, test: float, gap: int) -> DataFrame:
    """Chronological split per capture with ``gap`` samples dropped at the end of train and validation; the gap never empties a block."""
    rows = samples.withColumn("_i", F.row_number().over(_order()) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("capture_id")))
    n_val, n_test = F.bround(F.col("_n") * val), F.bround(F.col("_n") * test)
    n_train = F.col("_n") - n_val - n_test
    room = lambda n: F.when(n > 0, n - 1).otherwise(0)
    drop = F.greatest(F.lit(0), F.least(F.lit(gap), n_train - 1, room(n_val), room(n_test)))
    end_train, end_val = n_train, n_train + n_val
    part = F.when(F.col("_i") < end_train - drop, "train").when((F.col("_i") >= end_train) & (F.col("_i") < end_val - drop), "val").when(F.col("_i") >= end_val, "test")
    return rows.withColumn("split", F.when(n_train > 0, part)).drop("_i", "_n").filter("split IS NOT NULL")


def _ranked(ids: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Captures with their place (from 1) in the order of a seeded hash, and how many there are; ranges of the order are counted apart."""
    order = F.md5(F.concat_ws("|", F.lit(seed), "capture_id"))
    part = F.substring(order, 1, 2)
    keyed = ids.select("capture_id", order.alias("_h"), part.alias("_p"))
    sizes = {r[0]: r[1] for r in keyed.groupBy("_p").count().collect()}  # at most 256 rows
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    table = ids.sparkSession.createDataFrame(list(before.items()), "_p string, _b long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", "capture_id"))
    return keyed.join(F.broadcast(table), "_p").select("capture_id", (F.col("_b") + place).alias("_i")), total  # at most 256 rows


def group_split(samples: DataFrame, val: float, test: float, seed: int) -> DataFrame:
    """Whole captures to train, val and test, in the order of a seeded hash; a share above 0 gets one at least. Raises where no capture is left to train on."""
    ids, n = _ranked(samples.select("capture_id").distinct(), seed)
    n_test, n_val = (max(1, round(n * share)) if share > 0 else 0 for share in (test, val))
    if n_test + n_val >= n:
        raise ValueError(f"{n} captures cannot support {n_val} validation and {n_test} test captures")
    part = F.when(F.col("_i") <= n_test, "test").when(F.col("_i") <= n_test + n_val, "val").otherwise("train")
    return samples.join(ids.select("capture_id", part.alias("split")), "capture_id")


def holdout_split(samples: DataFrame, stages: DataFrame, stage: str, val: float = 0.2, seed: int = 1337) -> DataFrame:
    """Captures that hold ``stage`` to test, the others to train and val; ``stages`` has capture_id, stage.

    Raises where no capture holds it or fewer than three others are left. A capture of ``samples``
    that ``stages`` does not know counts as without it.
    """
    held = stages.filter(F.col("stage") == stage).select("capture_id").distinct()
    ids = samples.select("capture_id").distinct()
    if ids.join(held, "capture_id", "left_semi").isEmpty():
        raise ValueError(f"no capture contains {stage}")
    rest, n = _ranked(ids.join(held, "capture_id", "left_anti"), seed)
    if n < 3:
        raise ValueError(f"only {n} captures without {stage} remain to train on")
    rest = rest.select("capture_id", F.when(F.col("_i") <= max(1, round(n * val)), "val").otherwise("train").alias("split"))
    return samples.join(rest.unionByName(held.withColumn("split", F.lit("test"))), "capture_id")


def class_weights(labels: DataFrame, n_classes: int) -> DataFrame:
    """Inverse frequency over valid labels (stage); an absent class weighs 1."""
    counts = labels.groupBy("stage").agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("stage"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = every.join(counts, "stage", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("stage", F.coalesce(F.col("total") / (F.col("kinds") * F.col("n")), F.lit(1.0)).alias("weight"))


def ewma(context: Column, alpha: float = 0.5) -> Column:
    """Exponential average over a context, from 0."""
    return F.aggregate(context, F.lit(0.0), lambda a, x: alpha * x.cast("double") + (1 - alpha) * a)


def smooth_scores(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("smooth", F.avg("score").over(_order().rowsBetween(-(k - 1), 0)))
