"""Why a score is what it is: masked features and windows, scored in bulk by any scorer DataFrame -> DataFrame that adds ``score``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import describe_feature

MOST_BACKGROUND, COALITIONS = 32, 256


def coalitions(features: int, most: int = COALITIONS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Masks (rows x features) and kernel weights: every coalition where ``most`` allows it, else small and large ones first and then drawn ones in pairs of complements."""
    sizes = range(1, features)
    weight = {k: (features - 1) / (comb(features, k) * k * (features - k)) for k in sizes}
    if 2**features - 2 <= most:
        masks = np.array([[m >> f & 1 for f in range(features)] for m in range(1, 2**features - 1)], bool)
        return masks, np.array([weight[int(k)] for k in masks.sum(axis=1)])
    rng = np.random.default_rng(seed)
    masks = [np.eye(features, dtype=bool), ~np.eye(features, dtype=bool)] if 2 * features <= most else []
    have = sum(map(len, masks))
    inner = [k for k in sizes if 2 <= k <= features - 2] if masks else list(sizes)
    mass = np.array([weight[k] * comb(features, k) for k in inner], float)
    drawn = []
    for k in rng.choice(inner, size=max(1, (most - have) // 2), p=mass / mass.sum()):
        row = np.zeros(features, bool)
        row[rng.choice(features, int(k), replace=False)] = True
        drawn += [row, ~row]
    weights = [np.full(have, weight[1])] if masks else []
    weights.append(np.full(len(drawn), mass.sum() / len(drawn)))
    return np.concatenate([*masks, np.array(drawn)]), np.concatenate(weights)


def feature_attribution(contexts: DataFrame, background: DataFrame, scorer, link: str = "identity", most: int = COALITIONS, seed: int = 0) -> DataFrame:
    """(capture_id, window, feature, contribution, base_value, prediction): Shapley values of features, each masked over the whole context.

    ``contexts`` has capture_id, window, context; ``background`` context, of which the first
    MOST_BACKGROUND by hash stand for what a masked feature might have been. All masked contexts are
    rows that ``scorer`` scores at once; a row's values come from its own coalitions by least
    squares, under the constraint that they add up to prediction less base value. With ``link``
    "logit" probabilities are explained on that scale, kept off 0 and 1.
    """
    first = contexts.first()
    if first is None:
        raise ValueError("no contexts to explain")
    f = len(first.context[0])
    masks, weights = coalitions(f, most, seed)
    masks = np.concatenate([np.zeros((1, f), bool), np.ones((1, f), bool), masks])
    spark = contexts.sparkSession
    table = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(masks)], "coalition int, mask array<boolean>")
    some = background.select(F.col("context").alias("other")).orderBy(F.xxhash64("context")).limit(MOST_BACKGROUND)
    mixed = F.zip_with("context", "other", lambda a, b: F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), F.col("mask").alias("m")), lambda t: F.when(t["m"], t["a"]).otherwise(t["b"])))
    rows = contexts.select("capture_id", "window", "context").crossJoin(F.broadcast(table)).crossJoin(F.broadcast(some))  # at most ``most`` + 2 and MOST_BACKGROUND rows
    scored = scorer(rows.select("capture_id", "window", "coalition", mixed.alias("context")))
    value = F.col("score")
    if link == "logit":
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), value))
        value = F.log(p / (1 - p))
    means = scored.groupBy("capture_id", "window", "coalition").agg(F.avg(value).alias("v"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(len(masks))
        v[group["coalition"].to_numpy()] = group["v"].to_numpy()
        base, full = v[0], v[1]
        z, y = masks[2:].astype(float), v[2:] - base
        # the last feature takes what is left, so the sum is right
        a, b = z[:, :-1] - z[:, -1:], y - z[:, -1] * (full - base)
        root = np.sqrt(weights)
        part = np.linalg.lstsq(a * root[:, None], b * root, rcond=None)[0] if f > 1 else np.empty(0)
        phi = np.append(part, full - base - part.sum())
        return pd.DataFrame({"capture_id": group["capture_id"].iloc[0], "window": group["window"].iloc[0], "feature": np.arange(f, dtype=np.int32), "contribution": phi, "base_value": base, "prediction": full})

    return means.groupBy("capture_id", "window").applyInPandas(solve, "capture_id long, window long, feature int, contribution double, base_value double, prediction double")


BLOCK_VALUES = 2 << 20


def matrix_attribution(contexts: DataFrame, background: DataFrame, score: Callable[[np.ndarray], np.ndarray], link: str = "identity", most: int = COALITIONS, seed: int = 0) -> DataFrame:
    """``feature_attribution`` for a scorer of matrices (contexts x windows x features to one score each), for many features and many contexts.

    A context's coalitions are made and scored within its batch, about BLOCK_VALUES numbers at a
    time, and never become rows; one small matrix solves the least squares of all. The background's
    MOST_BACKGROUND contexts at most come to the driver. Without contexts there is no row.
    """
    others = [r.other for r in background.select(F.col("context").alias("other")).orderBy(F.xxhash64("context")).limit(MOST_BACKGROUND).collect()]
    if not others:
        raise ValueError("no background to mask with")
    other = np.array(others, float)
    f = other.shape[2]
    masks, weights = coalitions(f, most, seed) if f > 1 else (np.zeros((0, 1), bool), np.zeros(0))
    z = masks.astype(float)
    root = np.sqrt(weights)
    # the last feature takes what is left, so the sum is right
    solve = np.linalg.pinv((z[:, :-1] - z[:, -1:]) * root[:, None]) * root if f > 1 else np.zeros((0, 0))

    def explain(x: np.ndarray) -> tuple[np.ndarray, float, float]:
        every = np.concatenate([np.zeros((1, f), bool), np.ones((1, f), bool), masks])
        step = max(1, BLOCK_VALUES // other.size)
        v = []
        for at in range(0, len(every), step):
            part = every[at : at + step]
            mixed = np.where(part[:, None, None, :], x, other)
            got = np.asarray(score(mixed.reshape(-1, *x.shape)), float)
            if link == "logit":
                got = np.clip(got, 1e-6, 1 - 1e-6)
                got = np.log(got / (1 - got))
            v.append(got.reshape(len(part), -1).mean(axis=1))
        v = np.concatenate(v)
        base, full = v[0], v[1]
        part = solve @ (v[2:] - base - z[:, -1] * (full - base))
        return np.append(part, full - base - part.sum()), base, full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = b.slice(at, 1024)
                got = [explain(np.array(c.as_py(), float)) for c in rows.column("context")]
                if got:
                    n = len(got)
                    repeat = lambda c: pa.array(np.repeat(rows.column(c).to_numpy(zero_copy_only=False), f))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [repeat("capture_id"), repeat("window"), pa.array(np.tile(np.arange(f, dtype=np.int32), n)), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.repeat([g[1] for g in got], f)), pa.array(np.repeat([g[2] for g in got], f))],
                        names=["capture_id", "window", "feature", "contribution", "base_value", "prediction"],
                    )

    rows = contexts.select(F.col("capture_id").cast("long").alias("capture_id"), F.col("window").cast("long").alias("window"), "context")
    return rows.mapInArrow(run, "capture_id long, window long, feature int, contribution double, base_value double, prediction double")


def temporal_attribution(contexts: DataFrame, background: DataFrame, scorer) -> DataFrame:
    """(capture_id, window, lag, share): how much the score moves when one window of the context becomes the background's mean; lag 0 is the last window."""
    mean = background.select(F.explode("context").alias("x")).select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m")).orderBy("f").collect()  # a row per feature
    plain = F.array(*(F.lit(r.m) for r in mean))
    n = F.size("context")
    at = F.explode(F.sequence(F.lit(-1), n - 1)).alias("at")
    rows = contexts.select("capture_id", "window", "context", at)
    swapped = F.transform("context", lambda row, k: F.when(k == F.col("at"), plain).otherwise(row))
    scored = scorer(rows.select("capture_id", "window", "at", (n - 1 - F.col("at")).alias("lag"), swapped.alias("context")))
    every = Window.partitionBy("capture_id", "window")
    moved = scored.withColumn("_d", F.abs(F.max(F.when(F.col("at") == -1, F.col("score"))).over(every) - F.col("score")))
    total = F.sum("_d").over(every)
    return moved.select("capture_id", "window", "at", "lag", F.when(total > 0, F.col("_d") / total).otherwise(0.0).alias("share")).filter("at >= 0").drop("at")


def top_drivers(attributed: DataFrame, name: Column, k: int = 8) -> DataFrame:
    """The ``k`` features of each explained window that move its score most, in words; ``name`` is the feature's name."""
    place = F.row_number().over(Window.partitionBy("capture_id", "window").orderBy(F.desc(F.round(F.abs("contribution"), 9)), "feature"))
    rows = attributed.withColumn("place", place).filter(F.col("place") <= k)
    return rows.select("capture_id", "window", "place", name.alias("feature"), describe_feature(name).alias("description"), "contribution", F.when(F.col("contribution") > 0, "raises").otherwise("lowers").alias("direction"))


def key_windows(shares: DataFrame, k: int = 3) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("capture_id", "window").orderBy(F.desc(F.round("share", 9)), "lag"))
    return shares.withColumn("place", place).filter(F.col("place") <= k)
