"""Forecasters over sequence samples, as Spark jobs: linear dynamics, stage heads, hazard trees and baselines.

Samples have ``context`` (windows x features, oldest first), ``target_state`` (features) and arrays
``target_stage``, ``target_infil`` and ``target_mask`` over the horizon. Sums over samples are made in
the tasks and added up by Spark in blocks of rows; only matrices whose size is set by the features go
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INFILTRATION_STAGES, STAGES
from ..sources.shared import materialised
from . import boosting
from . import samples as samples_

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
STRENGTHS = (0.003, 0.01, 0.03, 0.1, 0.5)
GRAM_ROWS = 64
BATCH_ROWS = 1024  # rows of a batch that are a matrix at once


def sequence_samples(states: DataFrame, labels: DataFrame, features: list[str], length: int = 16, horizon: int = 5) -> DataFrame:
    """Samples from states and the windows' labels (capture_id, window, stage as its index, valid), ``features`` alone and in that order."""
    missing = [c for c in features if c not in states.columns]
    if missing:
        raise ValueError(f"states lack {missing}")
    infil = F.col("stage").isin(*(STAGES.index(s) for s in INFILTRATION_STAGES)).cast("int")
    rows = states.select("capture_id", "window", F.array(*(F.col(c).cast("double") for c in features)).alias("x")).join(labels.select("capture_id", "window", "stage", "valid", infil.alias("infiltration")), ["capture_id", "window"])
    out = samples_.build_sequences(rows, length, horizon, "x", "stage")
    return out.withColumnsRenamed({"target_valid": "target_mask", "target_infiltration": "target_infil"})


def standardiser(samples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, lo, hi) of each feature over all windows of the contexts; lo and hi on standardised values. One row a feature comes to the driver.

    A window is in as many contexts as they are long: equal ones are counted before their features are taken apart.
    """
    from .profile import fit_standardiser

    windows = materialised(samples.select(F.explode("context").alias("x")).groupBy("x").agg(F.count("*").alias("n")), "windows")
    rows = fit_standardiser(windows.select(F.posexplode("x").alias("feature", "value"), "n"), "n").orderBy("feature").collect()  # a row per feature
    return tuple(np.array([r[c] for r in rows]) for c in ("mean", "scale", "lo", "hi"))


def _matrix(column) -> np.ndarray:
    """An Arrow column of arrays (of arrays) of equal sizes as one row a sample."""
    flat = column.flatten()
    if pa.types.is_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram(rows: DataFrame, width: int, make) -> np.ndarray:
    """Sum over all rows of z'z, where ``make`` turns an Arrow batch into a matrix z of ``width`` columns.

    Tasks add up their own rows; their sums meet in blocks of GRAM_ROWS matrix rows, in two steps, so
    that no task holds more than some blocks. Half of it comes to the driver: 4 * width**2 bytes.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                z = make(b.slice(k, BATCH_ROWS))
                total = z.T @ z if total is None else np.add(total, z.T @ z, out=total)
        if total is None:  # a task without rows has no sums to send
            return
        blocks = range(0, width, GRAM_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([k // GRAM_ROWS for k in blocks], pa.int32()), pa.array([0] * len(blocks), pa.int32()), pa.array([total[k : k + GRAM_ROWS, k:].tobytes() for k in blocks], pa.binary())], names=["block", "part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in group.column("sums"))
        return pa.table({"block": group.column("block")[:1], "part": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, part int, sums binary"
    some = rows.mapInArrow(partial, schema).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).cast("int"))
    once = some.groupBy("block", "part").applyInArrow(add, schema)
    found = once.groupBy("block").applyInArrow(add, schema).orderBy("block").collect()
    out = np.zeros((width, width))
    for r in found:  # from the diagonal on; what lies below it is the same
        k = r.block * GRAM_ROWS
        sums = np.frombuffer(r.sums).reshape(-1, width - k)
        out[k : k + len(sums), k:] = sums
        out[k:, k : k + len(sums)] = sums.T
    return out


class Dynamics:
    """Ridge regression of the state's change on the flattened standardised context."""

    def __init__(self, scaling: tuple, weights: np.ndarray, bias: np.ndarray, alpha: float):
        self.mean, self.scale, self.lo, self.hi = scaling
        self.weights, self.bias, self.alpha = weights, bias, alpha

    def next_state(self, context: np.ndarray, clamp: bool = False) -> np.ndarray:
        """The window after each context (samples x windows*features), in original units."""
        n, f = len(context), len(self.mean)
        z = ((context.reshape(n, -1, f) - self.mean) / self.scale).reshape(n, -1)
        out = z[:, -f:] + z @ self.weights + self.bias
        return (np.clip(out, self.lo, self.hi) if clamp else out) * self.scale + self.mean

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("mean", 0, self.mean.tolist()), ("scale", 0, self.scale.tolist()), ("lo", 0, self.lo.tolist()), ("hi", 0, self.hi.tolist()), ("bias", 0, self.bias.tolist()), ("alpha", 0, [float(self.alpha)])]
        rows += [("weights", k, w.tolist()) for k, w in enumerate(self.weights)]
        spark.createDataFrame(rows, "name string, row int, value array<double>").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dynamics:
        parts: dict[str, list] = {}
        for r in spark.read.parquet(path).orderBy("name", "row").collect():  # a row per feature of a context
            parts.setdefault(r.name, []).append(r.value)
        one = {k: np.array(v[0]) for k, v in parts.items() if k != "weights"}
        return Dynamics((one["mean"], one["scale"], one["lo"], one["hi"]), np.array(parts["weights"]), one["bias"], float(one["alpha"][0]))


def fit_dynamics(train: DataFrame, val: DataFrame | None = None, alphas: tuple[float, ...] = ALPHAS) -> Dynamics:
    """The strength of the ridge is that with the least squared error on ``val``, in one pass for all; the first one without ``val``."""
    scaling = standardiser(train)
    mean, scale = scaling[:2]
    f = len(mean)
    first = train.select(F.size("context").alias("n")).first()
    if first is None:
        raise ValueError("no samples to fit on")
    width = first.n * f

    def scaled(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = ((_matrix(b.column("context")).reshape(b.num_rows, -1, f) - mean) / scale).reshape(b.num_rows, -1)
        return x, (_matrix(b.column("target_state")) - mean) / scale - x[:, -f:]

    g = gram(train.select("context", "target_state"), 1 + width + f, lambda b: np.concatenate([np.ones((b.num_rows, 1)), *scaled(b)], axis=1))
    n = g[0, 0]
    ax, ay = g[0, 1 : 1 + width] / n, g[0, 1 + width :] / n
    xx = g[1 : 1 + width, 1 : 1 + width] - n * np.outer(ax, ax)
    xy = g[1 : 1 + width, 1 + width :] - n * np.outer(ax, ay)
    used = tuple(alphas) if val is not None else tuple(alphas[:1])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place in b.column("id").to_pylist():
                weights = np.linalg.solve(xx + used[place] * np.eye(width), xy)
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([weights.tobytes()], pa.binary()), pa.array([(ay - ax @ weights).tobytes()], pa.binary())], names=["id", "weights", "bias"])

    # in one task, which alone gets the sums: in the driver, whose process has forked Spark's, BLAS may wait for its threads for ever
    solved = train.sparkSession.range(0, len(used), 1, 1).mapInArrow(solve, "id long, weights binary, bias binary").orderBy("id").collect()  # a row per strength, each of the model's size
    tried = [(np.frombuffer(r.weights).reshape(width, f), np.frombuffer(r.bias)) for r in solved]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                x, y = scaled(b.slice(k, BATCH_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(tried)), pa.int32()), pa.array([float(((x @ w + c - y) ** 2).sum()) for w, c in tried])], names=["place", "error"])

    best = 0
    if len(tried) > 1:
        errors = val.select("context", "target_state").mapInArrow(squares, "place int, error double").groupBy("place").agg(F.sum("error").alias("error")).collect()  # a row per strength
        finite = [r for r in errors if r.error < np.inf]
        if errors and not finite:
            raise ValueError("samples hold values that are not finite")
        best = min(finite, key=lambda r: (r.error, r.place)).place if errors else 0
    return Dynamics(scaling, *tried[best], used[best])


def _flat(samples: DataFrame, name: str = "features") -> DataFrame:
    return samples.withColumn(name, array_to_vector(F.flatten("context")))


def _balanced(label: str, counts: dict) -> Column:
    total = sum(counts.values())
    return F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (int(k), total / (len(counts) * n)))), F.col(label).cast("int"))


def fit_logistic(rows: DataFrame, label: str, c: float, iterations: int = 100):
    """Balanced logistic regression of an int label; None with under two classes. ``c`` is the inverse strength over all rows' weight."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row per class
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    weighted = rows.withColumn("weight", _balanced(label, counts))
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=iterations, regParam=1.0 / (c * total), standardization=True, probabilityCol="p", predictionCol="q", rawPredictionCol="r").fit(weighted)


def log_loss(scored: DataFrame, label: str) -> float:
    p = F.get(vector_to_array("p"), F.col(label).cast("int"))
    return scored.agg(F.avg(-F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-15))))).first()[0] or float("inf")


def fit_heads(train: DataFrame, val: DataFrame | None = None, strengths: tuple[float, ...] = STRENGTHS) -> dict:
    """Stage and infiltration heads on the next window where its label is valid; the strength is chosen by log-loss on ``val``."""
    heads = {}
    for name, target in (("stage", "target_stage"), ("infiltration", "target_infil")):
        rows = lambda d: _flat(d.filter(F.get("target_mask", F.lit(0)))).select("features", F.get(target, F.lit(0)).cast("int").alias("label"))  # noqa: E731, B023
        fitted = [fit_logistic(rows(train), "label", c) for c in (strengths if val is not None else strengths[:1])]
        if fitted[0] is None:
            heads[name] = None
        elif val is None:
            heads[name] = fitted[0]
        else:
            losses = [log_loss(m.transform(rows(val)), "label") for m in fitted]
            heads[name] = fitted[int(np.argmin(losses))]
    return heads


def predict_heads(samples: DataFrame, heads: dict) -> DataFrame:
    """Add stage_probs (one per stage), infiltration and the likeliest stage; without an infiltration head it is the mass of its stages."""
    rows = _flat(samples, "features")
    n = len(STAGES)
    if heads["stage"] is None:
        rows = rows.withColumn("stage_probs", F.array(*(F.lit(1.0 if k == 0 else 0.0) for k in range(n))))
    else:
        p = vector_to_array("p")
        rows = heads["stage"].transform(rows).withColumn("stage_probs", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.get(p, k), F.lit(0.0)))).drop("p", "q", "r")
    late = F.aggregate(F.slice("stage_probs", 3, n), F.lit(0.0), lambda a, x: a + x)
    if heads["infiltration"] is None:
        rows = rows.withColumn("infiltration", late)
    else:
        rows = heads["infiltration"].transform(rows).withColumn("infiltration", F.get(vector_to_array("p"), F.lit(1))).drop("p", "q", "r")
    best = F.array_position("stage_probs", F.array_max("stage_probs")).cast("int")
    return rows.drop("features").withColumn("stage", F.element_at(F.array(*map(F.lit, STAGES)), best))


def predict_next(samples: DataFrame, model: Dynamics, clamp: bool = False) -> DataFrame:
    """Add ``forecast``: the state of the window after the context."""
    columns = [f.name for f in samples.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(k, BATCH_ROWS)
                out = model.next_state(_matrix(part.column("context")), clamp)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(out), pa.list_(pa.float64()))], names=[*columns, "forecast"])

    schema = ", ".join(f"`{c}` {t}" for c, t in samples.dtypes)
    return samples.mapInArrow(run, f"{schema}, forecast array<double>")


def persistence(samples: DataFrame) -> DataFrame:
    return samples.withColumn("forecast", F.element_at("context", -1))


def rollout(contexts: DataFrame, horizon: int, step, heads=None, length: int | None = None) -> DataFrame:
    """(capture_id, window, step from 1, infiltration, stage, state): ``horizon`` windows ahead, each fed back as if seen.

    ``step`` adds forecast to samples, ``heads`` infiltration and stage; a context shorter than
    ``length`` is padded in front with its first window. Each step is a projection: no row meets another.
    """
    rows = contexts.select("capture_id", "window", "context")
    if length:
        pad = F.greatest(F.lit(0), F.lit(length) - F.size("context"))
        rows = rows.withColumn("context", F.slice(F.concat(F.array_repeat(F.get("context", F.lit(0)), pad), F.col("context")), -length, length))
    kept = ["capture_id", "window", "context"]
    done = []
    for k in range(1, horizon + 1):
        rows = step(heads(rows) if heads else rows.withColumn("infiltration", F.lit(0.0)).withColumn("stage", F.lit(STAGES[0])))
        done.append(F.struct(F.lit(k).alias("step"), F.col(f"_s{k}.infiltration").alias("infiltration"), F.col(f"_s{k}.stage").alias("stage"), F.col(f"_s{k}.state").alias("state")))
        shifted = F.concat(F.slice("context", 2, 1 << 30), F.array("forecast"))
        rows = rows.select("capture_id", "window", shifted.alias("context"), *(c for c in rows.columns if c.startswith("_s")), F.struct("infiltration", "stage", F.col("forecast").alias("state")).alias(f"_s{k}"))
    return rows.select(*kept[:2], F.inline(F.array(*done)))


def forecast_timeline(rolled: DataFrame, window_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a rollout with the start of their window, after the context's last, and per context the peak and its first step."""
    rows = rolled.withColumn("start_us", (F.col("window") + F.col("step")) * window_us)
    peak = rolled.groupBy("capture_id", "window").agg(F.max("infiltration").alias("peak"), F.max_by("step", F.struct("infiltration", -F.col("step"))).alias("peak_step"))
    return rows, peak


def logistic_baseline(train: DataFrame, horizon: int, mode: str = "context", c: float = 0.5) -> list:
    """A balanced stage and infiltration model for each step of the horizon, on the last window (static) or the whole context."""
    models = []
    for k in range(horizon):
        rows = baseline_features(train.filter(F.get("target_mask", F.lit(k))), mode)
        models.append(tuple(fit_logistic(rows.select("features", F.get(t, F.lit(k)).cast("int").alias("label")), "label", c) for t in ("target_stage", "target_infil")))
    return models


def baseline_features(samples: DataFrame, mode: str) -> DataFrame:
    if mode not in ("static", "context"):
        raise ValueError("mode is static or context")
    return samples.withColumn("features", array_to_vector(F.element_at("context", -1) if mode == "static" else F.flatten("context")))


def baseline_scores(samples: DataFrame, models: list, mode: str) -> DataFrame:
    """Add p<k>, the probability of infiltration at each step."""
    rows = baseline_features(samples, mode)
    for k, (stage, infil) in enumerate(models, 1):
        model = infil or stage
        if model is None:
            rows = rows.withColumn(f"p{k}", F.lit(0.0))
            continue
        p = vector_to_array("p")
        value = F.get(p, F.lit(1)) if infil else F.aggregate(F.slice(p, 3, len(STAGES)), F.lit(0.0), lambda a, x: a + x)
        rows = model.transform(rows).withColumn(f"p{k}", value).drop("p", "q", "r")
    return rows.drop("features")


# --- scores of onset samples: context (windows x features) and label ---------------------------------


def prior_score(samples: DataFrame) -> DataFrame:
    return samples.withColumn("score", F.lit(0.0))


def _benign_last(train: DataFrame) -> DataFrame:
    return train.filter("label = 0").select(F.element_at("context", -1).alias("x"))


def fit_mahalanobis(train: DataFrame) -> dict:
    """Mean, deviation and the inverse of the shrunk covariance (Ledoit and Wolf) of the last windows of negatives, from two passes of sums."""
    rows = _benign_last(train)
    one = rows.first()
    if one is None:
        raise ValueError("no negative samples")
    f = len(one.x)
    plain = gram(rows, f + 1, lambda b: np.concatenate([np.ones((b.num_rows, 1)), _matrix(b.column("x"))], axis=1))
    n, mean = plain[0, 0], plain[0, 1:] / plain[0, 0]
    scale = np.sqrt(np.maximum(np.diag(plain)[1:] / n - mean**2, 0)) + 1e-6

    def squares(b: pa.RecordBatch) -> np.ndarray:
        z = (_matrix(b.column("x")) - mean) / scale
        return np.concatenate([z, (z * z).sum(axis=1)[:, None]], axis=1)

    g = gram(rows, f + 1, squares)
    cov = g[:f, :f] / n
    level = np.trace(cov) / f
    spread = ((cov - level * np.eye(f)) ** 2).sum() / f
    noise = min(spread, (g[f, f] / n - (cov**2).sum()) / n / f)
    shrink = 0.0 if spread == 0 else noise / spread
    cov = (1 - shrink) * cov + shrink * level * np.eye(f)
    return {"mean": mean, "scale": scale, "precision": np.linalg.pinv(cov), "shrinkage": shrink}


def mahalanobis_score(samples: DataFrame, model: dict) -> DataFrame:
    """Add score: the squared distance of the last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                last = np.array([c[-1].as_py() for c in b.column("context")], float)
                z = (last - model["mean"]) / model["scale"]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(((z @ model["precision"]) * z).sum(axis=1))], names=[*b.schema.names, "score"])

    return samples.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in samples.dtypes) + ", score double")


TREES, TREE_ROWS = 200, 256


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def fit_isolation(train: DataFrame, trees: int = TREES, rows_a_tree: int = TREE_ROWS, seed: int = 0) -> DataFrame:
    """(tree, nodes binary): isolation trees, each grown in a group of its own on ``rows_a_tree`` rows, drawn without replacement; on all where there are no more.

    Rows are numbered in a written table, equal ones too; places are drawn on the driver, trees x
    ``rows_a_tree`` of them, and only the rows at those places meet the trees.
    """
    rows = materialised(_benign_last(train).withColumn("id", F.monotonically_increasing_id()), "rows")
    parts = rows.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a task
    ends = np.cumsum([r.n for r in parts])
    n = int(ends[-1]) if len(ends) else 0
    rng = np.random.default_rng(seed)
    drawn_at = []
    for tree in range(trees):
        places = rng.choice(n, min(rows_a_tree, n), replace=False) if n else np.zeros(0, np.int64)
        part = np.searchsorted(ends, places, side="right")
        first = np.array([int(parts[k].part) << 33 for k in part], np.int64)
        drawn_at.append(pd.DataFrame({"tree": tree, "id": first + places - np.r_[0, ends][part].astype(np.int64)}))
    places = train.sparkSession.createDataFrame(pd.concat(drawn_at), "tree int, id long")
    drawn = rows.join(F.broadcast(places), "id").withColumn("u", F.col("id"))  # trees x rows_a_tree pairs of numbers

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        part = group.sort_values("u")
        x = np.stack(part["x"].to_numpy())
        rng = np.random.default_rng([seed, int(group["tree"].iloc[0])])
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list[float]] = []  # feature or -1, cut, left, right, or depth with the rest of the path

        def split(at: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, float(depth + _harmonic(len(at)))])
            low, high = x[at].min(axis=0), x[at].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(at) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(low[f], high[f]))
                left = x[at, f] <= cut
                if left.any() and not left.all():
                    a, b = split(at[left], depth + 1), split(at[~left], depth + 1)
                    nodes[me] = [f, cut, a, b]
            return me

        split(np.arange(len(x)), 0)
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "n": [len(x)], "nodes": [np.array(nodes).tobytes()]})

    return drawn.groupBy("tree").applyInPandas(grow, "tree int, n int, nodes binary")


def isolation_score(samples: DataFrame, forest: DataFrame) -> DataFrame:
    """Add score, from 0 to 1: how soon trees isolate the last window. The forest has at most TREES rows of TREE_ROWS nodes each."""
    found = forest.collect()  # a row per tree
    trees = [(np.frombuffer(r.nodes).reshape(-1, 4), r.n) for r in found]
    norm = float(_harmonic(max((n for _, n in trees), default=2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            whole = b.column("context").to_pylist()
            x = np.array([c[-1] for c in whole])
            depth = np.zeros(len(x))
            for nodes, _ in trees:
                at = np.zeros(len(x), int)
                live = nodes[at, 0] >= 0
                while live.any():
                    row = nodes[at[live]]
                    left = x[live, row[:, 0].astype(int)] <= row[:, 1]
                    at[live] = np.where(left, row[:, 2], row[:, 3]).astype(int)
                    live = nodes[at, 0] >= 0
                depth += nodes[at, 3]
            score = 2.0 ** (-depth / max(len(trees), 1) / max(norm, 1e-9))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in samples.dtypes)
    return samples.mapInArrow(run, f"{schema}, score double")


def hazard_features(samples: DataFrame, profile: dict[str, list[float]]) -> DataFrame:
    """Add features: of the context relative to a network's profile (centre, scale), the last, smoothed, recent highest and slope of each feature, and how many stand out."""
    rel = lambda row: F.transform(F.arrays_zip(row.alias("x"), F.array(*map(F.lit, profile["centre"])).alias("c"), F.array(*map(F.lit, profile["scale"])).alias("s")), lambda t: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (t["x"] - t["c"]) / t["s"])))
    rows = samples.withColumn("_z", F.transform("context", rel))
    zero = F.transform(F.element_at("_z", 1), lambda x: x * 0.0)
    smooth = F.aggregate("_z", zero, lambda a, row: F.zip_with(a, row, lambda p, q: 0.5 * q + 0.5 * p))
    recent = F.slice("_z", F.greatest(F.size("_z") - 2, F.lit(1)), 3)
    top = F.aggregate(recent, F.element_at(recent, 1), lambda a, row: F.zip_with(a, row, lambda p, q: F.greatest(p, q)))
    last = F.element_at("_z", -1)
    back = F.element_at("_z", -F.least(F.lit(8), F.size("_z")))
    rows = rows.withColumns({"_last": last, "_smooth": smooth, "_top": top, "_slope": F.zip_with(last, back, lambda p, q: p - q)})
    far = lambda c: F.size(F.filter(c, lambda x: F.abs(x) > 3)).cast("double")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(c)
    every = F.concat("_last", "_smooth", "_top", "_slope", F.array(far("_last"), far("_smooth"), mean("_last"), mean(F.flatten("_z"))))
    return rows.withColumn("features", every).drop("_z", "_last", "_smooth", "_top", "_slope")


def fit_hazard(train: DataFrame, profile: dict[str, list[float]], rounds: int = 150, l2: float = 5.0) -> boosting.Boosted:
    """Gradient-boosted trees on balanced samples (label 0 or 1); both labels must be there."""
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        raise ValueError("hazard needs both labels")
    rows = hazard_features(train, profile).select("features", "label", _balanced("label", counts).alias("weight"))
    return boosting.fit(rows, rounds, l2=l2)


def hazard_score(samples: DataFrame, model: boosting.Boosted, profile: dict[str, list[float]]) -> DataFrame:
    return boosting.score(hazard_features(samples, profile), model).drop("features")


def calibrate(scored: DataFrame):
    """Isotonic map from score to the chance of label 1."""
    return IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="probability").fit(scored.select(F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label")))


def probability(scored: DataFrame, calibrator) -> DataFrame:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability")))
    return calibrator.transform(scored).withColumn("probability", clipped)


def save_table(table: DataFrame, path: str) -> None:
    """A profile or standardiser, a row per feature."""
    table.coalesce(1).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
