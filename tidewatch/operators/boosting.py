"""Gradient boosting on binned features: Spark sums gradient and curvature of every (node, feature, bin), and the best cuts come out of those sums.

Rows stay in the tasks as one byte a feature. A pass over them finds each row's margin from the trees
since margins were last written, its node in the tree that grows, and adds up a histogram for each
node; histograms of blocks of features meet in groups of their own, which return one cut a node.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised

BINS, BLOCK, WRITE_EVERY, PART_BYTES, PART_ROWS = 255, 16, 16, 32 << 20, 8192
LEAST_CURVATURE = 1e-3


class Boosted:
    """Base margin, the bin edges of each feature (a value's bin is the number of edges below it), and trees as arrays: feature (-1: leaf), bin, left, right, value. A row goes left where its bin is at most the node's."""

    def __init__(self, base: float, edges: list[np.ndarray], trees: list[np.ndarray] | None = None):
        self.base, self.edges, self.trees = base, edges, trees or []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def margin(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[since:]:
            out += tree[leaves(tree, bins), 4]
        return out

    def to_json(self) -> str:
        return json.dumps({"base": self.base, "edges": [e.tolist() for e in self.edges], "trees": [t.tolist() for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        return cls(d["base"], [np.array(e, float) for e in d["edges"]], [np.array(t, float).reshape(-1, 5) for t in d["trees"]])


def leaves(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    own = np.arange(len(tree))
    leaf = tree[:, 0] < 0
    feature, cut = np.where(leaf, 0, tree[:, 0]).astype(int), tree[:, 1]
    left, right = (np.where(leaf, own, tree[:, k]).astype(int) for k in (2, 3))
    at, first = np.zeros(len(bins), int), np.arange(len(bins)) * bins.shape[1]
    flat = bins.ravel()
    while not leaf[at].all():  # rows at a leaf stay there
        at = np.where(flat[first + feature[at]] <= cut[at], left[at], right[at])
    return at


def bin_edges(rows: DataFrame, features: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 edges of each feature, values of the table at even ranks (approximate on large ones), its largest left out. One row a feature comes to the driver."""
    ranks = F.lit([k / (bins - 1) for k in range(bins)])
    found = rows.select(F.posexplode(features).alias("k", "x")).groupBy("k").agg(F.percentile_approx("x", ranks, 10_000).alias("e")).orderBy("k").collect()
    return [np.unique(np.array(r.e, float))[:-1] for r in found]


def best_cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least_rows: int) -> list[tuple]:
    """For each node of histograms (nodes x features x bins): (gain, feature, bin, gradient and curvature left, gradient and curvature of the node); gain is 0 without a cut. Of equal gains, up to rounding, the first feature and bin count."""
    gl, hl, nl = (np.cumsum(a, axis=2) for a in (g, h, n))
    total = [a[:, :1, -1:] for a in (gl, hl, nl)]
    gr, hr, nr = (t - a for t, a in zip(total, (gl, hl, nl)))
    fine = (nl >= least_rows) & (nr >= least_rows) & (hl >= LEAST_CURVATURE) & (hr >= LEAST_CURVATURE)
    gain = np.where(fine, gl**2 / (hl + l2) + gr**2 / (hr + l2) - total[0] ** 2 / (total[1] + l2), 0.0)
    out = []
    for k in range(len(g)):
        flat = gain[k].ravel()
        top = float(flat.max(initial=0.0))
        at = int(np.argmax(flat >= top * (1 - 1e-9))) if top > 0 else 0
        f, b = divmod(at, g.shape[2])
        out.append((top, f, b, float(gl[k, f, b]), float(hl[k, f, b]), float(total[0][k, 0, 0]), float(total[1][k, 0, 0])))
    return out


def _level(data: DataFrame, model: Boosted, since: int, tree: np.ndarray, nodes: list[int], l2: float, least_rows: int) -> dict[int, tuple]:
    """The best cut of each of ``nodes`` in the tree that grows: one job."""
    width, n_bins = len(model.edges), max(map(len, model.edges)) + 1
    place = {node: k for k, node in enumerate(nodes)}
    blocks = -(-width // BLOCK)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(nodes), width, n_bins))
        for b in batches:
            if not b.num_rows:
                continue
            bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, width)
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            p = 1 / (1 + np.exp(-(b.column("margin").to_numpy(zero_copy_only=False) + model.margin(bins, since))))
            at = leaves(tree, bins)
            where = np.full(len(tree), -1)
            where[nodes] = range(len(nodes))
            node = where[at]
            live = node >= 0
            here, columns = node[live] * n_bins, np.ascontiguousarray(bins[live].T)
            for k, v in enumerate((w * (p - y), w * p * (1 - p), np.ones(len(y)))):
                v = v[live]
                for f in range(width):
                    total[k, :, f] += np.bincount(here + columns[f], v, len(nodes) * n_bins).reshape(len(nodes), n_bins)
        if total[2].any():
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([np.ascontiguousarray(total[:, :, k * BLOCK : (k + 1) * BLOCK]).tobytes() for k in range(blocks)], pa.binary())], names=["block", "sums"])

    def cuts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        here = min(BLOCK, width - block * BLOCK)
        total = np.zeros((3, len(nodes), here, n_bins))
        for b in batches:
            for part in b.column("sums"):
                total += np.frombuffer(part.as_buffer()).reshape(total.shape)
        rows = [(nodes[k], block * BLOCK + f, float(bin_), gain, gl, hl, g, h) for k, (gain, f, bin_, gl, hl, g, h) in enumerate(best_cuts(*total, l2, least_rows))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["node", "feature", "bin", "gain", "gl", "hl", "g", "h"])

    found = data.mapInArrow(sums, "block int, sums binary").groupBy("block").applyInArrow(cuts, "node long, feature long, bin double, gain double, gl double, hl double, g double, h double").collect()  # a row per block of features and node
    best: dict[int, tuple] = {}
    for r in sorted(found, key=lambda r: (r.node, r.feature)):
        if r.node in place and (r.node not in best or r.gain > best[r.node].gain * (1 + 1e-9)):
            best[r.node] = r
    return best


def fit(rows: DataFrame, rounds: int = 150, depth: int = 3, rate: float = 0.05, l2: float = 5.0, least_rows: int = 20, bins: int = BINS, features: str = "features", label: str = "label", weight: str = "weight") -> Boosted:
    """Trees for the chance of label 1, from rows with an array of ``features``, a ``label`` of 0 or 1 and a ``weight``.

    A leaf is -rate * G / (H + l2), a cut is made where it gains and leaves ``least_rows`` rows on
    both sides. Without rows there is no tree. Only edges, cuts and leaves come to the driver.
    """
    edges = bin_edges(rows, features, bins)
    shares = rows.agg(F.sum(F.col(label) * F.col(weight)), F.sum(weight)).first()
    mean = min(max((shares[0] or 0.0) / shares[1], 1e-9), 1 - 1e-9) if shares[1] else 0.5
    model = Boosted(float(np.log(mean / (1 - mean))), edges)
    if not edges:
        return model

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            made = model.bins(x) if b.num_rows else np.zeros((0, len(edges)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in made], pa.binary()), b.column("y"), b.column("w"), pa.array(np.full(b.num_rows, model.base))], names=["bins", "y", "w", "margin"])

    schema = "bins binary, y double, w double, margin double"
    chosen = rows.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    # a pass is dealt to all cores as soon as a part has PART_ROWS; more parts than that only where they grow large
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(min(count // PART_ROWS, cores), count * (len(edges) + 24) // PART_BYTES, 1)
    data = materialised(chosen.mapInArrow(binned, schema).repartition(parts), "bins")
    since = 0
    for _ in range(rounds):
        tree, level = np.array([[-1.0, 0, 0, 0, 0]]), [0]
        for _ in range(depth):
            best = _level(data, model, since, tree, level, l2, least_rows)
            following = []
            for node in level:
                r = best.get(node)
                if r is None:
                    continue
                tree[node, 4] = -rate * r.g / (r.h + l2)
                if r.gain > 0:
                    a = len(tree)
                    tree[node, :4] = r.feature, r.bin, a, a + 1
                    sides = ((r.gl, r.hl), (r.g - r.gl, r.h - r.hl))
                    tree = np.concatenate([tree, [[-1.0, 0, 0, 0, -rate * g / (h + l2)] for g, h in sides]])
                    following += [a, a + 1]
            level = following
            if not level:
                break
        if tree[0, 0] < 0:
            break  # nothing gains any more
        model.trees.append(tree)
        if len(model.trees) - since == WRITE_EVERY:
            data, since = materialised(_advanced(data, model, since, schema), "margins"), len(model.trees)
    return model


def _advanced(data: DataFrame, model: Boosted, since: int, schema: str) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            margin = b.column("margin").to_numpy(zero_copy_only=False) + (model.margin(bins, since) if b.num_rows else 0)
            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), b.column("w"), pa.array(margin)], names=["bins", "y", "w", "margin"])

    return data.mapInArrow(add, schema)


def score(rows: DataFrame, model: Boosted, features: str = "features", name: str = "score") -> DataFrame:
    """Add the chance of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins = model.bins(b.column(features).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            p = 1 / (1 + np.exp(-(model.base + model.margin(bins))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{name}` double")
