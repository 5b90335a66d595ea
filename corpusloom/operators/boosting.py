"""Gradient-boosted trees by histograms, for training sets that fit one task; larger ones go to MLlib's trees.

MLlib runs a job for each level of each tree: hundreds of rounds over a few thousand rows are nearly all scheduling. Here
the rounds run in one task over binned values. A tree is grown level by level, all its nodes at once: gradients and
second derivatives are added up by node, feature and bin, and each node takes the split with the most gain.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are fitted in one task (50,000 of 64 features take some 100 MB).
IN_ONE_TASK = 50_000
BINS = 64


class Boosted:
    """Trees of one depth as arrays: for each inner node a feature and the value up to which rows go left; leaf values."""

    def __init__(self, feature: np.ndarray, upto: np.ndarray, leaf: np.ndarray, base: float, gain: np.ndarray):
        self.feature, self.upto, self.leaf, self.base, self.gain = feature, upto, leaf, base, gain

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, upto, leaf in zip(self.feature, self.upto, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > upto[node])
            out += leaf[node - len(feature)]
        return out

    def importances(self) -> np.ndarray:
        total = self.gain.sum()
        return self.gain / total if total else self.gain

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with p_ai and y_pred by the array column x."""
        model = rows.sparkSession.sparkContext.broadcast(self)  # the size of its trees, whatever the rows

        def go(batches):
            for b in batches:
                n = b.num_rows
                x = np.array([np.asarray(v, float) for v in b.column("x").to_pylist()]).reshape(n, -1) if n else np.zeros((0, 1))
                p = 1 / (1 + np.exp(-model.value.margin(x))) if n else np.zeros(0)
                yield b.append_column("p_ai", pa.array(p)).append_column("y_pred", pa.array((p >= 0.5).astype(np.int32)))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(go, f"{fields}, p_ai double, y_pred int")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(bytearray(pickle.dumps(self.__dict__)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Boosted:
    """A model as its save() wrote it."""
    return Boosted(**pickle.loads(bytes(spark.read.parquet(path).first()["model"])))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, rounds: int = 400, depth: int = 6, step: float = 0.1, subsample: float = 0.9, seed: int = 42, least: float = 1.0) -> Boosted:
    """Trees for log-loss, with second derivatives and an L2 term of 1; `least`: weight of second derivatives on each side."""
    n, width = x.shape
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    cell = bins + np.arange(width) * BINS
    last = np.zeros((width, BINS), bool)
    for j, e in enumerate(edges):
        last[j, len(e) :] = True  # nothing lies above the last bin: no split there
    p0 = min(max((y * weight).sum() / weight.sum(), 1e-6), 1 - 1e-6)
    base = float(np.log(p0 / (1 - p0)))
    margin, inner = np.full(n, base), (1 << depth) - 1
    feature, upto, leaf, gains = np.zeros((rounds, inner), np.int32), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1)), np.zeros(width)
    rows = np.arange(n)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        used = weight * (rng.random(n) < subsample)
        g, h = (p - y) * used, p * (1 - p) * used
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            at = ((node - first) * (width * BINS))[:, None] + cell
            hist = [np.bincount(at.ravel(), np.repeat(v, width), k * width * BINS).reshape(k, width, BINS) for v in (g, h)]
            gl, hl = (a.cumsum(2) for a in hist)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gt**2 / (ht + 1)
            gain[(hl < least) | (hr < least) | last[None]] = 0
            flat = gain.reshape(k, -1)
            best = flat.argmax(1)
            won = flat[np.arange(k), best]
            f, b = np.divmod(best, BINS)
            here = slice(first, first + k)
            feature[t, here] = f
            cut = np.array([edges[j][i] if w > 0 else np.inf for j, i, w in zip(f, b, won, strict=True)])  # without gain all rows go left
            upto[t, here] = cut
            np.add.at(gains, f, won)
            node = 2 * node + 1 + (x[rows, feature[t, node]] > upto[t, node])
        at = node - inner
        leaf[t] = -step * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        margin += leaf[t][at]
    return Boosted(feature, upto, leaf, base, gains)


def fit(rows: DataFrame, seed: int = 42, **settings) -> Boosted:
    """rows: x (array), y (0 or 1), weight; at most IN_ONE_TASK of them. Ties between rows don't matter: they are sorted first."""

    def run(batches):
        parts = [(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("weight").to_pylist()) for b in batches]
        x = np.array([v for p in parts for v in p[0]], float)
        if len(x):
            y, w = (np.array([v for p in parts for v in p[i]], float) for i in (1, 2))
            order = np.lexsort((y, *x.T[::-1]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grow(x[order], y[order], w[order], seed=seed, **settings).__dict__)], pa.binary())], ["model"])

    one = rows.select(F.col("x").cast("array<double>").alias("x"), "y", F.col("weight").cast("double").alias("weight")).repartition(1).mapInArrow(run, "model binary").collect()
    if not one:
        raise ValueError("no rows to fit")
    return Boosted(**pickle.loads(bytes(one[0]["model"])))
