"""Gaussian processes through landmarks, and regression quantiles: models of which only sums reach the driver.

A process over n rows needs an n x n matrix.  Through m landmarks (rows of the smallest hashes, m a parameter) it needs the sums of k k' and k y over the training rows, k being a row's kernel values
to the landmarks: every task folds m x m numbers.  With all rows as landmarks it is the exact process.  Predictions are a pass with the landmarks and two
factors in each task; the variance has what the landmarks explain, what they can't, and the noise (the deterministic training conditional with its own diagonal).

Rows without a vector, or with components that are null or not finite, take no part; nor do training rows without a target. An empty training table predicts null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import _cut
from .distances import _matrix, _vectors, _whole

#: Added to the landmarks' kernel matrix before it is factored, relative to its diagonal.
JITTER = 1e-8


def gaussian(width: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
        return np.exp(-d / (2 * width * width))

    return k


def tanimoto(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.b / (a.a + b.b - a.b), for bits the share of common ones; 1 for two empty vectors."""
    dot = a @ b.T
    whole = (a * a).sum(1)[:, None] + (b * b).sum(1) - dot
    return np.where(whole > 0, dot / np.where(whole > 0, whole, 1), 1.0)


@dataclass
class Process:
    """landmarks, mean of the targets, and the factors of the predictive mean and variance."""

    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    landmarks: np.ndarray
    mean: float
    weights: np.ndarray
    own: np.ndarray
    posterior: np.ndarray
    noise: float

    def predict(self, df: DataFrame, idx: str, vec: str) -> DataFrame:
        """idx, prediction, sd (of a new measurement)."""
        rows = _vectors(df, idx, vec)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    part = b.slice(s, 1024)
                    x = _matrix(pa.chunked_array([part.column("x")]))
                    k = self.kernel(x, self.landmarks)
                    prior = np.array([self.kernel(r[None], r[None])[0, 0] for r in x])
                    left = prior - ((np.linalg.solve(self.own, k.T)) ** 2).sum(0)
                    var = np.maximum(left, 0) + ((np.linalg.solve(self.posterior, k.T)) ** 2).sum(0) * self.noise + self.noise
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(self.mean + k @ self.weights), pa.array(np.sqrt(var))], ["id", "prediction", "sd"])

        return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, prediction double, sd double").withColumnRenamed("id", idx)


def process(train: DataFrame, idx: str, vec: str, target: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] = tanimoto, noise: float = 0.1, landmarks: int = 512, seed: int = 0) -> Process:
    """The process that the training rows teach. noise: the variance of a measurement; landmarks: rows at most, which bounds what a task and the driver hold."""
    rows = train.where(_whole(vec) & F.col(target).isNotNull()).select(F.col(idx).alias("id"), F.col(vec).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    marks = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "x")).orderBy("h", "id").limit(landmarks).select("x").toArrow()
    z = np.unique(_matrix(marks.column("x")), axis=0)
    if not len(z):
        raise ValueError("no training rows")
    mean = float(rows.agg(F.avg("y")).first()[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(z), len(z) + 1))
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                k = kernel(_matrix(pa.chunked_array([part.column("x")])), z)
                total += k.T @ np.hstack([k, np.asarray(part.column("y"))[:, None] - mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    got = rows.select("x", "y").mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    total = got.column("v").to_numpy().reshape(len(z), -1)
    own = kernel(z, z)
    own = np.linalg.cholesky(own + JITTER * np.trace(own) / len(z) * np.eye(len(z)))
    # noise K + sum k k': the posterior's factor.
    posterior = np.linalg.cholesky(noise * own @ own.T + total[:, :-1])
    weights = np.linalg.solve(posterior.T, np.linalg.solve(posterior, total[:, -1]))
    return Process(kernel, z, mean, weights, own, posterior, noise)


#: Rows of a block of doubles that the rounds read.
PACKED = 1 << 14


def quantile_regression(train: DataFrame, vec: str, target: str, q: float, rounds: int = 60, tolerance: float = 1e-7) -> np.ndarray:
    """Intercept and coefficients of the linear q-quantile of the target."""
    return quantile_regressions(train, vec, target, [q], rounds, tolerance)[0]


def quantile_regressions(train: DataFrame, vec: str, target: str, qs: list[float], rounds: int = 60, tolerance: float = 1e-7) -> list[np.ndarray]:
    """Intercept and coefficients of some linear quantiles of the target, by reweighted least squares.

    The pinball loss of a residual r is its square times w = (q or 1 - q, by the sign) / |r|; a round takes the weights from the last coefficients and solves for new ones from one pass of sums
    (p + 1)^2 numbers a task and quantile.  Residuals count as `floor` at least, which falls with the rounds, so the rounds end near the minimum.  The table is read once, and written as blocks of
    doubles that the rounds read; a round is for all quantiles that haven't ended.
    """
    rows = train.where(_whole(vec) & F.col(target).isNotNull()).select(F.col(vec).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, PACKED):
                part = b.slice(s, PACKED)
                x = _matrix(pa.chunked_array([part.column("x")]))
                z = np.hstack([np.ones((len(x), 1)), x, np.asarray(part.column("y"))[:, None]])
                # A column after the other: products of whole columns.
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([np.ascontiguousarray(z.T).astype("<f8").tobytes()], pa.binary())], ["n", "z"])

    packed = _cut(rows.mapInArrow(pack, "n int, z binary"))

    def sums(at: dict[int, tuple[np.ndarray | None, float]]) -> dict[int, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for b in batches:
                for n, block in zip(b.column("n").to_pylist(), b.column("z"), strict=True):
                    z = np.frombuffer(block.as_buffer(), "<f8").reshape(-1, n)
                    for k, (beta, floor) in at.items():
                        r = z[-1] - beta @ z[:-1] if beta is not None else np.ones(n)
                        w = np.where(r > 0, qs[k], 1 - qs[k]) / np.maximum(np.abs(r), floor)
                        part = (z * w) @ z.T
                        total[k] = total[k] + part if k in total else part
            for k, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, k, np.int32)), pa.array(np.arange(v.size)), pa.array(v.ravel())], ["k", "i", "v"])

        got = packed.mapInArrow(work, "k int, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow().sort_by([("k", "ascending"), ("i", "ascending")])
        key, v = got.column("k").to_numpy(), got.column("v").to_numpy()
        return {k: (own := v[key == k]).reshape(round(len(own) ** 0.5), -1) for k in at if (key == k).any()}

    at: dict[int, tuple[np.ndarray | None, float]] = {k: (None, 1.0) for k in range(len(qs))}
    out: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        if not at:
            break
        totals = sums(at)
        if not totals:
            raise ValueError("no training rows")
        for k, total in totals.items():
            beta, floor = at[k]
            out[k] = new = np.linalg.lstsq(total[:-1, :-1], total[:-1, -1], rcond=None)[0]
            if beta is None:
                at[k] = new, 1e-2 * float(np.sqrt(max(total[-1, -1], 1e-300) / max(total[0, 0], 1e-300)))
            elif np.abs(new - beta).max() <= tolerance * max(1.0, np.abs(new).max()):
                del at[k]
            else:
                at[k] = new, max(floor * 0.7, 1e-9)
    return [out[k] for k in range(len(qs))]


def quantile_interval(train: DataFrame, df: DataFrame, idx: str, vec: str, target: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """idx, lower, upper, width: the quantiles of the target that two regressions predict, in order."""
    ends = quantile_regressions(train, vec, target, [low, high])
    terms = lambda beta: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in beta[1:]]), lambda v, b: v * b), F.lit(float(beta[0])), lambda s, v: s + v)
    d = _vectors(df, idx, vec).select(F.col("id").alias(idx), terms(ends[0]).alias("a"), terms(ends[1]).alias("b"))
    return d.select(idx, F.least("a", "b").alias("lower"), F.greatest("a", "b").alias("upper"), F.abs(F.col("b") - F.col("a")).alias("width"))
