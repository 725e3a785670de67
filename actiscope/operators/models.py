"""Models beyond linear ones: tree ensembles, margins and networks by Spark's own learners, partial least squares from one pass of sums; search and scoring.

Every learner takes a table with an id, a vector column (array of numbers) and a label, and gives idx and prediction (and a score for classes).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classification, distances, regression

REGRESSORS: dict[str, Callable[..., Any]] = {
    "forest": lambda **o: R.RandomForestRegressor(**{"numTrees": 50, "seed": 0} | o), "boosted": lambda **o: R.GBTRegressor(**{"maxIter": 20, "seed": 0} | o),
    "tree": lambda **o: R.DecisionTreeRegressor(**{"seed": 0} | o), "linear": lambda **o: R.LinearRegression(**o),
}
CLASSIFIERS: dict[str, Callable[..., Any]] = {
    "forest": lambda **o: C.RandomForestClassifier(**{"numTrees": 50, "seed": 0} | o), "boosted": lambda **o: C.GBTClassifier(**{"maxIter": 20, "seed": 0} | o),
    "margin": lambda **o: C.LinearSVC(**o), "logistic": lambda **o: C.LogisticRegression(**o), "network": lambda **o: C.MultilayerPerceptronClassifier(**{"seed": 0} | o),
}


def _ready(df: DataFrame, vec: str) -> DataFrame:
    return df.where(distances._whole(vec)).withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


class Fitted:
    """A fitted learner: predict(df, idx) gives idx, prediction and, for classes, score (of class 1)."""

    def __init__(self, model: Any, vec: str, classes: bool):
        self.model, self.vec, self.classes = model, vec, classes

    def predict(self, df: DataFrame, idx: str) -> DataFrame:
        out = self.model.transform(_ready(df, self.vec))
        if not self.classes:
            return out.select(idx, "prediction")
        found = F.col("probability") if "probability" in out.columns else F.col("rawPrediction")
        score = vector_to_array(found)[1]
        return out.select(idx, "prediction", (score if "probability" in out.columns else 1 / (1 + F.exp(-score))).alias("score"))

    def spread(self, df: DataFrame, idx: str) -> DataFrame:
        """idx, mean, sd over the trees of an ensemble: each tree is a column, no row is repeated."""
        d = _ready(df, self.vec)
        names = []
        for i, tree in enumerate(self.model.trees):
            tree.setPredictionCol(f"p{i}")
            for extra in ("setProbabilityCol", "setRawPredictionCol"):
                if hasattr(tree, extra):
                    getattr(tree, extra)("")
            d = tree.transform(d)
            names.append(f"p{i}")
        values = F.array(*names)
        mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / len(names)
        d = d.select(idx, mean.alias("mean"), values.alias("v"))
        return d.select(idx, "mean", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / len(names)).alias("sd"))


def fitted(train: DataFrame, vec: str, label: str, kind: str = "forest", classes: bool = False, **options: Any) -> Fitted:
    table = CLASSIFIERS if classes else REGRESSORS
    if kind not in table:
        raise ValueError(f"no learner {kind}; there are {sorted(table)}")
    learner = table[kind](featuresCol="features", labelCol="l", **options)
    return Fitted(learner.fit(_ready(train.where(F.col(label).isNotNull()), vec).select("features", F.col(label).cast("double").alias("l"))), vec, classes)


class PartialLeastSquares:
    """One response, from sums of products: (p + 2)^2 numbers reach the driver, whatever the rows. Weights by deflation of the products."""

    def __init__(self, train: DataFrame, vec: str, label: str, parts: int = 2):
        x = F.transform(F.col(vec).cast("array<double>"), lambda v: v)
        both = train.where(distances._whole(vec) & F.col(label).isNotNull()).select(F.concat(x, F.array(F.col(label).cast("double"))).alias("z"))
        n, s, ss = distances.moments(both, "z")
        mean = s / n
        c = ss / n - np.outer(mean, mean)
        xx, xy = c[:-1, :-1].copy(), c[:-1, -1].copy()
        self.vec, self.mean, self.offset = vec, mean[:-1], mean[-1]
        w_all, p_all, q_all = [], [], []
        for _ in range(min(parts, len(xy))):
            size = np.linalg.norm(xy)
            if size < 1e-12:
                break
            w = xy / size
            t = float(w @ xx @ w)
            if t < 1e-15:
                break
            p, q = xx @ w / t, float(xy @ w) / t
            xx -= t * np.outer(p, p)
            xy = xy - t * q * p
            w_all.append(w)
            p_all.append(p)
            q_all.append(q)
        w, p, q = (np.array(v) for v in (w_all, p_all, q_all))
        self.parts = len(w_all)
        self.coefficients = w.T @ np.linalg.solve(p @ w.T, q) if self.parts else np.zeros(len(self.mean))

    def predict(self, df: DataFrame, idx: str) -> DataFrame:
        terms = F.zip_with(F.col(self.vec).cast("array<double>"), F.array(*[F.lit(float(b)) for b in self.coefficients]), lambda a, b: a * b)
        at_zero = float(self.offset - self.mean @ self.coefficients)
        return df.where(distances._whole(self.vec)).select(idx, F.aggregate(terms, F.lit(at_zero), lambda s, v: s + v).alias("prediction"))


#: Scorers: name -> (column of the one-row report, larger is better).
SCORERS = {
    "r2": ("r2", True), "rmse": ("rmse", False), "mae": ("mae", False), "mse": ("mse", False), "ccc": ("ccc", True), "median_ae": ("median_ae", False),
    "accuracy": ("accuracy", True), "f1": ("f1", True), "mcc": ("mcc", True), "balanced_accuracy": ("balanced_accuracy", True), "sensitivity": ("sensitivity", True), "specificity": ("specificity", True), "precision": ("precision", True),
}


def scored(predictions: DataFrame, label: str, names: list[str]) -> dict[str, float]:
    """Scores by name from one aggregate over prediction and label; an unknown name is an error."""
    unknown = [n for n in names if n not in SCORERS]
    if unknown:
        raise ValueError(f"no scorer {unknown[0]}; there are {sorted(SCORERS)}")
    d = predictions.select(F.col(label).cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))
    r = regression.report(d).first().asDict() if any(n in ("r2", "rmse", "mae", "mse", "ccc", "median_ae") for n in names) else {}
    if any(n not in r for n in names):
        t, p = F.col("y_true") > 0.5, F.col("y_pred") > 0.5
        tally = d.agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("tn", ~t & ~p), ("fn", t & ~p))])
        rates = classification.rates(*[F.col(n) for n in ("tp", "fp", "tn", "fn")])
        r |= tally.select(*[c.alias(k) for k, c in rates.items()]).first().asDict()
    return {n: r[SCORERS[n][0]] for n in names}


def _folds(df: DataFrame, idx: str, k: int, seed: int) -> DataFrame:
    return df.withColumn("m_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(idx).cast("string")), F.lit(k)))


def cross_validated(df: DataFrame, idx: str, vec: str, label: str, kind: str = "forest", classes: bool = False, folds: int = 5, names: tuple[str, ...] = ("r2",), seed: int = 0, **options: Any) -> list[dict[str, float]]:
    """Scores of each fold, by a hash of the id, of a learner that saw the other folds."""
    d, out = _folds(df, idx, folds, seed), []
    for i in range(folds):
        test = d.where(F.col("m_fold") == i)
        p = fitted(d.where(F.col("m_fold") != i), vec, label, kind, classes, **options).predict(test, idx)
        out.append(scored(p.join(test.select(idx, label), idx), label, list(names)))
    return out


def searched(df: DataFrame, idx: str, vec: str, label: str, grid: dict[str, list], kind: str = "forest", classes: bool = False, folds: int = 3, name: str = "r2", seed: int = 0) -> tuple[dict[str, Any], list[tuple[dict[str, Any], float]]]:
    """The best options of a grid by mean score over folds, ties to the earlier, and all with their scores."""
    better = SCORERS[name][1]
    tried = []
    for values in itertools.product(*grid.values()):
        options = dict(zip(grid, values, strict=True))
        found = [s[name] for s in cross_validated(df, idx, vec, label, kind, classes, folds, (name,), seed, **options)]
        tried.append((options, float(np.mean(found))))
    return (max if better else min)(tried, key=lambda t: t[1])[0], tried


def nested(df: DataFrame, idx: str, vec: str, label: str, grid: dict[str, list], kind: str = "forest", classes: bool = False, outer: int = 3, inner: int = 2, name: str = "r2", seed: int = 0) -> list[dict[str, Any]]:
    """For each outer fold: the options chosen within the others, and their score on it."""
    d, out = _folds(df, idx, outer, seed), []
    for i in range(outer):
        train, test = d.where(F.col("m_fold") != i).drop("m_fold"), d.where(F.col("m_fold") == i)
        best, _ = searched(train, idx, vec, label, grid, kind, classes, inner, name, seed + 1)
        p = fitted(train, vec, label, kind, classes, **best).predict(test, idx)
        out.append({"fold": i, "options": best, name: scored(p.join(test.select(idx, label), idx), label, [name])[name]})
    return out


def replaced(vec: str, component: int, value: Column) -> Column:
    """The vector with another value in one component."""
    return F.transform(F.col(vec).cast("array<double>"), lambda v, j: F.when(j == component, value.cast("double")).otherwise(v))


def permutation_importance(model: Any, df: DataFrame, idx: str, label: str, name: str = "r2", seed: int = 0) -> dict[int, float]:
    """What the score loses if one component's values are dealt to other rows: component -> loss.

    Values move along a ring of hashes of the id: the rows are ranked in ranges, and each takes the value of the row of the next rank.
    """
    from .ranking import ranked

    p = len(df.where(distances._whole(model.vec)).select(model.vec).first()[0])
    base = scored(model.predict(df, idx).join(df.select(idx, label), idx), label, [name])[name]
    d = ranked(df.where(distances._whole(model.vec)).withColumn("m_h", F.xxhash64(F.lit(seed), F.col(idx).cast("string"))), ["m_h", idx], "m_r")
    n = d.count()
    other = d.select((F.col("m_r") % n + 1).alias("o_r"), F.col(model.vec).alias("o_v"))
    both = d.join(other, F.col("m_r") == F.col("o_r"))
    sign = 1 if SCORERS[name][1] else -1
    out = {}
    for i in range(p):
        mixed = both.withColumn(model.vec, replaced(model.vec, i, F.element_at("o_v", i + 1)))
        out[i] = sign * (base - scored(model.predict(mixed, idx).join(df.select(idx, label), idx), label, [name])[name])
    return out


def partial_dependence(model: Any, df: DataFrame, idx: str, component: int, grid: list[float]) -> list[tuple[float, float]]:
    """(value, mean prediction if every row had it)."""
    out = []
    for value in grid:
        fixed = df.withColumn(model.vec, replaced(model.vec, component, F.lit(float(value))))
        out.append((float(value), model.predict(fixed, idx).agg(F.avg("prediction")).first()[0]))
    return out


def additive_shares(model: PartialLeastSquares, df: DataFrame, idx: str) -> DataFrame:
    """idx, base, shares: what each component adds to a linear prediction beside the training mean; they sum up to it exactly (Shapley values)."""
    pair = F.zip_with(F.col(model.vec).cast("array<double>"), F.array(*[F.lit(float(m)) for m in model.mean]), lambda v, m: v - m)
    shares = F.zip_with(pair, F.array(*[F.lit(float(b)) for b in model.coefficients]), lambda v, b: v * b)
    return df.where(distances._whole(model.vec)).select(idx, F.lit(float(model.offset)).alias("base"), shares.alias("shares"))


def local_weights(predict: Callable[[np.ndarray], np.ndarray], x: np.ndarray, spread: np.ndarray, samples: int = 500, width: float = 0.75, seed: int = 0) -> np.ndarray:
    """Weights of a linear model of the prediction around one row, fitted on samples weighted by nearness (in standard deviations)."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((samples, len(x)))
    weight = np.exp(-(z * z).sum(1) / (2 * (width * np.sqrt(len(x))) ** 2))
    a = np.hstack([np.ones((samples, 1)), z])
    left = a.T * weight
    return np.linalg.solve(left @ a + 1e-6 * np.eye(a.shape[1]), left @ predict(x + z * spread))[1:]


def counterfactuals(df: DataFrame, idx: str, vec: str, prediction: str, least: float) -> DataFrame:
    """idx, other, distance: for each row the nearest one whose prediction differs by `least` or more; ties to the smaller id.

    The rows are compared in pairs: meant for the rows that are to be explained, against a table of bounded size.
    """
    side = lambda p: df.select(F.col(idx).alias(f"{p}_id"), F.col(vec).cast("array<double>").alias(f"{p}_x"), F.col(prediction).alias(f"{p}_p"))
    j = side("a").join(side("b"), F.abs(F.col("a_p") - F.col("b_p")) >= least)
    d = F.sqrt(F.aggregate(F.zip_with("a_x", "b_x", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    best = j.groupBy(F.col("a_id").alias(idx)).agg(F.min(F.struct(d.alias("distance"), F.col("b_id").alias("other"))).alias("m"))
    return best.select(idx, "m.other", "m.distance")


def consensus(parts: list[DataFrame], idx: str, weights: list[float] | None = None) -> DataFrame:
    """idx, prediction: the weighted mean of predictions of several models for the rows that all have."""
    weights = weights or [1.0] * len(parts)
    out = parts[0].select(idx, (F.col("prediction") * weights[0]).alias("prediction"))
    for p, w in zip(parts[1:], weights[1:], strict=True):
        out = out.join(p.select(idx, (F.col("prediction") * w).alias("m_p")), idx).select(idx, (F.col("prediction") + F.col("m_p")).alias("prediction"))
    return out.select(idx, (F.col("prediction") / sum(weights)).alias("prediction"))


FORMAT = 1


def saved(model: Fitted, path: str, metadata: dict[str, Any] | None = None) -> None:
    """Writes a learner and a bundle of what is known of it into a shared folder."""
    spark = model_session()
    model.model.write().overwrite().save(f"{path}/model")
    about = {"format": FORMAT, "learner": type(model.model).__name__, "module": type(model.model).__module__, "vector": model.vec, "classes": model.classes, "spark": spark.version, "metadata": metadata or {}}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def inspected(path: str) -> dict[str, Any]:
    """What is known of a saved learner, without loading it."""
    found = json.loads(model_session().read.text(f"{path}/about").first()[0])
    if found["format"] > FORMAT:
        raise ValueError(f"the bundle has format {found['format']}, this reads up to {FORMAT}")
    return found


def loaded(path: str) -> Fitted:
    about = inspected(path)
    kinds = {name: getattr(m, name) for m in (R, C) for name in dir(m) if name.endswith("Model") and not name.startswith("_")}
    return Fitted(kinds[about["learner"]].load(f"{path}/model"), about["vector"], about["classes"])


def model_session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
