"""Linear models from sums: a table is read once for its cross products, by fold or resample, and the small systems are solved on the driver.

p features make (p + 1)(p + 2) / 2 sums a group, in one aggregate with partial sums; nothing else leaves the executors.  The products are of centred
columns, so that large means cost no digits.  Rows with a null in the response or a feature take no part in a fit and get a null prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .clustering import _cut
from .ranking import ranked

#: Rows of all iterations that are scrambled in a pass (an iteration at least), and the setting by which exchanged rows are deleted after it.
SCRAMBLED = 1 << 24
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Resamples of a bootstrap share one pass: the count of a row in a resample follows Poisson(1), cut where the tail is below 2^-32.
POISSON = 12


@dataclass(frozen=True)
class Linear:
    """intercept + sum of coefficients times features."""

    intercept: float
    coefficients: tuple[float, ...]

    def predict(self, features: list[str]) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(features, self.coefficients, strict=True):
            out = out + F.col(f).cast("double") * F.lit(c)
        return out


@dataclass(frozen=True)
class Sums:
    """Weight, sums and cross products of the centred (response, features) of some rows."""

    n: float
    s: np.ndarray
    c: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.s - other.s, self.c - other.c)

    def solve(self, centre: np.ndarray, alpha: float) -> Linear:
        """Ridge with an unpenalised intercept; the shortest solution where the features are dependent."""
        if self.n <= 0:
            return Linear(float("nan"), (float("nan"),) * (len(centre) - 1))
        m = self.s / self.n
        c = self.c - self.n * np.outer(m, m)
        b = np.linalg.lstsq(c[1:, 1:] + alpha * np.eye(len(m) - 1), c[1:, 0], rcond=1e-12)[0] if len(m) > 1 else np.zeros(0)
        at = m + centre
        return Linear(float(at[0] - b @ at[1:]), tuple(float(x) for x in b))


def _whole(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(F.forall(F.array(*[F.col(n).cast("double") for n in names]), lambda x: x.isNotNull() & ~F.isnan(x)))


def _centre(df: DataFrame, names: list[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(n).cast("double")) for n in names]).first()
    return np.array([v or 0.0 for v in row], float)


def _sums(df: DataFrame, names: list[str], centre: np.ndarray, group: Column, weight: Column | None = None) -> dict[int, Sums]:
    """The sums of each group: as many rows as groups reach the driver."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.col(n).cast("double") - F.lit(float(c)) for n, c in zip(names, centre, strict=True)]
    p = len(names)
    at = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.groupBy(group.alias("l_group")).agg(F.sum(w), *[F.sum(w * v) for v in x], *[F.sum(w * x[i] * x[j]) for i, j in at]).collect()
    out = {}
    for r in rows:
        c = np.zeros((p, p))
        for (i, j), v in zip(at, r[2 + p :], strict=True):
            c[i, j] = c[j, i] = v
        out[r[0]] = Sums(r[1], np.array(r[2 : 2 + p], float), c)
    return out


def fit(df: DataFrame, y: str, features: list[str], alpha: float = 0.0) -> Linear:
    """Least squares, or ridge with a penalty."""
    names = [y, *features]
    d = _whole(df, names)
    centre = _centre(d, names)
    return _sums(d, names, centre, F.lit(0)).get(0, Sums(0, centre, centre)).solve(centre, alpha)


def _by_group(models: dict, features: list[str], group: Column) -> Column:
    """The prediction of each row by its group's model, null for a group without one."""
    keys = sorted(models)
    if not keys:
        return F.lit(None).cast("double")
    table = F.create_map(*[x for k in keys for x in (F.lit(k), F.array(F.lit(models[k].intercept), *[F.lit(c) for c in models[k].coefficients]))])
    own = F.try_element_at(table, group)
    out = own[0]
    for i, f in enumerate(features, 1):
        out = out + F.col(f).cast("double") * own[i]
    return out


def cross_validated(df: DataFrame, y: str, features: list[str], fold: str, alpha: float = 0.0) -> DataFrame:
    """The rows with y_pred, predicted from the other folds: one pass for all folds, as training sums are those of the table less the fold's own.

    Folds are a bounded number of integers (k folds, or numbered groups); rows without a fold are in none and aren't predicted.
    """
    names = [y, *features]
    d = _whole(df, names).where(F.col(fold).isNotNull())
    centre = _centre(d, names)
    per = _sums(d, names, centre, F.col(fold))
    total = Sums(sum(s.n for s in per.values()), sum((s.s for s in per.values()), np.zeros(len(names))), sum((s.c for s in per.values()), np.zeros((len(names),) * 2)))
    models = {k: (total - s).solve(centre, alpha) for k, s in per.items()} if len(per) > 1 else {}
    return df.withColumn("y_pred", _by_group(models, features, F.col(fold)))


def validation_scores(df: DataFrame, y: str, pred: str = "y_pred") -> DataFrame:
    """n, q2, rmse_cv, mae_cv of pooled predictions."""
    e = F.col(pred) - F.col(y)
    a = df.where(e.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("press"), F.avg(F.abs(e)).alias("mae_cv"), F.var_pop(y).alias("v"))
    return a.select("n", (1 - ratio(F.col("press"), F.col("v") * F.col("n"))).alias("q2"), F.sqrt(F.col("press") / F.col("n")).alias("rmse_cv"), "mae_cv")


def _uniform(seed: Column, idx: str) -> Column:
    """A number in [0, 1) from a hash of seed and id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.col(idx).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _poisson(u: Column) -> Column:
    """The count that a uniform number stands for."""
    total, term, below = F.lit(0), float(np.exp(-1.0)), 0.0
    for k in range(POISSON):
        below += term
        total = total + (u >= F.lit(below)).cast("int")
        term /= k + 1
    return total


def _dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores, as each makes many: a table of few bytes is read as one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def bootstrap(df: DataFrame, y: str, features: list[str], idx: str, iterations: int = 100, alpha: float = 0.0) -> DataFrame:
    """iteration, n_out, r2: each resample's model on the rows that it left out; iterations with fewer than two such rows are skipped.

    One pass for all iterations: rows meet each iteration within their task, only the sums of what a resample took and left are shuffled, and the errors on the latter follow from them.
    """
    names = [y, *features]
    d = _dealt(_whole(df, names).select(F.col(idx).cast("string").alias("b_i"), *names))
    centre = _centre(d, names)
    # A hash and a count are taken once, or the optimiser would write them into every comparison and sum.
    each = d.withColumn("b_it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("b_u", F.explode(F.array(_uniform(F.col("b_it"), "b_i")))).withColumn("b_w", F.explode(F.array(_poisson(F.col("b_u")))))
    sums = _sums(each, names, centre, F.col("b_it") * 2 + (F.col("b_w") == 0).cast("int"), F.greatest(F.col("b_w"), F.lit(1)).cast("double"))
    nothing = Sums(0, centre * 0, np.outer(centre, centre) * 0)
    rows = []
    for i in range(iterations):
        left = sums.get(2 * i + 1, nothing)
        if left.n < 2:
            continue
        spread = left.c[0, 0] - left.s[0] ** 2 / left.n
        model = sums.get(2 * i, nothing)
        r2 = 1 - _press(left, model.solve(centre, alpha), centre) / spread if model.n and spread > 1e-14 * left.c[0, 0] else None
        rows.append((i, int(left.n), None if r2 is None else float(r2)))
    return df.sparkSession.createDataFrame(rows, "iteration int, n_out long, r2 double")


def bootstrap_summary(scores: DataFrame, confidence: float = 0.95) -> DataFrame:
    """iterations, mean, std, lower, upper of r2."""
    low = (1 - confidence) / 2
    return scores.agg(F.count(F.lit(1)).alias("iterations"), F.avg("r2").alias("mean"), F.stddev_samp("r2").alias("std"), F.percentile("r2", F.lit(low)).alias("lower"), F.percentile("r2", F.lit(1 - low)).alias("upper"))


def _placed(df: DataFrame, idx: str) -> DataFrame:
    """The rows with their place s_r in the order of the ids."""
    return ranked(df.withColumn("s_i", F.col(idx)), ["s_i"], "s_r").drop("s_i")


def scrambled(df: DataFrame, y: str, idx: str, iterations: int, first: int = 0, placed: DataFrame | None = None) -> DataFrame:
    """The rows once an iteration (from `first` on), with the response of another row: a permutation by hash order, against the order of the ids.

    All iterations are ranked together, in ranges of (iteration, first digits of the hash), so that neither a table nor an iteration is one task.
    A row is exchanged as its hash and response only, as equal hashes are of equal ids. placed: the rows with their places, if they are known.
    """
    base = _placed(df, idx) if placed is None else placed
    n = df.agg(F.count(F.lit(1)).alias("s_n"))
    it = F.explode(F.sequence(F.lit(first), F.lit(first + iterations - 1)))
    order = _dealt(df.select(F.col(idx).alias("s_i"), F.col(y).alias("s_y"))).select(it.alias("iteration"), "s_i", "s_y")
    order = order.select("iteration", F.unhex(F.md5(F.concat_ws(":", F.col("iteration").cast("string"), F.col("s_i").cast("string")))).alias("s_h"), "s_y")
    order = ranked(order, ["iteration", "s_h"], "s_p", F.struct("iteration", F.substring("s_h", 1, 1).alias("s_d"))).join(F.broadcast(n)).select("iteration", "s_y", (F.col("s_p") - (F.col("iteration") - first) * F.col("s_n")).alias("s_r"))
    return base.join(order, "s_r").select("iteration", *[F.col("s_y").alias(y) if c == y else F.col(c) for c in df.columns])


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What queries exchange is deleted as they end, not when the driver next collects garbage."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def _press(s: Sums, m: Linear, centre: np.ndarray) -> float:
    """The squared errors of a model on the rows of some sums."""
    b = np.array(m.coefficients)
    a = m.intercept - centre[0] + b @ centre[1:]
    return float(s.c[0, 0] - 2 * b @ s.c[1:, 0] + b @ s.c[1:, 1:] @ b + s.n * a * a - 2 * a * (s.s[0] - b @ s.s[1:]))


def y_scrambling(df: DataFrame, y: str, features: list[str], idx: str, iterations: int = 100, alpha: float = 0.0, folds: int = 5) -> DataFrame:
    """real, mean, largest r2 and p_value of models that are fitted to permuted responses.

    r2 is that of pooled predictions out of fold, folds being dealt by a hash of the id; with folds = 0 it is that of the rows the model was fitted to.
    Iterations share a pass as far as SCRAMBLED rows go, so that the disk holds so many at a time, however many iterations there are.
    """
    names = [y, *features]
    d = _whole(df, names).select(idx, *names)
    centre = _centre(d, names)
    if folds:
        deal = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("fold"), F.col(idx).cast("string"))), 1, 8), 16, 10).cast("long") % folds
        d = d.withColumn("y_fold", deal)
    width = max(folds, 1)

    def score(per: list[Sums]) -> float:
        total = Sums(sum(s.n for s in per), sum(s.s for s in per), sum(s.c for s in per))
        spread = total.c[0, 0] - total.s[0] ** 2 / total.n
        if spread <= 0 or (folds and len(per) < 2):
            return float("nan")
        return float(1 - sum(_press(s, (total - s if folds else s).solve(centre, alpha), centre) for s in per) / spread)

    def scores(rows: DataFrame, it: Column) -> list[float]:
        sums = _sums(rows, names, centre, it * width + (F.col("y_fold") if folds else F.lit(0)))
        by: dict[int, list[Sums]] = {}
        for k in sorted(sums):
            by.setdefault(k // width, []).append(sums[k])
        return [score(per) for per in by.values()]

    own = scores(d, F.lit(0))
    kind = "real double, mean double, largest double, p_value double"
    if not own:
        return df.sparkSession.createDataFrame([], kind)
    real = own[0]
    spark = df.sparkSession
    placed = _cut(_placed(d, idx))
    d, rest = placed.drop("s_r"), []
    step = max(1, SCRAMBLED // d.count())
    with _cleaned(spark):
        for i in range(0, iterations, step):
            rest += scores(scrambled(d, y, idx, min(step, iterations - i), i, placed), F.col("iteration"))
    row = (real, float(np.mean(rest)), float(np.max(rest)), (sum(r >= real for r in rest) + 1) / (len(rest) + 1))
    return df.sparkSession.createDataFrame([row], kind)


def baseline(train: DataFrame, y: str, task: str = "regression") -> DataFrame:
    """value: the mean, or the most frequent label, ties to the smallest."""
    if task == "regression":
        return train.agg(F.avg(y).alias("value"))
    counts = train.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.min_by("value", F.struct(-F.col("c"), "value")).alias("value"))


def consensus(members: list[str], weights: list[float] | None = None) -> Column:
    """The weighted mean of the members' predictions, of those that have one."""
    w = weights or [1.0] * len(members)
    if len(w) != len(members) or min(w) < 0 or not sum(w):
        raise ValueError("a weight a member, none negative, not all zero")
    total = sum((F.when(F.col(m).isNotNull(), F.col(m) * v).otherwise(0.0) for m, v in zip(members, w, strict=True)), F.lit(0.0))
    held = sum((F.when(F.col(m).isNotNull(), F.lit(v)).otherwise(0.0) for m, v in zip(members, w, strict=True)), F.lit(0.0))
    return ratio(total, held)


def mutual_information(df: DataFrame, vec: str, y: str, above: float) -> DataFrame:
    """dim, mi (nats) of each binarised component with a label, from counts; every row has the same dimensions."""
    x = df.where(F.col(y).isNotNull()).select(F.col(y).alias("c"), F.posexplode(vec).alias("dim", "x")).withColumn("b", (F.col("x").cast("double") > above).cast("int"))
    cells = x.groupBy("dim", "b", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    b = cells.groupBy("dim", "b").agg(F.sum("n").alias("nb"))
    c = cells.groupBy("dim", "c").agg(F.sum("n").alias("nc"))
    t = cells.groupBy("dim").agg(F.sum("n").alias("nt"))
    j = cells.join(b, ["dim", "b"]).join(c, ["dim", "c"]).join(t, "dim")
    return j.groupBy("dim").agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nc")))).alias("mi"))
