"""Are predicted spreads honest, and conformal sets of classes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import square
from .ranking import mean_ranks, running


def levels(points: int = 20) -> list[float]:
    """Nominal levels from 0.01 to 0.99."""
    return [round(0.01 + 0.98 * i / (points - 1), 12) for i in range(points)]


def quantile_of(level: float) -> float:
    """How many spreads from the mean a central normal interval of this level reaches."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def coverage_curve(df: DataFrame, y: str, p: str, sigma: str, points: int = 20) -> DataFrame:
    """nominal, observed: the share of rows whose error lies in the central normal interval of each level, all in one aggregate."""
    inside = lambda v: F.abs(F.col(y) - F.col(p)) <= F.col(sigma) * v
    a = df.agg(*[F.avg(inside(quantile_of(v)).cast("double")).alias(f"c{i}") for i, v in enumerate(levels(points))])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("nominal"), F.col(f"c{i}").alias("observed")) for i, v in enumerate(levels(points))]))
    return a.select(rows.alias("r")).select("r.*")


def miscalibration_area(df: DataFrame, y: str, p: str, sigma: str, points: int = 20) -> DataFrame:
    """area: between the coverage curve and the diagonal, by trapezoids."""
    c = coverage_curve(df, y, p, sigma, points).withColumn("gap", F.abs(F.col("observed") - F.col("nominal")))
    w = Window.orderBy("nominal")  # a row per level
    steps = c.withColumns({"g0": F.lag("gap").over(w), "n0": F.lag("nominal").over(w)})
    return steps.agg(F.sum((F.col("gap") + F.col("g0")) / 2 * (F.col("nominal") - F.col("n0"))).alias("area"))


def spread_correlation(df: DataFrame, y: str, p: str, sigma: str) -> DataFrame:
    """spearman: the rank correlation of predicted spread and absolute error, ties at their mean rank; 0 if one of them is constant."""
    d = df.select(F.col(sigma).alias("u_s"), F.abs(F.col(y) - F.col(p)).alias("u_e"))
    r = mean_ranks(mean_ranks(d, "u_s", "u_a"), "u_e", "u_b")
    return r.agg(F.coalesce(F.nanvl(F.corr("u_a", "u_b"), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def spread_report(df: DataFrame, y: str, p: str, sigma: str) -> DataFrame:
    """n, coverage_68, coverage_95, mean_sigma, rmse, from one aggregate."""
    inside = lambda v: F.avg((F.abs(F.col(y) - F.col(p)) <= F.col(sigma) * quantile_of(v)).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), inside(0.68).alias("coverage_68"), inside(0.95).alias("coverage_95"), F.avg(sigma).alias("mean_sigma"), F.sqrt(F.avg(square(F.col(y) - F.col(p)))).alias("rmse"))


def conformal_p_values(calibration: DataFrame, df: DataFrame, score: str) -> DataFrame:
    """The rows with p = (calibration scores at or above theirs + 1) / (n + 1).

    Both sides' distinct scores are summed up together from the top, so that no row meets the calibration set.
    """
    cal = calibration.where(F.col(score).isNotNull())
    seen = cal.select(F.col(score).alias("c_s"), F.lit(1).cast("long").alias("c")).unionByName(df.select(F.col(score).alias("c_s"), F.lit(0).cast("long").alias("c")))
    each = seen.where("c_s IS NOT NULL").groupBy("c_s").agg(F.sum("c").alias("c")).withColumn("c_o", -F.col("c_s"))
    above = running(each, ["c_o"], {"c_u": F.col("c")}).select("c_s", "c_u")
    n = cal.agg(F.count(F.lit(1)).alias("c_n"))
    j = df.join(above, F.col(score) == F.col("c_s")).join(F.broadcast(n))  # one row
    return j.select(*df.columns, ((F.col("c_u") + 1) / (F.col("c_n") + 1)).alias("p"))


def conformal_sets(p_values: DataFrame, idx: str, label: str, alpha: float = 0.1) -> DataFrame:
    """idx, classes: those with p above alpha, ascending. Input: a row per row and class."""
    return p_values.groupBy(idx).agg(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("p") > alpha, F.col(label))))).alias("classes"))


def conformal_evaluation(sets: DataFrame, y: str) -> DataFrame:
    """coverage, mean_size, singletons, empty of sets beside the true class."""
    n = F.size("classes")
    share = lambda c: F.avg(c.cast("double"))
    return sets.agg(share(F.array_contains("classes", F.col(y))).alias("coverage"), F.avg(n.cast("double")).alias("mean_size"), share(n == 1).alias("singletons"), share(n == 0).alias("empty"))
