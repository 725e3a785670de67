"""Regression metrics: every figure of a report comes from one hash aggregate over the pairs, by group if asked.

The algebra is expanded to sums, so one pass with partial aggregation is enough; no column is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, square
from .ranking import quantiles


def report(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: list[str] | None = None, q2: float | None = None) -> DataFrame:
    """n, mse, rmse, mae, median_ae, bias, press, r2, ccc, slopes, squared correlations through the origin, r2m and acceptance criteria."""
    t, e = F.col(y).cast("double"), F.col(p).cast("double")
    d = df.where(t.isNotNull() & e.isNotNull())
    agg = [F.count(F.lit(1)).alias("n"), F.sum(square(t - e)).alias("press"), F.avg(F.abs(t - e)).alias("mae"), F.percentile(F.abs(t - e), F.lit(0.5)).alias("median_ae"),
           F.avg(e - t).alias("bias"), F.avg(t).alias("mt"), F.avg(e).alias("mp"), F.var_pop(t).alias("vt"), F.var_pop(e).alias("vp"), F.covar_pop(t, e).alias("cov"),
           F.sum(t * e).alias("tp"), F.sum(t * t).alias("tt"), F.sum(e * e).alias("pp")]
    if not by:  # a whole table's median comes from ranks in ranges: a percentile would hold all distinct errors in one task
        agg = [x for i, x in enumerate(agg) if i != 3]
    a = d.groupBy(*(by or [])).agg(*agg).where("n > 0")
    if not by:
        a = a.join(F.broadcast(quantiles(d.select(F.abs(t - e).alias("error")), "error", {"median_ae": 0.5})))  # one row each
    c = F.col
    a = a.withColumn("mse", c("press") / c("n")).withColumn("rmse", F.sqrt("mse")).withColumn("r2", 1 - ratio(c("press"), c("vt") * c("n")))
    a = a.withColumn("ccc", ratio(2 * c("cov"), c("vt") + c("vp") + square(c("mt") - c("mp")), 1.0))
    a = a.withColumn("k", ratio(c("tp"), c("tt"))).withColumn("k_prime", ratio(c("tp"), c("pp")))
    a = a.withColumn("corr2", ratio(square(c("cov")), c("vt") * c("vp")))
    # Sums of squares about a line through the origin, from centred moments: raw sums lose digits where the mean is large.
    left = lambda own, other, cov, m_own, m_other, k: own - 2 * k * cov + square(k) * other + square(m_own - k * m_other)
    a = a.withColumn("r02", 1 - ratio(left(c("vp"), c("vt"), c("cov"), c("mp"), c("mt"), c("k")), c("vp")))
    a = a.withColumn("r02_prime", 1 - ratio(left(c("vt"), c("vp"), c("cov"), c("mt"), c("mp"), c("k_prime")), c("vt")))
    a = a.withColumn("r2m", c("corr2") * (1 - F.sqrt(F.abs(c("corr2") - c("r02"))))).withColumn("r2m_prime", c("corr2") * (1 - F.sqrt(F.abs(c("corr2") - c("r02_prime")))))
    a = a.withColumn("average_r2m", (c("r2m") + c("r2m_prime")) / 2).withColumn("delta_r2m", F.abs(c("r2m") - c("r2m_prime")))
    near = (c("k").between(0.85, 1.15) & (ratio(c("corr2") - c("r02"), c("corr2")) < 0.1)) | (c("k_prime").between(0.85, 1.15) & (ratio(c("corr2") - c("r02_prime"), c("corr2")) < 0.1))
    a = a.withColumn("gt_r2", c("corr2") > 0.6).withColumn("gt_slope", F.coalesce(near, F.lit(False))).withColumn("gt_delta", F.abs(c("r02") - c("r02_prime")) < 0.3)
    a = a.withColumn("passed", c("gt_r2") & c("gt_slope") & c("gt_delta") & F.lit(q2 is None or q2 > 0.5))
    return a.select(*(by or []), "n", "mse", "rmse", "mae", "median_ae", "bias", "press", "r2", "ccc", "k", "k_prime", "r02", "r02_prime", "r2m", "r2m_prime", "average_r2m", "delta_r2m", "gt_r2", "gt_slope", "gt_delta", "passed")


def external(test: DataFrame, train: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """q2_f1, q2_f2, q2_f3 of a test set given the training responses: two one-row aggregates side by side."""
    t, e = F.col(y).cast("double"), F.col(p).cast("double")
    a = test.agg(F.count(F.lit(1)).alias("n"), F.sum(square(t - e)).alias("press"), F.sum(t).alias("st"), F.sum(t * t).alias("stt"), F.var_pop(t).alias("vt"))
    b = train.agg(F.avg(t).alias("m"), F.var_pop(t).alias("v"))
    j = a.join(F.broadcast(b))  # one row each
    c = F.col
    f1 = 1 - ratio(c("press"), c("stt") - 2 * c("m") * c("st") + c("n") * square(c("m")))
    return j.select(f1.alias("q2_f1"), (1 - ratio(c("press"), c("vt") * c("n"))).alias("q2_f2"), (1 - ratio(c("press") / c("n"), c("v"))).alias("q2_f3"))


def error_of_estimate(df: DataFrame, parameters: int, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """see and adjusted r2 for a model of so many parameters; null without degrees of freedom."""
    t, e = F.col(y).cast("double"), F.col(p).cast("double")
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(square(t - e)).alias("press"), F.var_pop(t).alias("vt"))
    dof = F.col("n") - parameters - 1
    r2 = 1 - ratio(F.col("press"), F.col("vt") * F.col("n"))
    return a.select(F.when(dof > 0, F.sqrt(F.col("press") / dof)).alias("see"), F.when(dof > 0, 1 - (1 - r2) * (F.col("n") - 1) / dof).alias("adjusted_r2"))


def residual_moments(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean, spread, skewness and excess kurtosis (population) of p - y."""
    r = F.col(p).cast("double") - F.col(y).cast("double")
    return df.agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("skewness"), F.kurtosis(r).alias("kurtosis"))
