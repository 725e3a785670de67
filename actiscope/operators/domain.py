"""Applicability domains, conformal prediction and uncertainty calibration.

A domain is fitted by an aggregate of bounded size (a row per dimension) and scored by a projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import square
from .distances import _whole, moments
from .ranking import quantiles, ranked, running


def _long(df: DataFrame, idx: str, vec: str) -> DataFrame:
    return df.select(idx, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))


def range_domain(train: DataFrame, df: DataFrame, idx: str, vec: str, tolerance: float = 0.0) -> DataFrame:
    """idx, outside (dimensions out of the padded training range), inside."""
    box = _long(train, idx, vec).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pad = tolerance * (F.col("hi") - F.col("lo"))
    j = _long(df, idx, vec).join(F.broadcast(box), "dim")  # a row per dimension
    g = j.groupBy(idx).agg(F.count_if((F.col("x") < F.col("lo") - pad) | (F.col("x") > F.col("hi") + pad)).alias("outside"))
    return g.withColumn("inside", F.col("outside") <= 0)


def centroid_distance(train: DataFrame, df: DataFrame, idx: str, vec: str) -> DataFrame:
    """idx, distance to the training centroid."""
    centre = _long(train, idx, vec).groupBy("dim").agg(F.avg("x").alias("m"))
    j = _long(df, idx, vec).join(F.broadcast(centre), "dim")
    return j.groupBy(idx).agg(F.sqrt(F.sum(square(F.col("x") - F.col("m")))).alias("distance"))


def distance_domain(train: DataFrame, df: DataFrame, idx: str, vec: str, percentile: float = 0.95) -> DataFrame:
    """idx, distance, inside: within the training distances' percentile of the centroid."""
    limit = quantiles(centroid_distance(train, train, idx, vec), "distance", {"limit": percentile})
    return centroid_distance(train, df, idx, vec).join(F.broadcast(limit)).select(idx, "distance", (F.col("distance") <= F.col("limit")).alias("inside"))


def domain_report(df: DataFrame, inside: str, y: str, p: str) -> DataFrame:
    """Coverage, and errors inside and outside of a domain."""
    i, e = F.col(inside), F.col(p) - F.col(y)
    a = df.agg(F.avg(i.cast("double")).alias("coverage"), F.count_if(i).alias("n_inside"), F.count_if(~i).alias("n_outside"), F.sqrt(F.avg(F.when(i, square(e)))).alias("rmse_inside"), F.sqrt(F.avg(F.when(~i, square(e)))).alias("rmse_outside"), F.avg(F.when(i, F.abs(e))).alias("mae_inside"), F.avg(F.when(~i, F.abs(e))).alias("mae_outside"))
    return a.withColumn("rmse_ratio", F.try_divide("rmse_outside", "rmse_inside"))


def conformal_quantile(calibration: DataFrame, score: str, alpha: float = 0.1) -> DataFrame:
    """q: the calibration score of rank clip(ceil((n + 1)(1 - alpha)), 1, n), by counts of distinct scores."""
    s = calibration.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    n = s.agg(F.sum("c").alias("n"))
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil((F.col("n") + 1) * (1 - alpha))))
    return running(s, ["s"], {"u": F.col("c")}).join(F.broadcast(n)).where(F.col("u") >= rank).agg(F.min("s").alias("q"))


def conformal_interval(calibration: DataFrame, df: DataFrame, y: str, p: str, alpha: float = 0.1) -> DataFrame:
    """The rows with lo, hi and covered."""
    q = conformal_quantile(calibration.withColumn("c_s", F.abs(F.col(y) - F.col(p))), "c_s", alpha)
    d = df.join(F.broadcast(q)).withColumn("lo", F.col(p) - F.col("q")).withColumn("hi", F.col(p) + F.col("q"))
    return d.withColumn("covered", F.col(y).between(F.col("lo"), F.col("hi"))).drop("q")


def ence(df: DataFrame, idx: str, y: str, p: str, sigma: str, bins: int = 10) -> DataFrame:
    """Expected normalised calibration error over bins of equal size in order of sigma; bins without spread have no part."""
    n = df.agg(F.count(F.lit(1)).alias("e_n"))
    r = ranked(df, [sigma, idx], "e_r").join(F.broadcast(n))  # one row
    low, more = F.floor(F.col("e_n") / bins), F.col("e_n") % bins
    b = r.withColumn("b", F.when(F.col("e_r") <= more * (low + 1), F.floor((F.col("e_r") - 1) / (low + 1))).otherwise(more + F.floor((F.col("e_r") - 1 - more * (low + 1)) / F.greatest(low, F.lit(1)))))
    g = b.groupBy("b").agg(F.avg(sigma).alias("s"), F.sqrt(F.avg(square(F.col(y) - F.col(p)))).alias("r"))
    return g.agg(F.avg(F.try_divide(F.abs(F.col("s") - F.col("r")), F.col("s"))).alias("ence"))


def accuracy_by_coverage(df: DataFrame, score: str, idx: str, y: str, p: str, points: int = 20) -> DataFrame:
    """coverage, n_samples, rmse, mae of the rows of the smallest scores, at so many evenly spaced counts from 1 to all."""
    e = F.col(p) - F.col(y)
    r = running(df.select(F.col(score).alias("a_s"), F.col(idx).alias("a_i"), e.alias("a_e")), ["a_s", "a_i"], {"k": F.lit(1).cast("long"), "sq": F.col("a_e") * F.col("a_e"), "ab": F.abs("a_e")})
    n = df.agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.least(F.lit(points), F.col("n")))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.col("m"), F.lit(1)).cast("int")), lambda i: (1 + F.floor((i - 1) * (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1)))).cast("long"))
    grid = n.where("n > 0").select("n", F.explode(F.array_distinct(at)).alias("k"))
    return r.join(F.broadcast(grid), "k").select((F.col("k") / F.col("n")).alias("coverage"), F.col("k").alias("n_samples"), F.sqrt(F.col("sq") / F.col("k")).alias("rmse"), (F.col("ab") / F.col("k")).alias("mae"))


def leverage_domain(train: DataFrame, df: DataFrame, idx: str, vec: str, factor: float = 3.0) -> DataFrame:
    """idx, leverage, inside: x' (X'X)+ x against factor * (p + 1) / n, without centring.

    A task sums up one p x p matrix of p features, which the driver holds, never rows; rows with components that are null or not finite have no leverage and are left out.
    """
    x, whole = F.col(vec).cast("array<double>"), _whole(vec)
    n, _, g = moments(train, vec)
    p = len(g)
    inverse = np.linalg.pinv(g) if p else g
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inverse]) if p else F.array().cast("array<array<double>>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    h = dot(F.transform(table, lambda row: dot(row, x)), x)
    limit = factor * (p + 1) / n if n else 0.0
    return df.where(whole).select(idx, h.alias("leverage")).withColumn("inside", F.col("leverage") <= limit)


def williams(leverage: DataFrame, residuals: DataFrame, idx: str, y: str, p: str, limit: float = 3.0) -> DataFrame:
    """idx, leverage, residual (standardised by the sample deviation), influential, outlying."""
    e = F.col(p) - F.col(y)
    s = residuals.agg(F.stddev_samp(e).alias("w_s"))
    r = residuals.join(F.broadcast(s)).select(idx, F.try_divide(e, F.col("w_s")).alias("residual"))  # one row
    return leverage.join(r, idx).select(idx, "leverage", "residual", (~F.col("inside")).alias("influential"), (F.abs("residual") > limit).alias("outlying"))
