"""Column-wise fits over a feature array: scaling, variance and correlation, each one aggregate of a row per dimension (or pair)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distances import _whole, moments
from .domain import _long
from .ranking import quantiles


def column_statistics(df: DataFrame, idx: str, vec: str) -> DataFrame:
    """dim, n, mean, sd (population), min, max, q25, median, q75."""
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = _long(df, idx, vec).groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"), q.alias("q"))
    return g.select("dim", "n", "mean", "sd", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def scale(df: DataFrame, idx: str, vec: str, how: str = "standard") -> DataFrame:
    """idx, dim, x scaled: standard, minmax or robust; a constant column is only centred."""
    s = column_statistics(df, idx, vec)
    centre, width = {"standard": ("mean", F.col("sd")), "minmax": ("min", F.col("max") - F.col("min")), "robust": ("median", F.col("q75") - F.col("q25"))}[how]
    s = s.select("dim", F.col(centre).alias("c"), F.when(width == 0, 1.0).otherwise(width).alias("w"))
    return _long(df, idx, vec).join(F.broadcast(s), "dim").select(idx, "dim", ((F.col("x") - F.col("c")) / F.col("w")).alias("x"))


def variance_filter(df: DataFrame, idx: str, vec: str, least: float) -> DataFrame:
    """dim, variance (population) of the columns that are kept: variance above least."""
    return _long(df, idx, vec).groupBy("dim").agg(F.var_pop("x").alias("variance")).where(F.col("variance") > least)


def impute(df: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """Null, NaN and infinite values of the columns become the column's mean or median."""
    clean = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in columns}
    if strategy == "mean":
        fill = df.agg(*[F.avg(x).alias(f"fill_{c}") for c, x in clean.items()])
    else:
        fill = None
        for c, x in clean.items():
            one = quantiles(df.select(x.alias("x")), "x", {f"fill_{c}": 0.5})
            fill = one if fill is None else fill.join(F.broadcast(one))  # one row each
    return df.join(F.broadcast(fill)).withColumns({c: F.coalesce(x, F.col(f"fill_{c}")) for c, x in clean.items()}).select(*df.columns)


def correlation_filter(df: DataFrame, idx: str, vec: str, most: float = 0.95) -> DataFrame:
    """dim of the columns that are kept: in order, a column goes if its absolute correlation with a kept one is above the limit. Constants go first.

    A task sums up one p x p matrix of the centred columns; the pass over the columns runs on that matrix, on the driver.  Rows with components that
    are null or not finite don't count.
    """
    rows = df.where(_whole(vec)).select(F.col(vec).cast("array<double>").alias("x"))
    means = rows.select(F.posexplode("x").alias("i", "a")).groupBy("i").agg(F.avg("a").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("ms"))
    centred = rows.join(F.broadcast(means)).select(F.zip_with("x", "ms", lambda a, m: a - m).alias("x"))  # one row
    sums = moments(centred, "x")[2]
    kept: list[int] = []
    for j in range(len(sums)):
        if sums[j, j] > 0 and all(abs(sums[i, j]) / (sums[i, i] * sums[j, j]) ** 0.5 <= most for i in kept):
            kept.append(j)
    return df.sparkSession.createDataFrame([(j,) for j in kept], "dim int")
