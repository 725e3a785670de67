"""Metrics of streams of predictions: event-time windows with a watermark, from the sums that the batch reports use.

State is a row per open window and group; a watermark closes windows, so state doesn't grow with the stream. Rows later than the watermark are dropped
by Spark, which is what a watermark means; rows without a time are in no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, square
from ..operators.classification import rates


def _windowed(df: DataFrame, ts: str, window: str, late: str, by: list[str] | None):
    d = df.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    return d.groupBy(F.window(ts, window).alias("w"), *(by or []))


def regression_windows(df: DataFrame, ts: str, y: str, p: str, window: str = "1 hour", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """start, end, groups, n, bias, mae, rmse, r2 of each window."""
    t, e = F.col(y).cast("double"), F.col(p).cast("double")
    d = df.where(t.isNotNull() & e.isNotNull())
    a = _windowed(d, ts, window, late, by).agg(F.count(F.lit(1)).alias("n"), F.avg(e - t).alias("bias"), F.avg(F.abs(e - t)).alias("mae"), F.sum(square(e - t)).alias("press"), F.var_pop(t).alias("v"))
    out = a.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "bias", "mae", F.sqrt(F.col("press") / F.col("n")).alias("rmse"), (1 - ratio(F.col("press"), F.col("v") * F.col("n"))).alias("r2"))
    return out


def confusion_windows(df: DataFrame, ts: str, y: str, pred: str, window: str = "1 hour", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """start, end, groups, tp, fp, tn, fn and the rates of each window."""
    t, p = F.col(y) == 1, F.col(pred) == 1
    a = _windowed(df, ts, window, late, by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    parts = [F.col(k) for k in ("tp", "fp", "tn", "fn")]
    return a.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), *parts, *[c.alias(k) for k, c in rates(*parts).items()])


def first_records(df: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark: duplicates that arrive in time are dropped."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
