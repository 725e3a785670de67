"""Data quality: duplicates, replicate merging, outliers, units, representation conflicts. All are hash aggregates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .ranking import quantiles


def duplicate_groups(df: DataFrame, key: str, idx: str, value: str, tolerance: float = 1.0) -> DataFrame:
    """key, first, size, spread, consistent of each key that occurs twice or more. Null keys are no duplicates."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(idx).alias("first"), F.count(F.lit(1)).alias("size"), F.count(value).alias("m"), (F.max(value) - F.min(value)).alias("s"))
    g = g.where("size >= 2").withColumn("spread", F.when(F.col("m") >= 2, F.col("s")).otherwise(0.0))
    return g.select(key, "first", "size", "spread", (F.col("spread") <= tolerance).alias("consistent"))


def duplicate_report(df: DataFrame, key: str, idx: str, value: str, tolerance: float = 1.0) -> DataFrame:
    g = duplicate_groups(df, key, idx, value, tolerance).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("redundant"), F.count_if(~F.col("consistent")).alias("inconsistent"), F.coalesce(F.max("spread"), F.lit(0.0)).alias("max_spread"))
    n = df.agg(F.count(F.lit(1)).alias("n_records"))
    j = n.join(F.broadcast(g))  # one row each
    return j.select("n_records", (F.col("n_records") - F.col("redundant")).alias("n_unique"), "groups", "redundant", ratio(F.col("redundant"), F.col("n_records"), 0).alias("fraction"), "inconsistent", "max_spread")


#: How the activities of a key become one.
MERGE = {
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "geometric_mean": lambda c: F.exp(F.avg(F.when(c > 0, F.ln(c)))),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def merge_replicates(df: DataFrame, key: str, idx: str, value: str, method: str = "median", max_spread: float | None = 1.0) -> DataFrame:
    """key, first, n, value: one row per key, of the first row's place; keys whose spread is too large go, rows without a key stay."""
    v: Column = F.col(value)
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(idx).alias("first"), F.count(F.lit(1)).alias("n"), MERGE[method](v).alias("value"), (F.max(v) - F.min(v)).alias("spread"))
    if max_spread is not None:
        g = g.where(F.coalesce(F.col("spread"), F.lit(0.0)) <= max_spread)
    lone = df.where(F.col(key).isNull()).select(key, F.col(idx).alias("first"), F.lit(1).cast("long").alias("n"), v.alias("value"))
    return g.select(key, "first", "n", "value").unionByName(lone)


def outlier_scores(df: DataFrame, value: str, method: str = "modified_zscore") -> DataFrame:
    """The rows with outlyingness `score`: zscore, modified_zscore or iqr; the statistics are one broadcast row."""
    v = F.col(value)
    if method == "zscore":
        s = df.agg(F.avg(v).alias("o_m"), F.stddev_samp(v).alias("o_s"))
        score = ratio(F.abs(v - F.col("o_m")), F.col("o_s"), 0)
    elif method == "modified_zscore":
        m = quantiles(df.select(v.alias("v")), "v", {"o_m": 0.5})
        far = df.join(F.broadcast(m)).select("o_m", F.abs(v - F.col("o_m")).alias("far"))
        s = far.groupBy("o_m").agg(F.avg("far").alias("o_a")).join(F.broadcast(quantiles(far, "far", {"o_s": 0.5})))  # one row each
        far = F.abs(v - F.col("o_m"))
        score = F.when(F.col("o_s") > 0, 0.6745 * far / F.col("o_s")).otherwise(ratio(far, 1.253314 * F.col("o_a"), 0))
    elif method == "iqr":
        s = quantiles(df.select(v.alias("v")), "v", {"o_m": 0.25, "o_s": 0.75})
        score = ratio(F.greatest(F.col("o_m") - v, v - F.col("o_s"), F.lit(0.0)), F.col("o_s") - F.col("o_m"), 0)
    else:
        raise ValueError(f"no method {method}")
    return df.join(F.broadcast(s)).withColumn("score", score).select(*df.columns, "score")


def units_check(df: DataFrame, value: str) -> DataFrame:
    """Counts and range of the activities, and whether they look like logarithms."""
    v = F.col(value)
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(v <= 0).alias("non_positive"), F.min(v).alias("min"), F.max(v).alias("max"), F.min(F.when(v > 0, v)).alias("low"))
    a = a.join(F.broadcast(quantiles(df.select(v.alias("v")), "v", {"median": 0.5})))  # one row each
    return a.select("n", "missing", "non_positive", "min", "max", "median", F.log10(F.col("max") / F.col("low")).alias("log_range"), ((F.col("min") >= -2) & (F.col("max") <= 15)).alias("looks_logarithmic"))


def representation_conflicts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """How well any model of these features can do at best: rows of equal features with different labels."""
    per = df.groupBy(*features, label).agg(F.count(F.lit(1)).alias("c"))
    g = per.groupBy(*features).agg(F.sum("c").alias("size"), F.max("c").alias("top"), F.count(F.lit(1)).alias("labels"))
    a = g.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("distinct_rows"), F.count_if(F.col("size") > 1).alias("collision_groups"), F.count_if(F.col("labels") > 1).alias("conflicting_groups"),
              F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("size"))), F.lit(0)).alias("in_conflict"), F.sum(F.col("size") - F.col("top")).alias("irreducible_errors"))
    return a.withColumn("max_accuracy", 1 - ratio(F.col("irreducible_errors"), F.col("n"), 0))


def curated(df: DataFrame, key: str, idx: str, value: str, valid: Column | None = None, method: str = "median", max_spread: float | None = 1.0, outliers: str | None = None, limit: float = 3.5) -> tuple[DataFrame, DataFrame]:
    """Valid rows, replicates merged by key, outliers removed; and the report of the stages: place, stage, n, removed, retention of the input.

    A row without a value is valid if the condition says so; it merges into its key, is never an outlier.  The report counts each stage anew: its plan
    reads the table once a stage.  An empty table has null retention.
    """
    stages = [("input", df), ("valid", df if valid is None else df.where(valid))]
    stages.append(("merged", merge_replicates(stages[-1][1], key, idx, value, method, max_spread)))
    if outliers:
        scores = outlier_scores(stages[-1][1], "value", outliers)
        stages.append(("without outliers", scores.where(F.coalesce("score", F.lit(0.0)) <= limit).drop("score")))
    report = None
    for place, (name, d) in enumerate(stages):
        one = d.agg(F.lit(place).alias("place"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        report = one if report is None else report.unionByName(one)
    w = Window.orderBy("place")  # a row per stage
    removed = F.coalesce(F.lag("n").over(w) - F.col("n"), F.lit(0).cast("long"))
    return stages[-1][1], report.select("place", "stage", "n", removed.alias("removed"), ratio(F.col("n"), F.first("n").over(w)).alias("retention"))
