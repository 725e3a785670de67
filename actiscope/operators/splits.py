"""Splits as a column: time, hashed random, folds, groups, perimeter. Sizes are exact, orders are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def _share(n: Column, size: float) -> Column:
    """How many of n rows the test set gets: one at least."""
    return F.greatest(F.lit(1), F.bround(n * size).cast("long")).cast("long")


def _flagged(df: DataFrame, order: dict[str, Column], test_size: float, last: bool = False) -> DataFrame:
    """is_test for the first (or last) rows of an order."""
    n = df.agg(_share(F.count(F.lit(1)), test_size).alias("s_n"), F.count(F.lit(1)).alias("s_all"))
    r = ranked(df.withColumns(order), list(order), "s_r").join(F.broadcast(n))  # one row
    return r.select(*df.columns, (F.col("s_r") > F.col("s_all") - F.col("s_n") if last else F.col("s_r") <= F.col("s_n")).alias("is_test"))


def shuffled(idx: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(idx).cast("string")))


def time_split(df: DataFrame, ts: str, idx: str, test_size: float = 0.2) -> DataFrame:
    """The latest rows are the test set, ties to the larger id; rows without a time are the earliest."""
    return _flagged(df, {"s_t": F.col(ts), "s_i": F.col(idx)}, test_size, last=True)


def random_split(df: DataFrame, idx: str, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    return _flagged(df, {"s_h": shuffled(idx, seed), "s_i": F.col(idx)}, test_size)


def perimeter_split(df: DataFrame, distance: str, idx: str, test_size: float = 0.2) -> DataFrame:
    """The rows closest to the centre are the test set, so that training holds the outer ones, ties to the larger id in training."""
    return _flagged(df, {"s_d": F.round(distance, 9), "s_i": F.col(idx)}, test_size)


def folds(df: DataFrame, idx: str, k: int = 5, seed: int = 0) -> DataFrame:
    """fold 0..k-1, of sizes that differ by one at most."""
    r = ranked(df.withColumns({"s_h": shuffled(idx, seed), "s_i": F.col(idx)}), ["s_h", "s_i"], "s_r")
    return r.select(*df.columns, ((F.col("s_r") - 1) % k).cast("int").alias("fold"))


def sampled(df: DataFrame, idx: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if fewer) without replacement, those of the smallest hashes."""
    r = ranked(df.withColumns({"s_h": shuffled(idx, seed), "s_i": F.col(idx)}), ["s_h", "s_i"], "s_r")
    return r.where(F.col("s_r") <= n).select(*df.columns)


def balanced(df: DataFrame, label: str, idx: str, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest class has, those of the smallest hashes; rows without a label go.

    Each class is ranked within the whole order, minus what the classes before it hold, so that a large class is no single task.
    """
    d = df.where(F.col(label).isNotNull())
    classes = d.groupBy(F.col(label).alias("s_c")).agg(F.count(F.lit(1)).alias("s_n"))
    before = Window.orderBy("s_c").rowsBetween(Window.unboundedPreceding, -1)  # a row per class
    least = classes.agg(F.min("s_n").alias("s_m"))
    places = classes.select("s_c", F.coalesce(F.sum("s_n").over(before), F.lit(0)).alias("s_o")).join(F.broadcast(least))
    r = ranked(d.withColumns({"s_l": F.col(label), "s_h": shuffled(idx, seed), "s_i": F.col(idx)}), ["s_l", "s_h", "s_i"], "s_r", F.struct("s_l", F.substring("s_h", 1, 2).alias("s_p")))
    return r.join(F.broadcast(places), F.col("s_l") == F.col("s_c")).where(F.col("s_r") - F.col("s_o") <= F.col("s_m")).select(*df.columns)


def group_fill(df: DataFrame, group: str, test_size: float = 0.2) -> DataFrame:
    """is_test by whole groups: largest first, then by name, a group goes to training while it fits there, else to the test set.

    Groups of one size behave alike: as many as still fit go to training, the first by name.  So what is folded in order is a row per distinct
    size, of which n rows can have about sqrt(2 n); the groups themselves are ranked by size and name in ranges.  Null is a group.
    """
    groups = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    one = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "n", "c"))).alias("ss"), F.sum(F.col("n") * F.col("c")).alias("rows"))
    target = F.col("rows") - _share(F.col("rows"), test_size)
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("used"), zero.alias("seen"), F.array().cast("array<struct<n:bigint,last:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        k = F.least(x["c"], F.floor((target - acc["used"]) / x["n"]).cast("long"))
        row = F.struct(x["n"].alias("n"), (acc["seen"] + k).alias("last"))
        return F.struct((acc["used"] + k * x["n"]).alias("used"), (acc["seen"] + x["c"]).alias("seen"), F.concat(acc["out"], F.array(row)).alias("out"))

    kept = one.select(F.explode(F.aggregate("ss", start, step)["out"]).alias("s")).select(F.col("s.n").alias("k_n"), "s.last")
    r = ranked(groups.withColumn("neg", -F.col("n")), ["neg", "g"], "r")
    test = r.join(kept, F.col("n") == F.col("k_n")).where("r > last").select(F.col("g").alias("t_g"), F.lit(True).alias("t_in"))
    out = df.join(test, F.col(group).eqNullSafe(F.col("t_g")), "left")
    return out.select(*df.columns, F.coalesce("t_in", F.lit(False)).alias("is_test"))
