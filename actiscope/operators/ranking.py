"""Exact ranks and running sums over a whole table, without a window that puts all rows in one task.

A window without partitions sorts everything in one task.  Here rows are first dealt into ranges of their order, each range is summed up
by a window of its own, and what all ranges before hold is added from a table of one row per range.  The bounds of the ranges come from a random
sample of 16 rows per shuffle partition (never more) and only balance the ranges: results don't depend on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLED = 16


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with r_range: the number of bounds that their place in the order reaches.

    Bounds are rows of two small tables, the one of blocks, the other of the ranges in them; each row meets one of either.  As constants of the plan they would take the driver
    longer than the job takes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order)
    sample = keys.orderBy(F.rand(0)).limit(SAMPLED * parts).orderBy(*order).collect()
    step = max(1, len(sample) // parts)
    bounds = sample[step::step]
    if not bounds:
        return df.withColumn("r_range", F.lit(0))
    wide = math.isqrt(len(bounds) - 1) + 1
    blocks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    kind, whole = keys.schema, T.IntegerType()
    ends = [T.StructField("r_lo", kind), T.StructField("r_hi", kind)]

    def between(firsts: list) -> list[tuple]:
        return list(zip([None, *firsts], [*firsts, None], strict=True))

    def table(name: str, rows: list[tuple]) -> DataFrame:
        return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(n, whole) for n in ("r_block", name)] + ends), verifySchema=False)

    first = table("r_none", [(j, None, lo, hi) for j, (lo, hi) in enumerate(between([b[0] for b in blocks]))]).drop("r_none")
    each = table("r_range", [(0, 0, None, None), *[(j, (j - 1) * wide + i, lo, hi) for j, b in enumerate(blocks, 1) for i, (lo, hi) in enumerate(between(b[1:]), 1)]])
    inside = (F.col("r_lo").isNull() | (F.col("r_key") >= F.col("r_lo"))) & (F.col("r_hi").isNull() | (F.col("r_key") < F.col("r_hi")))
    d = df.withColumn("r_key", F.struct(*order)).join(F.broadcast(first), inside).select(*df.columns, "r_key", "r_block")
    return d.join(F.broadcast(each).withColumnRenamed("r_block", "r_at"), (F.col("r_block") == F.col("r_at")) & inside).select(*df.columns, "r_range")


def running(df: DataFrame, order: list[str], sums: dict[str, Column], within: Column | None = None) -> DataFrame:
    """The rows with inclusive running sums (of longs, so that they are exact) in ascending order of the columns, nulls first.

    Rows that are equal in all columns of the order get their sums in any order, and lie in one range; aggregate such rows or add an id.
    `within` is a value that ascends with the order and has few rows each, if one is known: ranges then need no sample.
    """
    ranged = (_ranged(df, order) if within is None else df.withColumn("r_range", within)).withColumns({f"r_{k}": c for k, c in sums.items()})
    inside = Window.partitionBy("r_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    held = ranged.groupBy("r_range").agg(*[F.sum(f"r_{k}").alias(f"h_{k}") for k in sums])
    offsets = held.select("r_range", *[F.coalesce(F.sum(f"h_{k}").over(before), F.lit(0)).alias(f"o_{k}") for k in sums])
    summed = ranged.withColumns({f"s_{k}": F.sum(f"r_{k}").over(inside) for k in sums})
    return summed.join(F.broadcast(offsets), "r_range").select(*df.columns, *[(F.col(f"s_{k}") + F.col(f"o_{k}")).alias(k) for k in sums])


def ranked(df: DataFrame, order: list[str], name: str = "rank", within: Column | None = None) -> DataFrame:
    """The rows with their rank from 1 in ascending order of the columns."""
    return running(df, order, {name: F.lit(1).cast("long")}, within)


def quantiles(df: DataFrame, value: str, at: dict[str, float], count: str | None = None) -> DataFrame:
    """One row: the exact quantiles of a column under the given names, between two values in proportion; null values don't count.

    Distinct values are counted and ranked in ranges; no task holds them all. `count` is a column that tells how often a row's value counts, if rows stand for several.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("q_v")).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("q_c"))
    upto = running(counts, ["q_v"], {"q_u": F.col("q_c")})
    n = counts.agg(F.sum("q_c").alias("q_n"))
    j = upto.join(F.broadcast(n))  # one row
    place = lambda q: (F.col("q_n") - 1) * F.lit(float(q))
    ends = [F.min(F.when(F.col("q_u") > f(place(q)), F.col("q_v"))).alias(f"q_{i}_{side}") for i, q in enumerate(at.values()) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    got = j.agg(F.max("q_n").alias("q_n"), *ends)
    part = lambda i, q: F.col(f"q_{i}_lo") + (place(q) - F.floor(place(q))) * (F.col(f"q_{i}_hi") - F.col(f"q_{i}_lo"))
    return got.select(*[part(i, q).alias(name) for i, (name, q) in enumerate(at.items())])


def mean_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """The rows with the rank of a value, the mean of its ranks if it is repeated; null for null values. Only distinct values are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("m_v")).agg(F.count(F.lit(1)).alias("m_c"))
    places = running(counts, ["m_v"], {"m_u": F.col("m_c")}).select("m_v", (F.col("m_u") - (F.col("m_c") - 1) / 2).alias(name))
    return df.join(places, F.col(value) == F.col("m_v"), "left").drop("m_v")
