"""Additive models of substituents: each substituent at each position adds its share to a value.

The model is least squares over one indicator per substituent and position (all are kept, so the solution of least norm is taken), or ridge.
Its normal equations are counts of pairs of substituents and sums of values: one aggregate each, of a row per pair that occurs.  The driver solves them
and so holds a matrix of the distinct substituents, whose number is checked first; rows never reach it.

A null substituent adds nothing.  Rows whose value is null, NaN or infinite don't take part in the fit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many distinct substituents, over all positions, a model may have.
MOST = 4096


def _levels(positions: list[str]) -> Column:
    """The substituents of a row with their positions, without nulls."""
    levels = [F.struct(F.lit(p).alias("position"), F.col(p).cast("string").alias("substituent")) for p in positions]
    return F.filter(F.array(*levels), lambda s: s["substituent"].isNotNull())


def fit(df: DataFrame, positions: list[str], value: str, alpha: float = 0.0, intercept: bool = True, most: int = MOST) -> DataFrame:
    """position, substituent, n, contribution; the intercept is the row without a position.

    A table without a row to learn from gives the intercept 0 and nothing else; more than `most` substituents are an error.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(v.alias("v"), _levels(positions).alias("levels"))
    n, mean = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("v"), F.lit(0.0))).first()
    each = rows.select("v", F.explode("levels").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    found = sorted(each.limit(most + 1).collect(), key=lambda r: (r.a.position, r.a.substituent))
    if len(found) > most:
        raise ValueError(f"more than {most} substituents")
    place = {r.a: i for i, r in enumerate(found)}
    counts, sums = np.array([float(r.n) for r in found]), np.array([r.s for r in found])
    both = rows.select(F.explode("levels").alias("a"), "levels").select("a", F.explode("levels").alias("b")).groupBy("a", "b").count()
    gram = np.zeros((len(found), len(found)))
    for r in both.toLocalIterator():
        gram[place[r.a], place[r.b]] = r["count"]
    if intercept and n:
        gram, sums = gram - np.outer(counts, counts) / n, sums - counts * mean
    if alpha > 0:
        shares = np.linalg.solve(gram + alpha * np.eye(len(found)), sums)
    else:
        shares = np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ sums if found else sums
    base = float(mean - counts @ shares / n) if intercept and n else 0.0
    table = [(r.a.position, r.a.substituent, r.n, float(c)) for r, c in zip(found, shares, strict=True)]
    return df.sparkSession.createDataFrame([(None, None, n, base), *table], "position string, substituent string, n long, contribution double")


def predicted(df: DataFrame, effects: DataFrame, positions: list[str], name: str = "predicted") -> DataFrame:
    """The rows with their predicted value; a substituent that the fit hasn't seen adds nothing. Effects are at most MOST rows, so they are broadcast."""
    base = effects.where("position IS NULL").select(F.col("contribution").alias("fw_base"))
    out, parts = df.join(F.broadcast(base)), [F.col("fw_base")]  # one row
    for i, p in enumerate(positions):
        own = effects.where(F.col("position") == p).select(F.col("substituent").alias(f"fw_s{i}"), F.col("contribution").alias(f"fw_c{i}"))
        out = out.join(F.broadcast(own), F.col(p).cast("string") == F.col(f"fw_s{i}"), "left")
        parts.append(F.coalesce(f"fw_c{i}", F.lit(0.0)))
    return out.select(*df.columns, sum(parts[1:], parts[0]).alias(name))


def residuals(df: DataFrame, effects: DataFrame, positions: list[str], value: str) -> DataFrame:
    """The rows with predicted and residual, the largest absolute residual first."""
    return predicted(df, effects, positions).withColumn("residual", F.col(value) - F.col("predicted")).orderBy(F.abs("residual").desc_nulls_last())
