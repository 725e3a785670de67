"""What the most similar references say: votes, means, novelty, coverage. All start from query_id, rank, ref_id, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import closest, nearest


def vote(near: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, label, share: the class of the largest summed similarity, ties to the smallest class. labels: id, label."""
    v = near.join(labels.select(F.col("id").alias("ref_id"), "label"), "ref_id").groupBy("query_id", "label").agg(F.round(F.sum("similarity"), 9).alias("w"))
    g = v.groupBy("query_id").agg(F.max(F.struct("w", (-F.col("label")).alias("low"))).alias("top"), F.sum("w").alias("all"))
    return g.select("query_id", (-F.col("top.low")).alias("label"), F.try_divide(F.col("top.w"), F.col("all")).alias("share"))


def mean(near: DataFrame, values: DataFrame) -> DataFrame:
    """query_id, value: the mean of the neighbours' values, weighted by similarity. values: id, value."""
    j = near.join(values.select(F.col("id").alias("ref_id"), "value"), "ref_id").where("value IS NOT NULL")
    return j.groupBy("query_id").agg(F.try_divide(F.sum(F.col("similarity") * F.col("value")), F.sum("similarity")).alias("value"))


def closeness(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """id, similarity: the mean similarity of the k nearest others; those that share no bit count as 0, as do missing ones."""
    g = closest(queries, refs).withColumnRenamed("similarity", "s") if k == 1 else nearest(queries, refs, k).groupBy(F.col("query_id").alias("id")).agg((F.sum("similarity") / k).alias("s"))
    return queries.select("id").join(g, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("similarity"))


def novelty(queries: DataFrame, refs: DataFrame, k: int = 1) -> DataFrame:
    """id, novelty: 1 - closeness."""
    return closeness(queries, refs, k).select("id", (1 - F.col("similarity")).alias("novelty"))


def similarity_domain(queries: DataFrame, refs: DataFrame, k: int = 1, threshold: float = 0.3) -> DataFrame:
    """id, similarity, inside: close enough to the training rows."""
    return closeness(queries, refs, k).withColumn("inside", F.col("similarity") >= threshold)


def redundancy(library: DataFrame, threshold: float = 0.9) -> DataFrame:
    """share: of rows whose nearest other is at least that similar."""
    return closeness(library, library, 1).agg(F.avg((F.col("similarity") >= threshold).cast("double")).alias("share"))


def coverage(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """a_covered, b_covered, a_mean, b_mean: how much of each set lies near the other."""
    covered = lambda: F.avg((F.col("similarity") >= threshold).cast("double"))
    side = lambda x, y, s: closeness(x, y, 1).agg(covered().alias(f"{s}_covered"), F.avg("similarity").alias(f"{s}_mean"))
    return side(a, b, "a").join(F.broadcast(side(b, a, "b"))).select("a_covered", "b_covered", "a_mean", "b_mean")  # one row each


def voted(members: dict[str, DataFrame], idx: str, voting: str = "majority") -> DataFrame:
    """idx, a flag per member domain, outside (share of members that a row lies outside of), inside by majority, unanimous or any vote; rows that all members know."""
    out = None
    for name, d in members.items():
        flags = d.select(idx, F.col("inside").alias(name))
        out = flags if out is None else out.join(flags, idx)
    return out.withColumn("outside", outside_share([F.col(name) for name in members])).withColumn("inside", F.col("outside") <= {"majority": 0.5, "unanimous": 0.0, "any": 1 - 1e-9}[voting])


def outside_share(flags: list[Column]) -> Column:
    """The share of domains that a row lies outside of; majority, unanimous and any vote are limits of 0.5, 0 and just under 1."""
    return sum(((~f).cast("double") for f in flags), F.lit(0.0)) / len(flags)
