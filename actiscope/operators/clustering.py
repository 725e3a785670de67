"""Greedy clusterings of a neighbour graph, in parallel rounds.

Both greedy methods visit rows in a fixed order and open a cluster at each row that no earlier centre covers.  The centres are thus the
first maximal independent set of the graph in that order, which rounds find exactly: an open row that precedes all its open neighbours is a centre,
its neighbours are covered.  Each round is a join over the edges; its result is checkpointed in the folder the session names.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder, which outlives executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def _both(pairs: DataFrame) -> DataFrame:
    """id, other, similarity in both directions, without loops."""
    a = pairs.where("a_id <> b_id")
    return a.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), "similarity").unionByName(a.select(F.col("b_id").alias("id"), F.col("a_id").alias("other"), "similarity"))


def centres(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, place of the rows that no earlier centre neighbours. nodes: id, place (unique, ascending); edges: id, other in both directions."""
    far = edges.select("id", "other").join(nodes.select(F.col("id").alias("other"), F.col("place").alias("other_place")), "other")
    # only edges to earlier rows can cover or hold back a row
    earlier = _cut(nodes.join(far, "id").where("other_place < place").select("id", "other"))
    state = _cut(nodes.select("id", "place", F.lit(0).alias("centre")))  # 0 open, 1 centre, -1 covered
    while state.where("centre = 0").limit(1).count():
        of = earlier.join(state.select(F.col("id").alias("other"), F.col("centre").alias("c")), "other")
        seen = of.groupBy("id").agg(F.max("c").alias("most"), F.count_if(F.col("c") == 0).alias("waiting"))
        found = F.when(F.col("centre") != 0, F.col("centre")).when(F.col("most") == 1, -1).when(F.coalesce("waiting", F.lit(0)) == 0, 1).otherwise(0)
        state = _cut(state.join(seen, "id", "left").select("id", "place", found.alias("centre")))
    return state.where("centre = 1").select("id", "place")


def _assigned(nodes: DataFrame, edges: DataFrame, heads: DataFrame, order: list[Column]) -> DataFrame:
    """id, centre: a centre is its own, other rows take the first neighbouring centre of an order."""
    h = heads.select(F.col("id").alias("other"), F.col("place").alias("head_place"))
    near = edges.join(h, "other").groupBy("id").agg(F.min_by("other", F.struct(*order)).alias("near"))
    own = heads.select("id", F.col("id").alias("own"))
    return nodes.select("id").join(own, "id", "left").join(near, "id", "left").select("id", F.coalesce("own", "near").alias("centre"))


def butina(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, centre: the row with the most neighbours opens the first cluster and takes them, ties to the smaller id; and so on.

    nodes: id (null ids go, repeated ids count once); pairs: a_id, b_id, similarity of all pairs within the cutoff. Rows without neighbours are singletons.
    """
    n = nodes.where("id IS NOT NULL").select("id").distinct()
    e = _cut(_both(pairs))
    degree = e.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    placed = n.join(degree, "id", "left").select("id", F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "id").alias("place"))
    return _assigned(n, e, centres(placed, e), [F.col("head_place")])


def leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, centre: rows in order of id open a cluster unless a leader is near; others go to their most similar leader, ties to the smaller id."""
    n = nodes.where("id IS NOT NULL").select("id").distinct()
    e = _cut(_both(pairs))
    return _assigned(n, e, centres(n.withColumn("place", F.col("id")), e), [-F.col("similarity"), F.col("head_place")])


def summary(clusters: DataFrame) -> DataFrame:
    """n_clusters, singletons, singleton_share, largest, mean_size."""
    g = clusters.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
    single = F.count_if(F.col("n") == 1)
    return g.agg(F.count(F.lit(1)).alias("n_clusters"), single.alias("singletons"), F.try_divide(single, F.count(F.lit(1))).alias("singleton_share"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"))
