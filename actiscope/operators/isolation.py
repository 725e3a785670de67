"""Isolation forest: rows that random cuts set apart early lie outside.

Every tree cuts a sample of at most `sample` training rows by a random feature at a random value until rows stand alone or the tree is as deep as the sample's logarithm.
A row is in a tree's sample by a hash of seed, tree and row: all rows are read once, each is sent to the few trees that may want it, and a tree takes
those of the smallest hashes.  So samples don't depend on the layout, and no more than a bounded number of rows meets in a task.  The trees, trees x 2 sample nodes at
most whatever the table, go to all tasks; scoring is a pass of array lookups, a level at a time for all trees.

score = 2 ** (-mean depth / c(sample)), near 1 for outliers, as published; the domain's limit is the quantile 1 - contamination of the training rows' scores.

Rows without a vector, or with components that are null or not finite, take no part. An empty training table gives null scores and decisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distances import _matrix, _vectors
from .ranking import quantiles

#: Euler's constant.
GAMMA = 0.5772156649015329


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """c(n): the mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + GAMMA) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grown(x: np.ndarray, rng: np.random.Generator, deepest: int) -> list[tuple[int, float, int, int, float]]:
    """A tree's nodes: feature (-1: a leaf), cut, left, right, and at a leaf its depth with what its rows would add."""
    nodes: list[tuple[int, float, int, int, float]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            f, cut, left, right, v = nodes[parent]
            nodes[parent] = (f, cut, me, right, v) if side == 0 else (f, cut, left, me, v)
        part = x[rows]
        low, high = part.min(0), part.max(0)
        uneven = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or not len(uneven):
            nodes.append((-1, 0.0, me, me, depth + float(mean_depth(len(rows)))))
            continue
        f = int(rng.choice(uneven))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append((f, cut, -1, -1, 0.0))
        below = part[:, f] <= cut
        todo += [(rows[~below], depth + 1, me, 1), (rows[below], depth + 1, me, 0)]
    return nodes


class Forest:
    """The trees as arrays, trees one after the other; roots: where each begins."""

    def __init__(self, nodes: pd.DataFrame, sample: int, deepest: int):
        nodes = nodes.sort_values(["tree", "node"])
        begin = nodes.groupby("tree").size().cumsum().shift(fill_value=0)
        base = nodes.tree.map(begin).to_numpy()
        self.roots = begin.to_numpy().astype(np.int64)
        self.feature, self.cut, self.depth = nodes.feature.to_numpy(), nodes["cut"].to_numpy(), nodes.depth.to_numpy()
        self.left, self.right = nodes.left.to_numpy() + base, nodes.right.to_numpy() + base
        self.sample, self.deepest = sample, deepest

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.deepest):
            f = self.feature[at]
            at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at]))
        c = float(mean_depth(self.sample))
        return 2.0 ** (-self.depth[at].mean(1) / c) if c else np.full(len(x), 0.5)


def forest(train: DataFrame, idx: str, vec: str, trees: int = 100, sample: int = 256, seed: int = 0) -> Forest | None:
    """A forest of the training rows; None for none."""
    rows = _vectors(train, idx, vec)
    n = rows.count()
    if not n:
        return None
    size = min(sample, n)
    deepest = math.ceil(math.log2(max(size, 2)))
    # About four times as many rows as a tree takes have a hash below this; the chance that fewer than it takes have is nil.
    below = min(1.0, 4 * size / n)
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), "id", "x"), F.lit(1 << 52)) / float(1 << 52)
    dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("u", spread).where(F.col("u") < below)
    order = Window.partitionBy("tree").orderBy("u", "x")  # some 4 x sample rows a tree
    chosen = dealt.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("tree", "r", "x")

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("r")
        tree = t.column("tree")[0].as_py()
        nodes = grown(_matrix(t.column("x")), np.random.default_rng([seed, tree]), deepest)
        cols = list(zip(*nodes, strict=True))
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
        return pa.table({"tree": pa.array([tree] * len(nodes), pa.int32()), "node": pa.array(range(len(nodes)), pa.int32())} | {k: pa.array(c, kind) for k, c, kind in zip(("feature", "cut", "left", "right", "depth"), cols, kinds, strict=True)})

    nodes = chosen.groupBy("tree").applyInArrow(grow, "tree int, node int, feature int, cut double, left int, right int, depth double").toPandas()
    return Forest(nodes, size, deepest)


def scored(df: DataFrame, idx: str, vec: str, found: Forest | None) -> DataFrame:
    """idx, score."""
    rows = _vectors(df, idx, vec)
    if found is None:
        return rows.select(F.col("id").alias(idx), F.lit(None).cast("double").alias("score"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.scores(_matrix(pa.chunked_array([part.column("x")]))))], ["id", "score"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", idx)


def isolation_domain(train: DataFrame, df: DataFrame, idx: str, vec: str, contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """idx, score, inside: at most the limit that the share of contamination of the training rows exceeds."""
    found = forest(train, idx, vec, trees, sample, seed)
    limit = quantiles(scored(train, idx, vec, found), "score", {"limit": 1 - contamination})
    return scored(df, idx, vec, found).join(F.broadcast(limit)).select(idx, "score", (F.col("score") <= F.col("limit")).alias("inside"))  # one row
