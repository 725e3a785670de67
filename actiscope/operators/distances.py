"""Distances of rows to all rows of a training table, in tiles, and the domains that rest on them.

Both sides are packed into blocks of about ROWS vectors, and blocks are dealt into GROUPS groups a side (more, where a group would exceed BLOCKS blocks).  Every group of queries
meets every group of training rows once, as matrix products, and leaves only what is asked for: the k least distances of each query, a sum of kernels, or the farthest row.
So a table is shuffled once a group, and the rest grows with the rows.  A task holds one group of training rows and one block of queries at a time, and nothing but the number of blocks
reaches the driver.  The work is queries x training rows: that is the operator's nature.  What the groups leave of a query, one row each, is merged at last.

Defined cases: rows without a vector, or with components that are null or not finite, take no part. Rows are told apart by their own number, so ids of any
type may repeat or be null: each row has its result. An empty training table gives every query an empty list of distances, and null distances, densities and decisions.
Vectors of different lengths end the job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clustering import _cut
from .ranking import quantiles

ROWS = 2048
#: Groups of blocks a side, blocks of a group at most, and cells of a product (64 queries at least).
GROUPS, BLOCKS, CELLS = 8, 64, 1 << 21


def _whole(vec: str) -> Column:
    x = F.col(vec).cast("array<double>")
    return F.col(vec).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _vectors(df: DataFrame, idx: str, vec: str) -> DataFrame:
    return df.where(_whole(vec)).select(F.col(idx).alias("id"), F.col(vec).cast("array<double>").alias("x"))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    n = len(col)
    return np.asarray(col.combine_chunks().flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _blocks(df: DataFrame, idx: str, vec: str, name: str) -> tuple[DataFrame, int]:
    """A row per block: its number, ids and the vectors as one binary of doubles; and the number of blocks. Rows are dealt by id and vector."""
    rows = _vectors(df, idx, vec)
    kind = rows.schema["id"].dataType.simpleString()
    n = -(-rows.count() // ROWS)
    dealt = rows.withColumn("h", F.xxhash64("id", "x")).withColumn("b", F.pmod("h", F.lit(max(1, n))).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")  # a block is the same whenever it is made
        ids = t.column("id").combine_chunks()
        return pa.table({name: pa.array([t.column("b")[0].as_py()], pa.int32()), f"{name}_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), f"{name}_x": pa.array([_matrix(t.column("x")).astype("<f8").tobytes()], pa.binary())})

    return dealt.groupBy("b").applyInArrow(pack, f"{name} int, {name}_ids array<{kind}>, {name}_x binary"), n


def _met(queries: DataFrame, train: DataFrame, idx: str, query_vec: str, train_vec: str) -> tuple[DataFrame, int]:
    """q, q_ids, q_x, t, t_ids, t_x: every block of queries beside every block of training rows; and the number of training blocks."""
    q, nq = _blocks(queries, idx, query_vec, "q")
    t, nt = _blocks(train, idx, train_vec, "t")
    pairs = q.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(max(0, nt - 1))))).join(t, F.col("m") == F.col("t"))
    tasks = max(1, min(nq * nt, 100_000))
    return pairs.repartition(tasks, "q", "m").select("q", "q_ids", "q_x", "t", "t_ids", "t_x"), nt


def _grouped(n: int) -> int:
    return max(1, min(n, GROUPS), -(-n // BLOCKS))


def _tiles(queries: DataFrame, train: DataFrame, idx: str, vec: str, work: Callable, kind: str, same: bool, query_vec: str | None = None) -> tuple[DataFrame, int]:
    """q, i (a query's block and place), id, v: what work(distances squared, queries, training rows, their ids) gives, a row for each group of training rows; and the number of training blocks.

    With `same`, both sides are one table and a row isn't its own neighbour. Vectors of queries (query_vec) may have more components than take part in distances.
    """
    (q, nq), (t, nt) = _blocks(queries, idx, query_vec or vec, "q"), _blocks(train, idx, vec, "t")
    gq, gt = _grouped(nq), _grouped(nt)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # One key for each two groups; its training rows come first.
    t = t.withColumn("m", every(gq)).select((F.col("m") * gt + F.col("t") % gt).alias("key"), F.lit(0).alias("side"), F.col("t").alias("block"), F.col("t_ids").alias("ids"), F.col("t_x").alias("x"))
    q = q.withColumn("m", every(gt)).select((F.col("q") % gq * gt + F.col("m")).alias("key"), F.lit(1).alias("side"), F.col("q").alias("block"), F.col("q_ids").alias("ids"), F.col("q_x").alias("x"))
    met = t.unionByName(q).repartition(min(gq * gt, 100_000), "key").sortWithinPartitions("key", "side", "block")
    id_kind = queries.schema[idx].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, b = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                key, block, ids = batch.column("key")[r].as_py(), batch.column("block")[r].as_py(), batch.column("ids")[r].values
                x = np.frombuffer(batch.column("x")[r].as_py(), "<f8").reshape(len(ids), -1)
                if key != group:
                    group, kept, b = key, [], None
                if not batch.column("side")[r].as_py():
                    kept.append((block, ids, x))
                    continue
                if not kept:
                    continue
                if b is None:
                    b, t_ids = np.vstack([k[2] for k in kept]), pa.concat_arrays([k[1] for k in kept])
                    first = dict(zip([k[0] for k in kept], np.cumsum([0, *[len(k[1]) for k in kept]]).tolist(), strict=False))
                    kept, b2 = [(name, None, None) for name, *_ in kept], (b * b).sum(1)
                chunk = max(64, CELLS // len(b))
                for s in range(0, len(x), chunk):
                    part = x[s : s + chunk]
                    a = part if query_vec is None else part[:, : b.shape[1]]
                    d = np.maximum((a * a).sum(1)[:, None] + b2 - 2 * a @ b.T, 0)
                    n = len(part)
                    if same and block in first:
                        own = np.arange(n)
                        d[own, own + s + first[block]] = np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(s, s + n, dtype=np.int32)), ids.slice(s, n), work(d, part, b, t_ids)], ["q", "i", "id", "v"])

    return met.mapInArrow(run, f"q int, i int, id {id_kind}, v {kind}"), nt


def _merged(found: DataFrame, merge: Callable[[Column], Column]) -> DataFrame:
    """id, v: a query's values, merged over the groups."""
    return found.groupBy("q", "i").agg(F.first("id").alias("id"), merge(F.collect_list("v")).alias("v")).select("id", "v")


def _exact(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Distances of rows of a to some rows of b each; the product form loses digits where rows are close."""
    return np.sqrt(((a[:, None] - b[near]) ** 2).sum(2))


def nearest_distances(queries: DataFrame, train: DataFrame, idx: str, vec: str, k: int, same: bool = False) -> DataFrame:
    """idx, distances: the k least Euclidean distances to training rows (all, if fewer), ascending."""

    def least(d: np.ndarray, a: np.ndarray, b: np.ndarray, _: pa.Array) -> pa.Array:
        near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        far = _exact(a, b, near)
        far[~np.isfinite(np.take_along_axis(d, near, 1))] = np.inf
        return pa.array([row[np.isfinite(row)] for row in np.sort(far, axis=1)], pa.list_(pa.float64()))

    found, nt = _tiles(queries, train, idx, vec, least, "array<double>", same)
    if not nt:
        return _vectors(queries, idx, vec).select(F.col("id").alias(idx), F.array().cast("array<double>").alias("distances"))
    return _merged(found, lambda lists: F.slice(F.sort_array(F.flatten(lists)), 1, k)).select(F.col("id").alias(idx), F.col("v").alias("distances"))


def knn_domain(train: DataFrame, df: DataFrame, idx: str, vec: str, k: int = 5, percentile: float = 0.95) -> DataFrame:
    """idx, distance (mean to the k nearest training rows), inside: within the percentile of the training rows' own, each without itself."""
    mean = lambda d: d.select(idx, F.try_divide(F.aggregate("distances", F.lit(0.0), lambda s, v: s + v), F.size("distances")).alias("distance"))
    limit = quantiles(mean(nearest_distances(train, train, idx, vec, k, True)), "distance", {"limit": percentile})
    return mean(nearest_distances(df, train, idx, vec, k)).join(F.broadcast(limit)).select(idx, "distance", (F.col("distance") <= F.col("limit")).alias("inside"))  # one row


def _gaussian(d: np.ndarray, w: float) -> np.ndarray:
    return -d / (2 * w * w)


def _inside(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, float], np.ndarray]:
    """The logarithm of a kernel of u = distance / width that is 0 from 1 on."""

    def logarithm(d: np.ndarray, w: float) -> np.ndarray:
        u = np.sqrt(d) / w
        return np.log(np.where(u < 1, f(np.minimum(u, 1)), 0))

    return logarithm


#: Logarithms of kernels, from squared distances and a width, without their constants.
KERNELS = {"gaussian": _gaussian, "exponential": lambda d, w: -np.sqrt(d) / w, "tophat": _inside(np.ones_like), "epanechnikov": _inside(lambda u: 1 - u * u), "linear": _inside(lambda u: 1 - u), "cosine": _inside(lambda u: np.cos(u * np.pi / 2))}


def bandwidth(train: DataFrame, vec: str, rule: str = "scott") -> float:
    """The width by a rule of thumb, from the numbers of rows and of components: scott or silverman."""
    n, s, _ = moments(train, vec)
    p = len(s)
    if rule not in ("scott", "silverman"):
        raise ValueError(f"no rule {rule}")
    return max(n, 1) ** (-1 / (p + 4)) if rule == "scott" else (max(n, 1) * (p + 2) / 4) ** (-1 / (p + 4))


def density(df: DataFrame, train: DataFrame, idx: str, vec: str, width: float | str = "scott", same: bool = False, kernel: str = "gaussian") -> DataFrame:
    """idx, log_density: of the mean kernel over the training rows, without its constant.

    Every block leaves its largest logarithm and the sum relative to it, so rows however far have a density; -infinity beyond the reach of all kernels.
    """
    w = bandwidth(train, vec, width) if isinstance(width, str) else float(width)
    of = KERNELS[kernel]

    def sums(d: np.ndarray, a: np.ndarray, b: np.ndarray, _: pa.Array) -> pa.Array:
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = of(d, w)
            top = logs.max(1)
            total = np.where(np.isfinite(top), np.exp(logs - top[:, None]).sum(1), 0.0)
        return pa.StructArray.from_arrays([pa.array(top), pa.array(np.nan_to_num(total))], ["top", "total"])

    def merge(parts: Column) -> Column:
        top = F.array_max(F.transform(parts, lambda e: e["top"]))
        # An entry without a finite top has total 0.
        total = F.aggregate(parts, F.lit(0.0), lambda s, e: s + F.when(e["total"] == 0, 0.0).otherwise(e["total"] * F.exp(e["top"] - top)))
        return F.struct(top.alias("top"), total.alias("total"))

    found, nt = _tiles(df, train, idx, vec, sums, "struct<top:double,total:double>", same)
    if not nt:
        return _vectors(df, idx, vec).select(F.col("id").alias(idx), F.lit(None).cast("double").alias("log_density"))
    n = train.where(_whole(vec)).agg(F.count(F.lit(1)).alias("n"))
    log = F.when(F.col("v.total") > 0, F.col("v.top") + F.log(F.col("v.total") / F.col("n"))).otherwise(float("-inf"))
    return _merged(found, merge).join(F.broadcast(n)).select(F.col("id").alias(idx), log.alias("log_density"))  # one row


def density_domain(train: DataFrame, df: DataFrame, idx: str, vec: str, width: float | str = "scott", percentile: float = 0.05, kernel: str = "gaussian") -> DataFrame:
    """idx, log_density, inside: at the percentile of the training rows' own density or above."""
    w = bandwidth(train, vec, width) if isinstance(width, str) else width
    limit = quantiles(density(train, train, idx, vec, w, kernel=kernel), "log_density", {"limit": percentile})
    return density(df, train, idx, vec, w, kernel=kernel).join(F.broadcast(limit)).select(idx, "log_density", (F.col("log_density") >= F.col("limit")).alias("inside"))


def farthest(df: DataFrame, idx: str, vec: str) -> tuple[object, object] | None:
    """The ids of the two rows farthest from each other, ties to the smallest ids; None for fewer than two rows. Distances count to 12 digits; a row is a candidate where its block reaches the farthest so far."""

    reached = [0.0]

    def most(d: np.ndarray, a: np.ndarray, b: np.ndarray, ids: pa.Array) -> pa.Array:
        d[~np.isfinite(d)] = -1
        top = d.max(1)
        reached[0] = max(reached[0], float(top.max()))
        # What the product form may lose: rows and others within it are compared exactly, rows below it can't be the farthest.
        least = max(0.0, reached[0] - 1e-11 * float((a * a).sum(1).max() + (b * b).sum(1).max()))
        far, other = np.full(len(d), -1.0), [None] * len(d)
        for r in np.flatnonzero(top >= least).tolist():
            near = np.flatnonzero(d[r] >= least)
            exact = np.round(np.sqrt(((a[r] - b[near]) ** 2).sum(1)), 12)
            far[r] = exact.max()
            other[r] = min((x for x in ids.take(pa.array(near[exact == far[r]])).to_pylist()), key=lambda x: (x is not None, x))
        return pa.StructArray.from_arrays([pa.array(far), pa.array(other, ids.type)], ["far", "other"])

    kind = df.schema[idx].dataType.simpleString()
    found, _ = _tiles(df, df, idx, vec, most, f"struct<far:double,other:{kind}>", True)
    low, high = F.least("id", "v.other"), F.greatest("id", "v.other")
    r = found.where("v.far >= 0").select(F.round("v.far", 12).alias("far"), low.alias("low"), high.alias("high")).orderBy(F.desc("far"), "low", "high").first()
    return (r.low, r.high) if r else None


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products of the vectors' components: one partial Gram matrix a task, (p + 1)^2 numbers reach the driver."""
    rows = df.where(_whole(vec)).select(F.col(vec).cast("array<double>").alias("x"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.hstack([np.ones((len(b), 1)), np.vstack(b.x.to_numpy())])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.reshape(-1)})

    got = rows.mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    p = int(round(np.sqrt(len(got))))
    g = got.v.to_numpy().reshape(p, p) if p else np.zeros((1, 1))
    return int(g[0, 0]), g[0, 1:], g[1:, 1:]


def components(train: DataFrame, vec: str, share: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, principal axes (columns) that hold a share of the variance, and their variances; signs so that the largest entry is positive."""
    n, s, ss = moments(train, vec)
    mean = s / max(n, 1)
    values, axes = np.linalg.eigh(ss / max(n, 1) - np.outer(mean, mean))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    keep = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12)) + 1
    axes = axes[:, :keep] * np.sign(axes[np.abs(axes[:, :keep]).argmax(0), np.arange(min(keep, axes.shape[1]))])
    return mean, axes, values[:keep]


def projected(df: DataFrame, idx: str, vec: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """idx, scores on the axes."""
    d = df.where(_whole(vec)).select(F.col(idx).alias("id"), F.col(vec).cast("array<double>").alias("x"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b.id, "scores": list((np.vstack(b.x.to_numpy()) - mean) @ axes)})

    return d.mapInPandas(work, f"id {d.schema['id'].dataType.simpleString()}, scores array<double>").withColumnRenamed("id", idx)


def component_domain(train: DataFrame, df: DataFrame, idx: str, vec: str, share: float = 0.95) -> DataFrame:
    """idx, outside (axes out of the training range), inside: the box of the training rows' principal scores."""
    from .domain import range_domain

    mean, axes, _ = components(train, vec, share)
    return range_domain(projected(train, idx, vec, mean, axes), projected(df, idx, vec, mean, axes), idx, "scores", 1e-9)


#: Picks that a row's kept distance may lag behind.
LAG = 16


def _gap(metric: str, x: Column, v: list[float]) -> Column:
    """The distance of a vector column to a vector; jaccard takes components as set where they aren't 0."""
    lit = F.array(*[F.lit(float(e)) for e in v])
    add = lambda s, e: s + e
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(x, lit, lambda a, b: (a - b) * (a - b)), F.lit(0.0), add))
    if metric != "jaccard":
        raise ValueError(f"no metric {metric}")
    both = F.aggregate(F.zip_with(x, lit, lambda a, b: F.when((a != 0) & (b != 0), 1.0).otherwise(0.0)), F.lit(0.0), add)
    either = F.aggregate(F.zip_with(x, lit, lambda a, b: F.when((a != 0) | (b != 0), 1.0).otherwise(0.0)), F.lit(0.0), add)
    return F.coalesce(1 - F.try_divide(both, either), F.lit(0.0))


def picked(df: DataFrame, idx: str, vec: str, n: int, how: str = "maxmin", metric: str = "euclidean", seed: object = None) -> DataFrame:
    """idx, pick: n rows far from each other, one after the other, each the farthest from all before; ties to the smallest id.

    maxmin begins with the row of an id (seed), or with that nearest to the centre; kennard_stone with the two ends of the longest distance of all.  Rows keep their distance
    to the picks: each pick is a pass over the table that compares it with at most LAG new vectors, and every LAG picks the kept distance is written.  As picks
    follow from each other there are as many passes as picks: for tables from which few rows are picked, or small ones. Ids mustn't repeat: rows of one id are picked together.
    """
    rows = _vectors(df, idx, vec)
    kind = rows.schema["id"].dataType.simpleString()
    count, s, _ = moments(df, vec)
    if not count:
        return rows.select(F.col("id").alias(idx), F.lit(0).alias("pick")).limit(0)
    state = _cut(rows.withColumn("d", F.lit(float("inf"))))
    ends = farthest(df, idx, vec) if how == "kennard_stone" else None
    if ends:
        found = {r.id: r for r in rows.where(F.col("id").isin(*ends)).select("id", "x").collect()}
        chosen = [found[e] for e in ends][: max(n, 1)]
    elif seed is not None:
        chosen = rows.where(F.col("id") == seed).select("id", "x").take(1)
    else:
        centre = s / count
        chosen = rows.withColumn("d", _gap("euclidean", F.col("x"), list(centre))).orderBy("d", "id").select("id", "x").take(1)
    if not chosen:
        raise ValueError(f"no row {seed}")
    fresh = list(chosen)
    while len(chosen) < min(n, count):
        least = F.least("d", *[_gap(metric, F.col("x"), c.x) for c in fresh])
        left = state.where(~F.col("id").isin([c.id for c in fresh])).withColumn("d", least)
        if len(fresh) >= LAG:
            state, fresh = _cut(left), []
            best = state.orderBy(F.desc("d"), "id").select("id", "x").first()
        else:
            best = left.orderBy(F.desc("d"), "id").select("id", "x").first()
        if best is None:
            break
        chosen.append(best)
        fresh.append(best)
    return df.sparkSession.createDataFrame([(c.id, i) for i, c in enumerate(chosen, 1)], f"{idx} {kind}, pick int")


def diverse_split(df: DataFrame, idx: str, vec: str, test_share: float = 0.2, how: str = "kennard_stone", metric: str = "euclidean", seed: object = None) -> DataFrame:
    """idx, is_test: rows that are picked as far from each other as they come train, the others test; as many as the share rounds to (half to even)."""
    rows = _vectors(df, idx, vec)
    n = rows.count()
    train = n - round(n * test_share)
    picks = picked(df, idx, vec, train, how, metric, seed).select(F.col(idx).alias("p_id"))
    return rows.join(picks, F.col("id") == F.col("p_id"), "left").select(F.col("id").alias(idx), F.col("p_id").isNull().alias("is_test"))
