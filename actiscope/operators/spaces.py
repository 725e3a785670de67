"""How well a projection keeps neighbourhoods, in the tiles of `distances`.

No matrix of all pairs is held or written: neighbours in the projection are the merged least distances of the tiles, and how many rows are closer in
the original space than each of them is a sum over tiles, too.  Tiles are matrix products; where their rounding could decide, distances are taken again from differences.
The work is rows x rows, as the definition is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import _cut
from .distances import _merged, _tiles, _whole

#: Distances that differ by less than this share are ties.
TIE = 1e-12
#: What rounding can add to a squared distance from a product, as a share of the vectors' squared lengths: many times what it does.
SLIP = 1e-12


def _slip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the squared distances of each row of a to rows of b may be off."""
    return SLIP * ((a * a).sum(1) + (b * b).sum(1).max())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a to the rows of b beside them, from differences."""
    return ((a - b) ** 2).sum(1)


def neighbours(df: DataFrame, idx: str, vec: str, k: int) -> DataFrame:
    """id, near: the ids of the k nearest other rows, ties by id. idx must be a unique long."""

    def work(d: np.ndarray, a: np.ndarray, b: np.ndarray, ids: pa.Array) -> pa.Array:
        others = ids.to_numpy()
        # A row's own distance is infinite.
        least = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        i, j = np.nonzero((d <= (least + 2 * _slip(a, b))[:, None]) & np.isfinite(d))
        far = _squares(a[i], b[j])
        order = np.lexsort((others[j], far, i))
        i, j, far = i[order], j[order], far[order]
        start = np.searchsorted(i, np.arange(len(a)))
        first = np.arange(len(i)) - start[i] < k
        ends = np.concatenate([[0], np.cumsum(np.bincount(i[first], minlength=len(a)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(far[first]), pa.array(others[j[first]])], ["d", "id"]))

    found, _ = _tiles(df, df, idx, vec, work, "array<struct<d:double,id:long>>", True)
    # k entries a row and group of blocks
    return _merged(found, lambda lists: F.slice(F.sort_array(F.flatten(lists)), 1, k)).select("id", F.transform("v", lambda s: s["id"]).alias("near"))


def _intrusions(df: DataFrame, k: int, p: int) -> DataFrame:
    """id, and for each of the k marks behind a vector x of p components how many other rows are closer than it."""

    def work(d: np.ndarray, part: np.ndarray, b: np.ndarray, _: pa.Array) -> pa.Array:
        a, marks = part[:, :p], part[:, p:] * (1 - TIE)
        slip = _slip(a, b)
        closer = np.empty(marks.shape, np.int64)
        for j in range(k):
            sure, open_ = d < (marks[:, j] - slip)[:, None], d < (marks[:, j] + slip)[:, None]
            closer[:, j] = np.count_nonzero(sure, axis=1)
            for r in np.nonzero(closer[:, j] != np.count_nonzero(open_, axis=1))[0]:
                near = np.nonzero(open_[r] & ~sure[r])[0]
                closer[r, j] += np.count_nonzero(_squares(a[r], b[near]) < marks[r, j])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, k, dtype=np.int32)), pa.array(closer.ravel()))

    found, _ = _tiles(df, df, "id", "x", work, "array<long>", False, "marked")
    # Every row has met itself once, which is closer than any mark above 0.
    own = lambda j: (F.element_at("marked", F.lit(p + j + 1)) * (1 - TIE) > 0).cast("long")
    sums = found.groupBy("id").agg(*[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(k)])
    return sums.join(df.select("id", *[own(j).alias(f"o{j}") for j in range(k)]), "id").select("id", *[(F.col(f"s{j}") - F.col(f"o{j}")).alias(f"c{j}") for j in range(k)])


def trustworthiness(df: DataFrame, idx: str, vec: str, embedding: str, k: int = 5) -> DataFrame:
    """n, trustworthiness: 1 - 2 / (n k (2n - 3k - 1)) times the sum of (rank - k) over projected neighbours that are no neighbours in the original space.

    Euclidean in both spaces.  A row's rank is 1 + the number of rows that are closer; rows that are equally far share the smaller rank.  Rows without
    either vector, or with components that are null or not finite, take no part; an empty table has the value null; k must be under half the rows.
    """
    d = df.where(_whole(vec) & _whole(embedding)).select(F.col(idx).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("x"), F.col(embedding).cast("array<double>").alias("e"))
    n, p = d.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return df.sparkSession.createDataFrame([(0, None)], "n long, trustworthiness double")
    if k < 1 or 2 * k >= n:
        raise ValueError(f"k must be at least 1 and under half of {n} rows")
    own = d.select("id", "x")
    near = neighbours(d, "id", "e", k).select("id", F.explode("near").alias("other"))
    far = F.aggregate(F.zip_with("x", "o", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    marks = near.join(own, "id").join(own.select(F.col("id").alias("other"), F.col("x").alias("o")), "other").groupBy("id").agg(F.collect_list(far).alias("marks"))  # k a row
    marked = _cut(own.join(marks, "id").select("id", "x", F.concat("x", "marks").alias("marked")))  # it is read as queries, as rows and for what a row adds itself
    over = sum((F.greatest(F.col(f"c{j}") + 1 - k, F.lit(0)) for j in range(k)), F.lit(0))
    total = _intrusions(marked, k, p).agg(F.sum(over).alias("total"))
    return total.select(F.lit(n).cast("long").alias("n"), (1 - F.col("total") * (2.0 / (n * k * (2 * n - 3 * k - 1)))).alias("trustworthiness"))
