"""Feature selection by refitting: recursive elimination and shadow features.

Both fit one of `models`' learners again and again on the rows of the table; only importances, one number a component, reach the driver.  Rows without a vector or a target, or
with components that are null or not finite, take no part. Ties among importances go against the later component.
"""

from __future__ import annotations

import math
import random
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models
from .clustering import _cut
from .distances import _whole
from .ranking import ranked


def kept(vec: str, components: list[int]) -> Column:
    """The chosen components of a vector, in their order."""
    return F.transform(F.array(*[F.lit(c) for c in components]), lambda i: F.get(F.col(vec), i))


def importances(model: models.Fitted) -> list[float]:
    """A fitted learner's importance of each component: of its trees, or the size of its coefficients."""
    m = model.model
    if hasattr(m, "featureImportances"):
        return [float(v) for v in m.featureImportances.toArray()]
    if hasattr(m, "coefficients"):
        return [abs(float(v)) for v in m.coefficients.toArray()]
    raise ValueError(f"{type(m).__name__} has no importances")


def _known(df: DataFrame, vec: str, label: str) -> tuple[DataFrame, int]:
    d = df.where(_whole(vec) & F.col(label).isNotNull())
    first = d.select(F.size(vec).alias("p")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    return d, first.p


def eliminated(df: DataFrame, vec: str, label: str, n: int | float | None = None, step: int | float = 1, kind: str = "forest", classes: bool = False, **options: Any) -> list[tuple[int, int]]:
    """(component, rank) by component: rank 1 is kept, the higher the earlier a component went.

    n: components to keep, or a share of them (half, if None); step: how many go in a round, or a share of all.  A round is a fit on the components that are left.
    """
    d, p = _known(df, vec, label)
    d = _cut(d.select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")))
    target = p // 2 if n is None else max(1, int(p * n)) if isinstance(n, float) else n
    many = max(1, int(p * step)) if isinstance(step, float) else step
    if not 0 < target <= p or many < 1:
        raise ValueError(f"{target} of {p} components by steps of {many} can't be kept")
    left, gone = list(range(p)), []
    while len(left) > target:
        model = models.fitted(d.select(kept("x", left).alias("x"), "y"), "x", "y", kind, classes, **options)
        order = sorted(range(len(left)), key=lambda j, v=importances(model): (v[j], -j))
        out = {left[j] for j in order[: min(many, len(left) - target)]}
        gone.append(sorted(out))
        left = [c for c in left if c not in out]
    rank = dict.fromkeys(left, 1) | {c: len(gone) - i + 1 for i, cs in enumerate(gone) for c in cs}
    return sorted(rank.items())


def two_sided(hits: int, trials: int) -> float:
    """The probability of a number of hits of a fair coin that is no likelier than this one."""
    p = [math.comb(trials, i) for i in range(trials + 1)]
    return min(1.0, sum(v for v in p if v <= p[hits]) / 2**trials)


def shadowed(df: DataFrame, idx: str, vec: str, label: str, rounds: int = 100, alpha: float = 0.05, kind: str = "forest", classes: bool = False, seed: int = 0, **options: Any) -> list[tuple[int, int, str]]:
    """(component, hits, decision) by component: Confirmed, Rejected or Tentative.

    In each round every row also has the components of another row, its shadows: rows lie on a ring of hashes of the id, and a round takes the row a random number of places
    further, so shadows are as the components are, but know nothing of the target.  A component hits if the learner finds it more important than every shadow.  It is confirmed (rejected) if that many
    (few) hits of a fair coin have a probability under alpha, divided by the number of components.  The ring is ranked in ranges once; a round is a join by rank and a fit.
    """
    d, p = _known(df, vec, label)
    d = d.select(F.xxhash64(F.lit(seed), F.col(idx).cast("string")).alias("h"), F.col(idx).cast("string").alias("i"), F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    ring = _cut(ranked(d, ["h", "i", "y"], "r").select("r", "x", "y"))
    n = ring.count()
    rng = random.Random(seed)
    hits = [0] * p
    for _ in range(rounds):
        far = rng.randrange(1, n) if n > 1 else 0
        other = ring.select(F.col("x").alias("shadow"), ((F.col("r") - 1 + far) % n + 1).alias("o"))
        # Merged: as a broadcast, the ring would pass through the driver in every round.
        both = ring.join(other.hint("merge"), F.col("r") == F.col("o")).select(F.concat("x", "shadow").alias("x"), "y")
        v = importances(models.fitted(both, "x", "y", kind, classes, **options))
        limit = max(v[p:])
        hits = [h + (x > limit) for h, x in zip(hits, v[:p], strict=True)]
    out = []
    for c, h in enumerate(hits):
        sure = two_sided(h, rounds) < alpha / p
        out.append((c, h, "Confirmed" if sure and 2 * h > rounds else "Rejected" if sure and 2 * h < rounds else "Tentative"))
    return out
