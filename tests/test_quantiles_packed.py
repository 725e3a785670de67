"""Regression quantiles: the table is read once for all of them, and together they are what each is alone."""

import numpy as np
import pytest

from actiscope.operators import gaussian


def test_quantiles_share_the_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 2))
    y = 1 + 2 * x[:, 0] + rng.standard_normal(400)
    d = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").repartition(3)
    cuts, cut = [], gaussian._cut
    monkeypatch.setattr(gaussian, "_cut", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(gaussian, "PACKED", 64)
    got = {r.id: (r.lower, r.upper) for r in gaussian.quantile_interval(d, d, "id", "x", "y", 0.1, 0.9).collect()}
    assert len(cuts) == 1
    alone = [gaussian.quantile_regression(d, "x", "y", q) for q in (0.1, 0.9)]
    for i in range(400):
        assert got[i] == pytest.approx([b[0] + x[i] @ b[1:] for b in alone], abs=1e-4)
    assert 0.75 < np.mean([lo <= y[i] <= hi for i, (lo, hi) in got.items()]) < 0.85
