"""Recursive elimination and shadow features keep what was planted."""

import numpy as np
import pytest

from actiscope.operators import selection


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 6))
    y = 3 * x[:, 1] - 2 * x[:, 4] + 0.2 * rng.standard_normal(400)
    rows = [(i, r.tolist(), float(v), float(v > 0)) for i, (r, v) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1.0), (901, [1.0] * 6, None, None), (902, [float("nan")] * 6, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double, c double").coalesce(2).cache()


def test_elimination(planted):
    rank = dict(selection.eliminated(planted, "x", "y", 2, 2, "linear"))
    assert {c for c, r in rank.items() if r == 1} == {1, 4} and sorted(rank.values()) == [1, 1, 2, 2, 3, 3]
    assert {c for c, r in selection.eliminated(planted, "x", "c", 0.34, 0.5, "forest", True, numTrees=10) if r == 1} == {1, 4}
    assert [r for _, r in selection.eliminated(planted, "x", "y", 6)] == [1] * 6
    for n in (0, 7):
        with pytest.raises(ValueError):
            selection.eliminated(planted, "x", "y", n)
    with pytest.raises(ValueError):
        selection.eliminated(planted.where("false"), "x", "y")
    assert planted.where("id = 0").select(selection.kept("x", [4, 1]).alias("k"), "x").first().k == [planted.where("id = 0").first().x[i] for i in (4, 1)]


def test_shadows(planted):
    out = selection.shadowed(planted, "id", "x", "y", 12, numTrees=8, maxDepth=4)
    assert [c for c, _, d in out if d == "Confirmed"] == [1, 4] and all(h == 12 for c, h, _ in out if c in (1, 4))
    assert sum(d == "Rejected" for *_, d in out) >= 1 and all(h < 12 for c, h, _ in out if c not in (1, 4))
    assert selection.two_sided(0, 10) == pytest.approx(2 / 1024) and selection.two_sided(5, 10) == 1 and selection.two_sided(1, 10) == pytest.approx(22 / 1024)
