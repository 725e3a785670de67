"""Tiles in groups: what they leave doesn't grow with the blocks, and ties of the farthest pair go to the smallest ids."""

import numpy as np
import pytest

from actiscope.operators import distances, spaces


def test_a_query_leaves_a_row_for_each_group(spark, monkeypatch):
    monkeypatch.setattr(distances, "ROWS", 5)
    monkeypatch.setattr(distances, "GROUPS", 3)
    x = np.random.default_rng(1).standard_normal((100, 3))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    left, merged = [], distances._merged
    monkeypatch.setattr(distances, "_merged", lambda found, merge: left.append(found.count()) or merged(found, merge))
    got = {r.id: r.distances for r in distances.nearest_distances(d, d, "id", "x", 4, True).collect()}
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(full, np.inf)
    assert left[0] <= 300 and len(got) == 100 and all(got[i] == pytest.approx(np.sort(full[i])[:4], abs=1e-9) for i in got)


def test_ties_of_the_farthest_pair(spark, monkeypatch):
    monkeypatch.setattr(distances, "ROWS", 30)
    rows = [(i, [float(i % 2), 0.5]) for i in range(100)]
    d = spark.createDataFrame(rows[::-1], "id long, x array<double>")
    assert distances.farthest(d, "id", "x") == (0, 1)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_ranks_of_tied_and_close_rows(spark, monkeypatch, shift):
    """Products of far vectors lose what differences keep; equal rows, ties and own rows count as they do by the definition."""
    monkeypatch.setattr(distances, "ROWS", 11)
    r = np.random.default_rng(5)
    x = np.round(r.standard_normal((60, 4)), 1) + shift
    x[:9], e = x[9:18], np.round(r.standard_normal((60, 2)), 1) + shift
    k, n = 3, 60
    d, f = ((x[:, None] - x[None]) ** 2).sum(2), ((e[:, None] - e[None]) ** 2).sum(2)
    total = 0
    for i in range(n):
        near = sorted((f[i, j], j) for j in range(n) if j != i)[:k]
        total += sum(max(0, 1 + sum(d[i, o] < d[i, j] * (1 - 1e-12) for o in range(n) if o != i) - k) for _, j in near)
    df = spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, e))], "id long, x array<double>, e array<double>")
    got = spaces.trustworthiness(df, "id", "x", "e", k).first()
    assert got.trustworthiness == pytest.approx(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * total, abs=1e-12)


def test_ranks_shuffle_a_table_once_a_group(spark, monkeypatch):
    """Not once a block."""
    monkeypatch.setattr(distances, "ROWS", 5)
    monkeypatch.setattr(distances, "GROUPS", 2)
    met = []
    tiles = spaces._tiles
    monkeypatch.setattr(spaces, "_tiles", lambda *a, **k: met.append(tiles(*a, **k)) or met[-1])
    d = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, x array<double>")
    spaces.trustworthiness(d, "id", "x", "x", 2).first()
    assert len(met) == 2 and all(found.count() <= 120 for found, _ in met)
