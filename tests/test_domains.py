"""Distances, picks, agglomeration, isolation forests, Gaussian processes and quantile regression against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiscope.operators import distances, gaussian, hierarchy, isolation


def frame(spark, x, ids=None, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame([*rows, *extra], "id long, x array<double>" if not rows or not isinstance(rows[0][0], str) else "id string, x array<double>")


def test_far_rows_repeated_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr(distances, "ROWS", 30)
    monkeypatch.setattr(distances, "CHUNK", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 4))
    train = frame(spark, x)
    asked = frame(spark, [[50.0] * 4, x[3], x[3] + 1, [0.0] * 4], [1, 1, 1, None], [(9, None), (9, [1.0, None, 0.0, 0.0])])
    d2 = lambda q: ((x - np.asarray(q)) ** 2).sum(1)
    for kernel, f in (("gaussian", lambda d: -d / 0.5), ("exponential", lambda d: -np.sqrt(d) / 0.5)):
        logs = lambda q: (m := f(d2(q)).max()) + math.log(np.exp(f(d2(q)) - m).sum() / 80)
        got = sorted(r.log_density for r in distances.density(asked, train, "id", "x", 0.5, kernel=kernel).collect())
        assert got == pytest.approx(sorted(logs(q) for q in ([50.0] * 4, x[3], x[3] + 1, [0.0] * 4)), rel=1e-9)
    domain = {(r.id, r.inside) for r in distances.density_domain(train, asked.where("id = 1"), "id", "x").collect()}
    assert (1, False) in domain and distances.bandwidth(train, "x") == pytest.approx(80 ** (-1 / 8))
    flat = sorted(r.log_density for r in distances.density(asked, train, "id", "x", 1.0, kernel="tophat").collect())
    assert flat[0] == float("-inf") and flat[-1] == pytest.approx(math.log(max((d2(q) < 1).sum() for q in (x[3], x[3] + 1, [0.0] * 4)) / 80))
    near = distances.nearest_distances(asked, train, "id", "x", 3).collect()
    assert len(near) == 4 and sorted(r.distances[0] for r in near)[-1] > 90
    named = frame(spark, x[:5], list("abcde"))
    got = {r.id: r.distances for r in distances.nearest_distances(named, named, "id", "x", 9, True).collect()}
    assert set(got) == set("abcde") and all(len(v) == 4 for v in got.values())
    none = train.where("false")
    assert [r.distances for r in distances.nearest_distances(asked, none, "id", "x", 3).collect()] == [[]] * 4
    assert {(r.distance, r.inside) for r in distances.knn_domain(none, asked, "id", "x").collect()} == {(None, None)}
    assert {(r.log_density, r.inside) for r in distances.density_domain(none, asked, "id", "x", 1.0).collect()} == {(None, None)}
    with pytest.raises(ValueError):
        distances.bandwidth(train, "x", "rule")


def picks_by_hand(x, n, metric, first):
    full = np.array([[metric(a, b) for b in x] for a in x])
    if first is None:
        i, j = np.unravel_index(np.round(full, 12).argmax(), full.shape)
        chosen = [int(i), int(j)]
    else:
        chosen = [first]
    while len(chosen) < min(n, len(x)):
        d = np.round(full[:, chosen].min(1), 12)
        d[chosen] = -1
        chosen.append(int(d.argmax()))
    return chosen


def test_picks(spark, monkeypatch):
    monkeypatch.setattr(distances, "LAG", 4)
    monkeypatch.setattr(distances, "ROWS", 10)
    euclid = lambda a, b: float(np.sqrt(((np.asarray(a) - np.asarray(b)) ** 2).sum()))
    jaccard = lambda a, b: 1 - (u := sum(p and q for p, q in zip(a, b, strict=True))) / w if (w := sum(bool(p or q) for p, q in zip(a, b, strict=True))) else 0.0  # noqa: E731, F841
    points = [(0, 0), (10, 0), (5, 8), (5, -1), (5, 0), (5, -0.5)]
    got = lambda d, *a, **k: [r.id for r in distances.picked(d, "id", "x", *a, **k).orderBy("pick").collect()]
    assert got(frame(spark, points), 3, "kennard_stone") == [0, 1, 2]
    square = list(itertools.product((0, 1, 2), (0, 1, 2)))  # many ties
    for n in (2, 9, 20):
        assert got(frame(spark, square), n, "kennard_stone") == picks_by_hand(square, n, euclid, None)
    x = np.random.default_rng(2).standard_normal((35, 3))
    assert got(frame(spark, x), 12, "kennard_stone") == picks_by_hand(x, 12, euclid, None)
    assert got(frame(spark, x), 6, seed=7) == picks_by_hand(x, 6, euclid, 7)
    bits = (np.random.default_rng(3).random((25, 12)) < 0.4).astype(float)
    assert got(frame(spark, bits), 7, metric="jaccard", seed=0) == picks_by_hand(bits, 7, jaccard, 0)
    split = {r.id: r.is_test for r in distances.diverse_split(frame(spark, x), "id", "x", 0.8).collect()}
    assert [i for i, t in sorted(split.items()) if not t] == sorted(picks_by_hand(x, 7, euclid, None)) and len(split) == 35
    one, none = frame(spark, x[:1]), frame(spark, [])
    assert got(one, 3, "kennard_stone") == [0] and got(none, 3) == [] and distances.farthest(one, "id", "x") is None
    with pytest.raises(ValueError):
        got(one, 1, seed=5)


def merges_by_hand(n, d, linkage, most):
    groups, out = {i: [i] for i in range(n)}, []
    fold = {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[linkage]
    while True:
        far = sorted((fold([d[p][q] for p in groups[a] for q in groups[b]]), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        if not far or far[0][0] >= most:
            return out, groups
        h, a, b = far[0]
        out.append((a, b, round(h, 9)))
        groups[a] += groups.pop(b)


@pytest.mark.parametrize("linkage", hierarchy.LINKAGES)
def test_agglomeration(spark, linkage):
    rng = np.random.default_rng(5)
    n = 18
    d = rng.random((n, n)) * 0.9
    d = np.where(rng.random((n, n)) < 0.35, 1.0, d)
    d = np.triu(d, 1) + np.triu(d, 1).T
    nodes = spark.range(n).select("id").union(spark.sql("SELECT 3L UNION ALL SELECT NULL"))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) if (i + j) % 2 else (j, i, float(d[i, j])) for i, j in itertools.combinations(range(n), 2) if d[i, j] < 1] + [(99, 1, 0.01)], "a_id long, b_id long, distance double")
    want, groups = merges_by_hand(n, d, linkage, 1.0)
    got = hierarchy.merges(nodes, pairs, linkage)
    assert sorted((r.a, r.b, round(r.height, 9)) for r in got.collect()) == sorted(want)
    _, cut = merges_by_hand(n, d, linkage, 0.5)
    found = {r.id: r.cluster for r in hierarchy.cut(nodes, got, threshold=0.5).collect()}
    assert found == {i: a for a, g in cut.items() for i in g}
    five = {r.id: r.cluster for r in hierarchy.cut(nodes, got, max(5, len(groups))).collect()}
    assert len(set(five.values())) == max(5, len(groups)) and len(five) == n
    assert hierarchy.merges(nodes, pairs.where("false"), linkage).count() == 0
    with pytest.raises(ValueError):
        hierarchy.merges(nodes, pairs, "ward")


def test_agglomeration_with_ties(spark):
    """All distances equal: one cluster in the end, in fewer rounds than merges."""
    pairs = spark.createDataFrame([(i, j, 0.5) for i, j in itertools.combinations(range(9), 2)], "a_id long, b_id long, distance double")
    assert {r.cluster for r in hierarchy.clusters(spark.range(9), pairs, "average", threshold=0.9).collect()} == {0}
    made = hierarchy.merges(spark.range(9), pairs, "single")
    assert made.count() == 8 and made.agg(F.max("round")).first()[0] < 8
    assert hierarchy.sizes(hierarchy.cut(spark.range(9), made, 4)).count() == 4


def test_isolation_forest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 4))
    train = frame(spark, x)
    found = isolation.forest(train, "id", "x", trees=20, sample=64, seed=3)
    again = isolation.forest(train.repartition(7, F.rand(1)), "id", "x", trees=20, sample=64, seed=3)
    assert len(found.roots) == 20 and found.deepest == 6 and (found.cut == again.cut).all()

    def depth(tree, row):
        at = found.roots[tree]
        while found.feature[at] >= 0:
            at = found.left[at] if row[found.feature[at]] <= found.cut[at] else found.right[at]
        return found.depth[at]

    c = float(isolation.mean_depth(64))
    want = [2 ** (-np.mean([depth(t, r) for t in range(20)]) / c) for r in x]
    got = {r.id: r.score for r in isolation.scored(train, "id", "x", found).collect()}
    assert [got[i] for i in range(500)] == pytest.approx(want)
    asked = frame(spark, [[50.0] * 4, x[0] * 0], [1, 1], [(2, None)])
    domain = isolation.isolation_domain(train, asked, "id", "x", trees=50)
    assert sorted((r.score, r.inside) for r in domain.collect())[0][1] is True and sorted((r.score, r.inside) for r in domain.collect())[1][1] is False and domain.count() == 2
    share = isolation.isolation_domain(train, train, "id", "x", 0.1, 30).where("NOT inside").count() / 500
    assert abs(share - 0.1) < 0.02
    assert {(r.score, r.inside) for r in isolation.isolation_domain(train.where("false"), asked, "id", "x").collect()} == {(None, None)}
    same = isolation.isolation_domain(frame(spark, [[1.0, 2.0]] * 5), frame(spark, [[1.0, 2.0]]), "id", "x", trees=5).collect()
    assert same[0].inside


def test_trees_separate_planted_rows():
    x = np.vstack([np.zeros((60, 2)) + np.random.default_rng(0).normal(0, 0.1, (60, 2)), [[9.0, 9.0]]])
    nodes = isolation.grown(x, np.random.default_rng(1), 6)
    leaves = [n for n in nodes if n[0] < 0]
    assert len(nodes) == 2 * len(leaves) - 1 and min(n[4] for n in leaves) <= 2


def test_gaussian_process_is_exact_with_all_landmarks(spark):
    rng = np.random.default_rng(7)
    bits = (rng.random((60, 20)) < 0.3).astype(float)
    bits = np.unique(bits, axis=0)
    y = bits[:, 0] * 2 - bits[:, 1] + rng.normal(0, 0.1, len(bits))
    train = spark.createDataFrame([(i, b.tolist(), float(v)) for i, (b, v) in enumerate(zip(bits, y, strict=True))] + [(900, None, 1.0), (901, bits[0].tolist(), None)], "id long, x array<double>, y double")
    asked = (rng.random((15, 20)) < 0.3).astype(float)
    k = gaussian.tanimoto
    a = k(bits, bits) + 0.05 * np.eye(len(bits))
    mean = y.mean() + k(asked, bits) @ np.linalg.solve(a, y - y.mean())
    var = 1 - np.einsum("ij,ji->i", k(asked, bits), np.linalg.solve(a, k(bits, asked))) + 0.05
    model = gaussian.process(train, "id", "x", "y", noise=0.05, landmarks=len(bits))
    got = {r.id: r for r in model.predict(frame(spark, asked), "id", "x").collect()}
    assert [got[i].prediction for i in range(15)] == pytest.approx(mean, abs=1e-4) and [got[i].sd for i in range(15)] == pytest.approx(np.sqrt(var), abs=1e-3)
    few = gaussian.process(train, "id", "x", "y", gaussian.gaussian(2.0), 0.05, 20)
    assert len(few.landmarks) <= 20 and all(r.sd >= math.sqrt(0.05) - 1e-9 for r in few.predict(frame(spark, asked), "id", "x").collect())
    assert k(np.zeros((1, 3)), np.zeros((1, 3)))[0, 0] == 1
    with pytest.raises(ValueError):
        gaussian.process(train.where("false"), "id", "x", "y")


def test_quantile_regression_covers(spark):
    rng = np.random.default_rng(8)
    x = rng.random((2000, 2))
    y = 1 + 2 * x[:, 0] + (0.2 + x[:, 1]) * rng.exponential(1, 2000)
    d = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    for q in (0.1, 0.5):
        beta = gaussian.quantile_regression(d, "x", "y", q)
        r = y - beta[0] - x @ beta[1:]
        assert abs((r <= 1e-6).mean() - q) < 0.01
        loss = lambda b: np.maximum(q * (y - b[0] - x @ b[1:]), (q - 1) * (y - b[0] - x @ b[1:])).sum()
        assert all(loss(beta) <= loss(beta + step) + 0.05 for step in 0.02 * np.vstack([np.eye(3), -np.eye(3)]))
    inside = gaussian.quantile_interval(d, d, "id", "x", "y", 0.05, 0.95).join(d, "id").where("y BETWEEN lower AND upper").count()
    assert abs(inside / 2000 - 0.9) < 0.015
