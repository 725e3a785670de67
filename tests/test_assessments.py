"""Additive effects, normal quantiles, trustworthiness, reports and stages against plain Python."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiscope.operators import additive, classification, curation, domain, neighbours, preparation, residuals, spaces


@pytest.mark.parametrize(("alpha", "intercept"), [(0.0, True), (0.0, False), (0.7, True), (0.7, False)])
def test_additive_effects(spark, alpha, intercept):
    r = np.random.default_rng(3)
    rows = [(i, "abc"[r.integers(3)], None if i % 9 == 0 else "xyzw"[r.integers(4)], float(r.normal())) for i in range(80)]
    df = spark.createDataFrame([*rows, (80, "a", "x", None), (81, "a", "x", float("nan"))], "id long, r1 string, r2 string, y double")
    names = [("r1", s) for s in "abc"] + [("r2", s) for s in "wxyz"]
    x = np.array([[float(a == s if p == "r1" else b == s) for p, s in names] for _, a, b, _ in rows])
    y = np.array([row[3] for row in rows])
    mx, my = (x.mean(0), y.mean()) if intercept else (0 * x[0], 0.0)
    if alpha:
        want = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(7), (x - mx).T @ (y - my))
    else:
        want = np.linalg.lstsq(x - mx, y - my, rcond=1e-8)[0]
    effects = additive.fit(df, ["r1", "r2"], "y", alpha, intercept)
    got = {(e.position, e.substituent): e.contribution for e in effects.collect()}
    assert [got[n] for n in names] == pytest.approx(want, abs=1e-9)
    assert got[None, None] == pytest.approx(my - mx @ want, abs=1e-9)
    new = additive.predicted(spark.createDataFrame([(1, "a", "none"), (2, None, "x")], "id long, r1 string, r2 string"), effects, ["r1", "r2"])
    assert {e.id: e.predicted for e in new.collect()} == pytest.approx({1: got[None, None] + got["r1", "a"], 2: got[None, None] + got["r2", "x"]})
    far = [abs(e.residual) for e in additive.residuals(df.where("id < 80"), effects, ["r1", "r2"], "y").collect()]
    assert len(far) == 80 and far == sorted(far, reverse=True)


def test_additive_limits(spark):
    df = spark.createDataFrame([(str(i), 1.0) for i in range(5)], "r string, y double")
    with pytest.raises(ValueError, match="more than 4"):
        additive.fit(df, ["r"], "y", most=4)
    assert [tuple(e) for e in additive.fit(df.limit(0), ["r"], "y").collect()] == [(None, None, 0, 0.0)]


def test_normal_quantile(spark):
    at = [1e-300, 1e-30, 1e-12, 1e-5, 0.01, 0.0749, 0.0751, 0.2, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in [*at, 0.0, 1.0, None]], "p double")
    got = {e.p: e.z for e in df.select("p", residuals.normal_quantile(F.col("p")).alias("z")).collect()}
    assert [got[p] for p in at] == pytest.approx([NormalDist().inv_cdf(p) for p in at], rel=1e-12, abs=1e-14)
    assert got[0.0] is None and got[1.0] is None and got[None] is None


def test_quantile_points(spark):
    rows = [(1, 3.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 0.0), (4, None, 0.0), (5, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, y double, p double")
    got = {e.id: (e.sample, e.theoretical) for e in residuals.points(df, "y", "p", "id").collect()}
    spread = np.std([3, 1, 1], ddof=1)
    z = [NormalDist().inv_cdf((i - 0.375) / 3.25) for i in (1, 2, 3)]
    assert got[2] == pytest.approx((-2 / 3 / spread, z[0])) and got[3] == pytest.approx((-2 / 3 / spread, z[1])) and got[1] == pytest.approx((4 / 3 / spread, z[2])) and len(got) == 3
    assert residuals.points(df.limit(0), "y", "p", "id").count() == 0
    equal = spark.createDataFrame([(i, 2.0, 1.0) for i in range(4)], "id long, y double, p double")
    assert {e.sample for e in residuals.points(equal, "y", "p", "id").collect()} == {0.0}


@pytest.mark.parametrize("seed", [0, 1])
def test_trustworthiness(spark, seed):
    r = np.random.default_rng(seed)
    n, k = 1500, 4
    x = r.normal(size=(n, 7))
    x[5:9] = x[4]
    e = x[:, :2] + r.normal(size=(n, 2)) / 3
    df = spark.createDataFrame([(i, x[i].tolist(), e[i].tolist()) for i in range(n)] + [(n, None, [0.0, 0.0]), (n + 1, [float("nan")] * 7, [0.0, 0.0])], "id long, x array<double>, e array<double>")
    dx, de = (((v[:, None] - v) ** 2).sum(2) for v in (x, e))
    np.fill_diagonal(dx, np.inf)
    np.fill_diagonal(de, np.inf)
    total = 0
    for i in range(n):
        for j in np.lexsort((np.arange(n), de[i]))[:k]:
            total += max(0, 1 + int((dx[i] < dx[i, j] * (1 - 1e-12)).sum()) - k)
    got = spaces.trustworthiness(df, "id", "x", "e", k).first()
    assert got.n == n and got.trustworthiness == pytest.approx(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * total, abs=1e-12)


def test_trustworthiness_cases(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)], "id long, x array<double>")
    assert spaces.trustworthiness(df, "id", "x", "x", 2).first().trustworthiness == 1.0
    assert spaces.trustworthiness(df.limit(0), "id", "x", "x", 2).first().trustworthiness is None
    with pytest.raises(ValueError, match="half"):
        spaces.trustworthiness(df, "id", "x", "x", 4)


def test_threshold_report(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.1), (None, 0.3), (1, None)], "y int, score double")
    got = {e.criterion: e for e in classification.threshold_report(df).collect()}
    assert set(got) == {"youden", "f1", "mcc", "balanced_accuracy", "default_0.5"}
    half = got["default_0.5"]  # the lowest threshold at 0.5 or above is 0.8
    assert (half.threshold, half.sensitivity, half.specificity, half.precision) == (0.5, 0.5, 0.5, 0.5)
    assert (got["f1"].threshold, got["f1"].f1) == (0.4, pytest.approx(0.8))
    assert (half.n_samples, half.base_rate, half.roc_auc) == (4, 0.5, 0.75)
    low = classification.threshold_report(df.where("score < 0.5 OR y IS NULL"))
    assert {e.criterion: e.sensitivity for e in low.collect()}["default_0.5"] == 0.0
    assert {e.threshold for e in classification.threshold_report(df.limit(0)).collect()} == {None, 0.5}


def test_curated(spark):
    rows = [(1, "a", 1.0), (2, "a", 1.4), (3, "b", 1.0), (4, "b", 9.0), (5, None, 1.1), (6, "c", None), (7, "d", 1.3), (8, "e", 50.0), (9, "f", 1.2)]
    df = spark.createDataFrame(rows, "id long, k string, y double")
    out, report = curation.curated(df, "k", "id", "y", valid=F.col("y") > 0, outliers="modified_zscore")
    assert sorted(e.first for e in out.collect()) == [1, 5, 7, 9]
    assert [(e.stage, e.n, e.removed) for e in report.orderBy("place").collect()] == [("input", 9, 0), ("valid", 8, 1), ("merged", 5, 3), ("without outliers", 4, 1)]
    assert [e.n for e in curation.curated(df.limit(0), "k", "id", "y")[1].collect()] == [0, 0, 0]


def test_voted(spark):
    flags = lambda *f: spark.createDataFrame(list(enumerate(f)), "id long, inside boolean")
    members = {"a": flags(True, True, False, False), "b": flags(True, False, False, False), "c": flags(True, True, True, False)}
    kept = lambda how: [e.inside for e in neighbours.voted(members, "id", how).orderBy("id").collect()]
    assert kept("majority") == [True, True, False, False]
    assert kept("unanimous") == [True, False, False, False]
    assert kept("any") == [True, True, True, False]


def test_gram_plans(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 5)) + 1e6
    x[:, 4] = x[:, 0] + r.normal(size=200) / 100
    x[:, 2] = 3.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, [1.0, None, 1.0, 1.0, 1.0])], "id long, v array<double>")
    assert [e.dim for e in preparation.correlation_filter(df, "id", "v", 0.9).orderBy("dim").collect()] == [0, 1, 3]
    assert preparation.correlation_filter(df.limit(0), "id", "v", 0.9).count() == 0
    z = np.where(x == 3.0, 3.0, x - 1e6)
    small = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, v array<double>")
    want = np.einsum("ij,jk,ik->i", z, np.linalg.pinv(z.T @ z), z)
    got = {e.id: e.leverage for e in domain.leverage_domain(small, small, "id", "v").collect()}
    assert [got[i] for i in range(200)] == pytest.approx(want, rel=1e-6)
    assert domain.leverage_domain(small.limit(0), small.limit(0), "id", "v").count() == 0
