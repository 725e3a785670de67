"""Clusterings, sources and structures against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiscope.operators import clustering, domain, preparation, structures, uncertainty
from actiscope.sources import smiles


def graph(seed, n=60, edges=120):
    r = np.random.default_rng(seed)
    return {tuple(sorted(map(int, p))): float(s) for p, s in zip(r.integers(0, n, (edges, 2)), r.integers(1, 9, edges) / 10, strict=True) if p[0] != p[1]}


def greedy(n, sims, order, nearest):
    near = {i: {} for i in range(n)}
    for (a, b), s in sims.items():
        near[a][b] = near[b][a] = s
    heads = []
    for i in order(near):
        if not set(near[i]) & set(heads):
            heads.append(i)
    return {i: i if i in heads else min((h for h in near[i] if h in heads), key=lambda h: nearest(near[i][h], heads.index(h))) for i in range(n)}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusterings(spark, seed):
    sims = graph(seed)
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a_id long, b_id long, similarity double")
    nodes = spark.range(60)
    got = lambda df: {r.id: r.centre for r in df.collect()}
    assert got(clustering.butina(nodes, pairs)) == greedy(60, sims, lambda near: sorted(near, key=lambda i: (-len(near[i]), i)), lambda s, k: k)
    assert got(clustering.leaders(nodes, pairs)) == greedy(60, sims, sorted, lambda s, k: (-s, k))


def test_clusters_of_no_pairs(spark):
    none = spark.createDataFrame([], "a_id long, b_id long, similarity double")
    c = clustering.butina(spark.range(3), none)
    assert clustering.summary(c).first()[:3] == (3, 3, 1.0)
    assert clustering.butina(spark.range(0), none).count() == 0


def test_leverage_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(40, 4))
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, [None, 1.0, 1.0, 1.0])], "id int, v array<double>")
    got = {r.id: r for r in domain.leverage_domain(d, d, "id", "v").collect()}
    want = np.einsum("ij,jk,ik->i", x, np.linalg.pinv(x.T @ x), x)
    assert 99 not in got and np.allclose([got[i].leverage for i in range(40)], want)
    assert [got[i].inside for i in range(40)] == list(want <= 3 * 5 / 40)
    assert domain.leverage_domain(d.where("id < 0"), d.where("id < 0"), "id", "v").count() == 0


def test_correlated_columns_go(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=50), r.normal(size=50)
    d = spark.createDataFrame([(i, [float(a[i]), 3.0, float(-2 * a[i] + 1), float(b[i])]) for i in range(50)], "id int, v array<double>")
    assert [x.dim for x in preparation.correlation_filter(d, "id", "v").collect()] == [0, 3]


def test_conformal_p(spark):
    cal = spark.createDataFrame([(0.1,), (0.5,), (0.5,), (0.9,)], "s double")
    d = spark.createDataFrame([(1, 0.5), (2, 0.95), (3, 0.0)], "id int, s double")
    assert {r.id: r.p for r in uncertainty.conformal_p_values(cal, d, "s").collect()} == {1: 0.8, 2: 0.2, 3: 1.0}


def test_structures(spark):
    d = spark.createDataFrame([(1, "CC(=O)[O-].[Na+]"), (2, "[NH4+]"), (3, "C[N+](C)(C)CC([O-])=O"), (4, None), (5, "[Ca++]")], "id int, s string")
    got = {r.id: r for r in d.select("id", structures.largest_fragment(F.col("s")).alias("f"), structures.heavy_atoms(F.col("s")).alias("n"), structures.charge(F.col("s")).alias("q")).collect()}
    assert got[1].f == "CC(=O)[O-]" and got[1].n == 5 and got[1].q == 0
    assert (got[2].n, got[2].q, got[3].q, got[5].q, got[4].f) == (1, 1, 0, 2, None)
    assert {r.id for r in structures.valid(d, "id", "s").collect()} == {3}


def test_smiles_files(spark, tmp_path):
    (tmp_path / "a.smi").write_text("# comment\nCCO ethanol of mine\n\nc1ccccc1\n")
    d = smiles.read_smiles(spark, str(tmp_path / "a.smi"))
    assert sorted(map(tuple, d.collect()), key=str) == [("CCO", "ethanol of mine"), ("c1ccccc1", None)]
    smiles.write_smiles(d, str(tmp_path / "out"), name="name")
    assert sorted(map(tuple, smiles.read_smiles(spark, str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, d.collect()), key=str)


def test_sdf(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("one\n\n\n  0  0\nM  END\n>  <y>\n5.1\n\n>  <note>\ntwo\nlines\n\n$$$$\nnext\n\n\n  0  0\nM  END\n$$$$\n")
    got = {r.name: r.properties for r in smiles.read_sdf(spark, str(tmp_path / "a.sdf")).collect()}
    assert got == {"one": {"y": "5.1", "note": "two\nlines"}, "next": {}}
