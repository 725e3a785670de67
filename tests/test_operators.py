"""Hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from actiscope.functions import numeric
from actiscope.operators import classification, curation, domain, regression, similarity, splits


def one(df):
    return df.first().asDict()


def test_regression(spark):
    pairs = lambda t, p: spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p, strict=True)], "y_true double, y_pred double")
    r = one(regression.report(pairs([1, 2, 3], [1, 2, 5])))
    assert r["mse"] == pytest.approx(4 / 3) and r["press"] == 4
    assert one(regression.report(pairs([1, 2, 3], [2, 3, 4])))["bias"] == 1
    assert one(regression.report(pairs([1, 2, 3], [1, 2, 4])))["r2"] == pytest.approx(0.5)
    assert one(regression.report(pairs([1, 2], [2, 2])))["k"] == pytest.approx(6 / 5)
    assert one(regression.report(pairs([2, 2], [2, 2])))["ccc"] == 1
    assert one(regression.error_of_estimate(pairs([1, 2, 3, 4], [1, 2, 3, 5]), 1))["see"] == pytest.approx(0.70710678)
    q = one(regression.external(pairs([2, 4], [2, 3]), pairs([0, 2, 4], [0, 0, 0])))
    assert q["q2_f1"] == pytest.approx(0.75) and q["q2_f3"] == pytest.approx(0.8125)
    assert regression.report(pairs([], [])).count() == 0


def test_classification(spark):
    c = one(classification.confusion(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, pred int")))
    assert (c["tp"], c["tn"], c["fp"], c["fn"]) == (1, 2, 0, 1)
    assert c["mcc"] == pytest.approx(2 / math.sqrt(12)) and c["kappa"] == pytest.approx(0.5) and c["f1"] == pytest.approx(2 / 3)
    s = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.4), (3, 1, 0.6), (4, 1, 0.9)], "id int, y int, score double")
    a = one(classification.areas(s))
    assert a["roc_auc"] == 1 and a["pr_auc"] == 1
    best = {r.criterion: r.threshold for r in classification.optimal(s).collect()}
    assert best["youden"] == pytest.approx(0.6)
    rows = [(i, int(i < 2), 0.9 if i == 0 else 0.8 if i == 1 else 0.1) for i in range(10)]
    assert one(classification.enrichment(spark.createDataFrame(rows, "id int, y int, score double"), fraction=0.2))["ef"] == pytest.approx(5)
    rows = [(i, int(i < 5), 100.0 - i) for i in range(100)]
    assert one(classification.enrichment(spark.createDataFrame(rows, "id int, y int, score double")))["bedroc"] > 0.99


def test_curation(spark):
    rep = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 6.0), ("a", 3, 8.0), (None, 4, 1.0), ("b", 5, 10.0), ("b", 6, 1000.0)], "key string, id int, y double")
    merged = {m: {r.key: r.value for r in curation.merge_replicates(rep, "key", "id", "y", m, None).collect()} for m in curation.MERGE}
    assert [merged[m]["a"] for m in ("mean", "median", "min", "max")] == [6, 6, 4, 8] and merged["geometric_mean"]["b"] == pytest.approx(100) and merged["mean"][None] == 1
    assert "b" not in {r.key for r in curation.merge_replicates(rep, "key", "id", "y", "mean", 5.0).collect()}
    act = spark.createDataFrame([(i, 5 + i / 100) for i in range(20)] + [(20, 50.0)], "id int, y double")
    for method, limit in (("zscore", 3.0), ("modified_zscore", 3.5), ("iqr", 1.5)):
        assert 20 in {r.id for r in curation.outlier_scores(act, "y", method).where(F.col("score") > limit).collect()}
    feat = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("a", 0), ("a", 0), ("b", 1)], "f string, y int")
    assert one(curation.representation_conflicts(feat, ["f"], "y"))["irreducible_errors"] == 2


def test_similarity_and_splits(spark):
    fp = spark.createDataFrame([(0, [0, 1]), (1, [0]), (2, [5])], "id int, bits array<int>")
    assert [tuple(r) for r in similarity.similar_pairs(fp, 0.5).collect()] == [(0, 1, 0.5)]
    d = spark.range(10).withColumn("g", F.when(F.col("id") < 6, "a").when(F.col("id") < 8, "b").otherwise("c"))
    assert {r.g for r in splits.group_fill(d, "g").where("is_test").collect()} == {"c"}
    assert splits.random_split(d, "id", 0.2).where("is_test").count() == 2
    assert sorted(r[1] for r in splits.folds(d, "id", 3).groupBy("fold").count().collect()) == [3, 3, 4]


def test_domain_and_units(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [50.0, 1.0])], "id int, v array<double>")
    out = {r.id: r.inside for r in domain.range_domain(v.where("id < 5"), v, "id", "v").collect()}
    assert out[0] and not out[9]
    r = spark.sql("SELECT 1.0D AS x").select(numeric.p_activity(F.col("x"), F.lit("nM")).alias("p")).first()
    assert r.p == pytest.approx(9)
