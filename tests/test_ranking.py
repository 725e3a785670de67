"""Ranks and running sums in ranges against pandas."""

from pyspark.sql import functions as F

from actiscope.operators import classification, ranking, splits


def test_running_equals_one_window(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 7919 % 101).alias("k"), (F.col("id") % 5).alias("w")).repartition(13)
    got = ranking.running(d, ["k", "id"], {"r": F.lit(1).cast("long"), "s": F.col("w")}).toPandas().sort_values("r")
    want = d.toPandas().sort_values(["k", "id"], na_position="first")
    assert list(got.id) == list(want.id) and list(got.r) == list(range(1, 5001)) and list(got.s) == list(want.w.cumsum())


def test_a_hot_key_and_empty(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("k"))
    r = ranking.ranked(d, ["k", "id"], "r").toPandas().sort_values("id")
    assert list(r.r) == list(range(1, 3001))
    assert ranking.ranked(d.where("id < 0"), ["k"]).count() == 0
    plan = ranking.ranked(d, ["k", "id"], "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "r_range" in plan


def test_mean_ranks(spark):
    d = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (4, None), (5, 0.9)], "id int, x double")
    assert {r.id: r.k for r in ranking.mean_ranks(d, "x", "k").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: None, 5: 4.0}


def greedy(sizes, share=0.2):
    """The groups of the test set, one by one."""
    total = sum(sizes.values())
    target, used, test = total - max(1, round(total * share)), 0, set()
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if used + n <= target:
            used += n
        else:
            test.add(g)
    return test


def test_group_fill_equals_greedy(spark):
    for seed in range(4):
        sizes = {f"g{i:03d}": (i * 37 + seed * 11) % (3 + 4 * seed) + 1 for i in range(60)}
        rows = [(g,) for g, n in sizes.items() for _ in range(n)]
        d = spark.createDataFrame(rows, "g string")
        assert {r.g for r in splits.group_fill(d, "g").where("is_test").distinct().collect()} == greedy(sizes)


def test_balanced_and_sampled(spark):
    d = spark.range(100).select("id", F.when(F.col("id") < 90, "a").when(F.col("id") < 99, "b").alias("y"))
    assert {r.y: r["count"] for r in splits.balanced(d, "y", "id").groupBy("y").count().collect()} == {"a": 9, "b": 9}
    assert splits.sampled(d, "id", 7).count() == 7 and splits.sampled(d, "id", 700).count() == 100


def test_ranking_metrics_of_empty(spark):
    d = spark.createDataFrame([], "id int, y int, score double")
    assert classification.sweep(d).count() == 0 and classification.areas(d).first().roc_auc is None


def test_rows_without_a_score_rank_last(spark):
    d = spark.createDataFrame([(1, 1, None), (2, 0, 0.2), (3, 0, 0.1), (4, 1, 0.9)], "id int, y int, score double")
    assert classification.enrichment(d, fraction=0.5).first().ef == 1.0
    assert classification.enrichment(d, fraction=0.25).first().ef == 2.0
