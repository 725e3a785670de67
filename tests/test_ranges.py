"""Ranks and sums in ranges, whatever the keys, and the resamples that rest on sums."""

import random

from pyspark.sql import functions as F

from actiscope.operators import linear, ranking


def test_ranks_of_any_keys(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1.0, 2.0, float("nan"), -3.5]), None if i % 11 == 0 else (r.choice([None, "a", "b"]), i), i) for i in range(400)]
    d = spark.createDataFrame(rows, "a double, s struct<x:string,y:int>, i int").repartition(5)
    got = {x.i: x["rank"] for x in ranking.ranked(d, ["a", "s", "i"]).collect()}
    nan = lambda v: (v is not None, v if v == v and v is not None else 9e9 if v is not None else 0)
    key = lambda t: (nan(t[0]), t[1] is not None, (t[1][0] is not None, t[1][0] or "", t[1][1]) if t[1] else (), t[2])
    assert got == {t[2]: k for k, t in enumerate(sorted(rows, key=key), 1)}


def test_bounds_are_no_constants_of_the_plan(spark):
    d = spark.range(3000).select(F.struct((F.col("id") % 7).alias("a"), "id").alias("k"))
    assert len(ranking.ranked(d, ["k"])._jdf.queryExecution().analyzed().toString()) < 6000


def test_a_table_of_one_task_is_resampled_on_all_cores(spark):
    d = spark.range(500).coalesce(1).select("id", (F.col("id") % 97).cast("double").alias("x"), F.sin("id").alias("y"))
    assert linear._dealt(d).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r.iteration: r for r in linear.bootstrap(d, "y", ["x"], "id", 3).collect()}
    each = d.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("w", linear._poisson(linear._uniform(F.col("it"), "id")))
    for i in range(3):
        rows = [(r.x, r.y, r.w) for r in each.where(F.col("it") == i).collect()]
        n = sum(w for _, _, w in rows)
        mx, my = sum(x * w for x, _, w in rows) / n, sum(y * w for _, y, w in rows) / n
        b = sum(w * (x - mx) * (y - my) for x, y, w in rows) / sum(w * (x - mx) ** 2 for x, _, w in rows)
        out = [(x, y) for x, y, w in rows if not w]
        mean = sum(y for _, y in out) / len(out)
        r2 = 1 - sum((my + b * (x - mx) - y) ** 2 for x, y in out) / sum((y - mean) ** 2 for _, y in out)
        assert got[i].n_out == len(out) and abs(got[i].r2 - r2) < 1e-9
