"""Linear models against numpy, landscapes against all pairs, streams against batches, pipes and sources."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiscope.operators import landscape, linear
from actiscope.plans.pipe import Pipe, pipeline, step
from actiscope.sources import smiles
from actiscope.streaming import metrics


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 3)) + [1000.0, -5.0, 0.0]
    y = x @ [2.0, -1.0, 0.5] + 7 + r.normal(scale=0.3, size=90)
    rows = [(i, i % 4, float(y[i]), *map(float, x[i])) for i in range(90)]
    return x, y, spark.createDataFrame(rows, "id long, fold int, y double, a double, b double, c double")


def ridge(x, y, alpha=0.0):
    m = x.mean(0)
    b = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
    return y.mean() - b @ m, b


@pytest.mark.parametrize("alpha", [0.0, 3.0])
def test_fit_and_folds(data, alpha):
    x, y, df = data
    m = linear.fit(df, "y", ["a", "b", "c"], alpha)
    a, b = ridge(x, y, alpha)
    assert np.allclose([m.intercept, *m.coefficients], [a, *b], rtol=1e-7)
    got = {r.id: r.y_pred for r in linear.cross_validated(df, "y", ["a", "b", "c"], "fold", alpha).collect()}
    for k in range(4):
        own = np.arange(90) % 4 == k
        a, b = ridge(x[~own], y[~own], alpha)
        assert np.allclose([got[i] for i in np.flatnonzero(own)], a + x[own] @ b)


def test_linear_edges(spark, data):
    _, _, df = data
    copies = df.withColumn("d", F.col("a") * 2)
    m = linear.fit(copies, "y", ["a", "d"])
    assert m.coefficients[1] == pytest.approx(2 * m.coefficients[0])  # the shortest solution
    holes = df.union(spark.createDataFrame([(90, 1, None, 1.0, 1.0, 1.0), (91, 1, 1.0, None, 1.0, 1.0), (92, None, 1.0, 1.0, 1.0, 1.0), (93, 1, float("nan"), 1.0, 1.0, 1.0)], df.schema))
    out = {r.id: r.y_pred for r in linear.cross_validated(holes, "y", ["a", "b", "c"], "fold").collect()}
    assert out[91] is None and out[92] is None and out[90] is not None and len(out) == 94
    empty = df.limit(0)
    assert linear.cross_validated(empty, "y", ["a"], "fold").count() == 0
    assert linear.bootstrap(empty, "y", ["a"], "id", 5).count() == 0
    assert linear.y_scrambling(empty, "y", ["a"], "id", 5).count() == 0
    assert np.isnan(linear.fit(empty, "y", ["a"]).intercept)
    one = linear.cross_validated(df.withColumn("fold", F.lit(0)), "y", ["a"], "fold")
    assert one.where("y_pred IS NOT NULL").count() == 0  # nothing to learn from


def test_scrambling_is_a_permutation(data):
    _, y, df = data
    rows = linear.scrambled(df, "y", "id", 3).collect()
    for it in range(3):
        mine = [r.y for r in sorted((r for r in rows if r.iteration == it), key=lambda r: r.id)]
        assert sorted(mine) == sorted(y.tolist()) and mine != y.tolist()
    row = linear.y_scrambling(df, "y", ["a", "b"], "id", 19).first()
    assert row.p_value == pytest.approx(1 / 20) and row.largest < row.real


def test_bootstrap(data):
    _, _, df = data
    s = linear.bootstrap(df, "y", ["a", "b", "c"], "id", 30)
    rows = s.collect()
    assert len(rows) == 30 and all(0.8 < r.r2 <= 1 and 15 < r.n_out < 55 for r in rows)
    t = linear.bootstrap_summary(s).first()
    assert t.lower <= t.mean <= t.upper


def test_consensus_and_baseline(spark):
    df = spark.createDataFrame([(1.0, 4.0), (None, 4.0), (None, None)], "p double, q double")
    assert [r.c for r in df.select(linear.consensus(["p", "q"], [2.0, 1.0]).alias("c")).collect()] == [2.0, 4.0, None]
    with pytest.raises(ValueError):
        linear.consensus(["p"], [0.0])
    labels = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "y string")
    assert linear.baseline(labels, "y", "classification").first().value == "a"


def test_sari_counts_all_pairs(spark):
    r = np.random.default_rng(1)
    sets = [sorted(set(map(int, r.integers(0, 20, 5)))) for _ in range(25)]
    val = [float(v) for v in r.integers(4, 9, 25)]
    fp = spark.createDataFrame(list(enumerate(sets)), "id long, bits array<int>")
    got = landscape.sari(fp, spark.createDataFrame(list(enumerate(val)), "id long, value double"), 0.3).first()
    num = den = 0.0
    jumps = []
    for i, j in itertools.combinations(range(25), 2):
        s = len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
        w, d = (val[i] + val[j]) / 2, abs(val[i] - val[j])
        num, den = num + w * s, den + w * (1 + d)
        jumps += [d * s] * (s >= 0.3)
    assert got.continuity == pytest.approx(num / den) and got.discontinuity == pytest.approx(min(1, np.mean(jumps) / 3))
    empty = landscape.sari(fp.limit(0), spark.createDataFrame([], "id long, value double")).first()
    assert (empty.continuity, empty.discontinuity) == (0.0, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(1700000000 + id * 97) AS ts, id % 7 * 1.0 AS y, id % 5 * 1.0 AS p, cast(id % 2 AS int) AS l, cast(id % 3 = 0 AS int) AS q FROM range(400)")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, f in {"reg": lambda d: metrics.regression_windows(d, "ts", "y", "p"), "conf": lambda d: metrics.confusion_windows(d, "ts", "l", "q")}.items():
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        key = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
        assert key(spark.table(name)) == key(f(rows)) and spark.table(name).count() > 5


def test_pipe(spark):
    @step("y")
    def more(df, by=1):
        return df.withColumn("y", F.col("y") + by)

    @step()
    def only(df, least):
        return df.where(F.col("y") >= least)

    p = more(by=2) >> only(4)
    df = spark.createDataFrame([(1,), (2,)], "y int")
    assert [r.y for r in p(df).collect()] == [4] and p.history == ["more(by=2)", "only(4)"]
    assert pipeline(more(), p).history == ["more()", *p.history] and Pipe()(df) is df
    assert p.to_dot().count("->") == 2
    with pytest.raises(ValueError, match="needs columns y"):
        p(df.withColumnRenamed("y", "z"))


def test_sd_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("one\n\n\n  0  0", {"b": "2", "a": "x\n\ny"}), ("two\n\n\n  0  0", None), (None, None)], "block string, properties map<string,string>")
    smiles.write_sdf(df, str(tmp_path / "sd"), properties="properties")
    got = {r.name: (r.block.rstrip("\n"), r.properties) for r in smiles.read_sdf(spark, str(tmp_path / "sd")).collect()}
    assert got == {"one": ("one\n\n\n  0  0", {"a": "x\ny", "b": "2"}), "two": ("two\n\n\n  0  0", {})}
    (tmp_path / "t.csv").write_text('smiles,y,note\nCCO,5.1,"a, ""b"""\nCC,none,\n')
    rows = smiles.read_table(spark, str(tmp_path / "t.csv"), activity="y").collect()
    assert [(r.smiles, r.y, r.note) for r in rows] == [("CCO", 5.1, 'a, "b"'), ("CC", None, None)]
    with pytest.raises(ValueError):
        smiles.read_table(spark, str(tmp_path / "t.csv"), smiles="s")


def test_scrambling_is_scored_out_of_fold(spark):
    r = np.random.default_rng(8)
    x, y = r.normal(size=(40, 12)), r.normal(size=40)
    names = [f"x{i}" for i in range(12)]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(40)], ["id", "y", *names])
    row = linear.y_scrambling(df, "y", names, "id").first()
    inside = linear.y_scrambling(df, "y", names, "id", folds=0).first()
    fold = np.array([int(hashlib.md5(f"fold:{i}".encode()).hexdigest()[:8], 16) % 5 for i in range(40)])
    pred = np.zeros(40)
    for k in range(5):
        a, b = ridge(x[fold != k], y[fold != k])
        pred[fold == k] = a + x[fold == k] @ b
    assert row.real == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.mean < 0 < inside.mean  # twelve features of forty rows fit noise, and predict none


def test_defaults_can_find_significance(data):
    _, _, df = data
    assert linear.y_scrambling(df, "y", ["a", "b", "c"], "id").first().p_value == pytest.approx(1 / 101)
