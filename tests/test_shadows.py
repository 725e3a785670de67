"""The shadows of a round are joined between executors."""

from actiscope.operators import selection


def test_shadows_do_not_pass_through_the_driver(spark, monkeypatch):
    plans, rows = [], []

    def fitted(both, *_, **__):
        rows.append(sorted(tuple(r.x) for r in both.collect()))
        plans.append(both._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(selection.models, "fitted", fitted)
    monkeypatch.setattr(selection, "importances", lambda _: [2.0, 1.0])
    d = spark.createDataFrame([(i, [float(i)], float(i % 5)) for i in range(50)], "id long, x array<double>, y double")
    assert selection.shadowed(d, "id", "x", "y", 2) == [(0, 2, "Tentative")]
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert all(len(r) == 50 and {a for a, _ in r} == {b for _, b in r} and all(a != b for a, b in r) for r in rows)
