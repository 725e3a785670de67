import pytest

from actiscope.plans import registry
from oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == {"component_domain", "forest_predictions", "partial_least_squares", "isolation_domain", "gaussian_process", "quantile_interval", "average_linkage", "complete_linkage", "recursive_elimination", "shadow_features"}


def test_no_python_on_metric_paths(spark):
    for name, f in registry.QUERIES.items():
        if f.__module__.endswith((".chemistry", ".modelling", ".patterns")):  # molecule graphs, matrix tiles and learners are Python's or their own
            continue
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
        assert "CartesianProduct" not in plan, name
