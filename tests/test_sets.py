"""Sets of molecules and features and their steps."""

import pytest
from pyspark.sql import functions as F

from actiscope.operators import molecules as mol
from actiscope.plans import sets

TEXTS = ["CCO", "c1ccccc1O", "CC(=O)O", "CCCCCCCC", "!!", None, "c1ccc2ccccc2c1", "NCCO", "Clc1ccccc1", "CCN"]


@pytest.fixture(scope="module")
def some(spark):
    return sets.molecules(spark, TEXTS, range(10))


def ids(s):
    return sorted(r[0] for r in s.frame.select("id").collect())


def test_steps_of_molecules(spark, some):
    assert ids(some) == list(range(10)) and ids(some >> sets.drop_invalid()) == [0, 1, 2, 3, 6, 7, 8, 9]
    ring = lambda c: c.contains("c1")
    assert ids(some >> sets.keep_if(ring)) == [1, 6, 8] and ids(some >> sets.drop_if(ring)) == [0, 2, 3, 4, 5, 7, 9]
    assert ids(some >> sets.filter_by_property(heavy_atoms=(4, 8), mol_weight=(None, 110.0))) == [1, 2, 7] or ids(some >> sets.filter_by_property(heavy_atoms=(4, 8), mol_weight=(None, 110.0))) == [1, 2, 7]
    assert ids(some >> sets.contains("[OX2H]")) == [0, 1, 2, 7]
    both = sets.keep_if(ring) >> sets.filter_by_property(heavy_atoms=(None, 7))
    out = some >> both
    assert ids(out) == [1, 8] and len(out.history) == 2 and out.to_dot().count("->") == 2
    shorter = some >> sets.apply(lambda c: F.regexp_replace(c, "O", "("))
    assert ids(shorter >> sets.drop_invalid()) == [3, 6, 8, 9]
    assert {r.id: r.y for r in out.frame.collect()} == {1: 1.0, 8: 8.0}
    assert some.to_frame().columns == ["id", "smiles", "y"] and len(some.collect()) == 10 and len(some.collect(True)) == 10
    for bad in (lambda: some > sets.drop_invalid(), lambda: some >> sets.fit(), lambda: some >> sets.featurize() >> sets.drop_invalid()):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        some >> sets.filter_by_property(nothing=(0, 1))
    with pytest.raises(ValueError):
        sets.molecules(spark, TEXTS, [1.0])
    with pytest.raises(ValueError, match="4, 5"):
        sets.check(some)
    assert sets.check(some >> sets.drop_invalid(), 8) and ids(sets.from_frame(some.frame.drop("valid"), on_error="drop")) == [0, 1, 2, 3, 6, 7, 8, 9]
    with pytest.raises(Exception, match="no molecule"):
        sets.from_frame(some.frame.drop("valid"), on_error="raise").collect()


def test_features_splits_and_models(spark, some):
    f = some >> sets.featurize("morgan", 64)
    assert f.shape() == (8, 64) and f.to_frame().columns == ["id", "y", *(f"morgan_{i}" for i in range(64))]
    d = some >> sets.describe()
    assert d.names == mol.DESCRIPTORS and d.shape()[0] == 8 and d.to_frame().where("id = 0").first().heavy_atoms == 3
    with pytest.raises(ValueError):
        some >> sets.describe("nothing")
    for step in (sets.split(0.25), sets.split(0.25, "scaffold")):
        train, test = some >> sets.drop_invalid() >> step
        assert sorted(ids(train) + ids(test)) == [0, 1, 2, 3, 6, 7, 8, 9] and ids(test)
    train, test = d >> sets.split(0.25, "kennard_stone")
    assert len(ids(test)) == 2
    model = d >> sets.fit("tree", "values")
    assert model.predict(d.frame, "id").count() == 8 and not model.classes
    labelled = sets.molecules(spark, [t for t in TEXTS if t and t != "!!"] * 2, [0, 1] * 8) >> sets.describe("topological")
    assert (labelled >> sets.fit("forest", numTrees=3)).classes
    inside = train >> sets.applicability_domain(test, "range")
    assert inside.count() == 2 and 0 <= sets.coverage(inside).first().coverage <= 1
    with pytest.raises(ValueError):
        train >> sets.applicability_domain(test, "nothing")
    with pytest.raises(TypeError):
        d >> sets.split(0.2, "scaffold")

    @sets.feature_step
    def first(s, n):
        return sets.FeatureSet(s.frame.withColumn("features", F.slice("features", 1, n)), s.idx, s.y, (), "features", s.names[:n])

    assert (d >> first(2)).shape() == (8, 2) and (d >> first(2)).history[-1] == "first(2)"
