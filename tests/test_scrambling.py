"""Iterations share passes of a bounded number of rows, with the same results."""

import pytest

from actiscope.operators import linear


def test_passes_of_few_rows(spark, monkeypatch):
    d = spark.createDataFrame([(i, float(i * i % 17), float(i % 5)) for i in range(60)], "id long, y double, a double")
    want = linear.y_scrambling(d, "y", ["a"], "id", 7).first()
    rows, scrambled = [], linear.scrambled
    monkeypatch.setattr(linear, "SCRAMBLED", 200)
    monkeypatch.setattr(linear, "scrambled", lambda *a: rows.append((r := scrambled(*a)).count()) or r)
    clean = spark.conf.get(linear.CLEAN, None)
    assert linear.y_scrambling(d, "y", ["a"], "id", 7).first() == pytest.approx(tuple(want))
    assert rows == [180, 180, 60] and spark.conf.get(linear.CLEAN, None) == clean
