"""Sets that meet in blocks, against brute force."""

import itertools
import random

import pytest

from actiscope.operators import diversity, landscape, neighbours, similarity


def sets(top, seed=0):
    r = random.Random(seed)
    out = [sorted(r.sample(range(top), r.randint(1, 6))) for _ in range(40)]
    return [[], [], *out, out[0], out[0], out[0], out[1]]


def like(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("top,block,words", [(12, 4096, 64), (12, 5, 64), (150, 7, 64), (150, 7, 1)])
def test_pairs_and_neighbours_are_all_found(spark, monkeypatch, top, block, words):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "WORDS", words)
    x = sets(top)
    f = spark.createDataFrame([(i, b, float(i % 5)) for i, b in enumerate(x)], "id int, bits array<int>, value double")
    every = {(i, j): like(x[i], x[j]) for i, j in itertools.combinations(range(len(x)), 2)}
    got = {(r.a_id, r.b_id): (r.similarity, r.a_value, r.b_value) for r in similarity.similar_pairs(f, 0.3, ["value"]).collect()}
    assert got == {(i, j): (s, i % 5, j % 5) for (i, j), s in every.items() if s >= 0.3}
    for k in (1, 4):
        near = {(r.query_id, r["rank"]): (r.ref_id, r.similarity) for r in similarity.nearest(f, f, k).collect()}
        want = {}
        for i, b in enumerate(x):
            best = sorted((-like(b, c), j) for j, c in enumerate(x) if j != i)[:k]
            want |= {(i, r): (j, -s) for r, (s, j) in enumerate(best, 1)}
        assert near == want
    best = {r.id: r.similarity for r in neighbours.closeness(f, f, 1).collect()}
    assert best == {i: max(like(b, c) for j, c in enumerate(x) if j != i) for i, b in enumerate(x)}


def test_no_pair_is_shuffled(spark):
    """What is summed over all pairs leaves tasks as sums: the only rows that are exchanged are those of the table, once a block."""
    f = spark.createDataFrame([(i, [i % 7, 8 + i % 5], i % 3, float(i % 4)) for i in range(60)], "id int, bits array<int>, lib int, value double")
    for d in (landscape.sari(f.select("id", "bits"), f.select("id", "value")), diversity.compared(f, 16, "lib"), similarity.nearest(f, f, 3)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin [bit" not in plan and "a_bit" not in plan


def test_two_empty_sets_count_in_sari(spark):
    f = spark.createDataFrame([(1, [], 1.0), (2, [], 3.0), (3, [1], 2.0)], "id int, bits array<int>, value double")
    r = landscape.sari(f.select("id", "bits"), f.select("id", "value")).first()
    whole = (1 + 3) / 2 * 3 + (1 + 2) / 2 * 2 + (3 + 2) / 2 * 2
    assert (r.continuity, r.discontinuity) == pytest.approx((2 / whole, 2 / 3))
