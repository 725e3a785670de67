"""The near-duplicate join's links and survivors against brute force."""

import itertools

import numpy as np
import pytest

from actiscope.llm import jaccard

SF = "/root/testdata/sf0.001"


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}


def brute_links(texts, words, num, den):
    sets = [shingles(t, words) for t in texts]
    n = [0] * len(sets)
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            n[i] += 1
            n[j] += 1
    return n


def edited(seed, n, words=120, most=3):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 400, words)]
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, words, i % (most + 1)):
            w[j] = f"z{rng.integers(0, 50)}"
        out.append(" ".join(w))
    return out


def test_search_gives_every_pair():
    rng = np.random.default_rng(5)
    base = np.arange(200)
    sets = [np.unique(np.r_[np.delete(base, rng.integers(0, 200, i % 25)), rng.integers(200, 260, i % 7)]).astype(np.uint64) for i in range(150)]
    sets += [np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(60)]
    got = [tuple(sorted(x)) for x in jaccard.search(sets, 80, 100)]
    want = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert sorted(got) == want and len(want) > 5000


@pytest.mark.parametrize("group", [jaccard.GROUP, 1500])
def test_links_of_near_copies(spark, monkeypatch, group):
    texts = edited(3, 90) + edited(4, 40, 30) + ["", None, "one", "ONE", "x y"]
    monkeypatch.setattr(jaccard, "GROUP", group)
    for words, num in ((3, 90), (5, 80)):
        got = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=words, num=num, links=True)
        assert [r.n_links for r in got.orderBy("doc_id").collect()] == brute_links(texts, words, num, 100)


def test_query_gives_links(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: r.n_links for r in jaccard.query(spark, SF).collect()}
    assert got == dict(zip(d.doc_id, brute_links(d.text, 3, 90, 100), strict=True))


def test_short_sets_share_the_routes_they_need():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 2**64, (4000, 5), dtype=np.uint64)
    pairs = [np.sort(x) for c in code for x in (c[:4], c)]  # Jaccard exactly 0.8
    at = np.r_[0, np.cumsum([len(x) for x in pairs])]
    got = jaccard.routes(np.concatenate(pairs), at, 80, 100)
    own = [[set(v[o[i] : o[i + 1]].tolist()) for i in range(len(pairs))] for v, o, _ in got]
    for i in range(0, len(pairs), 2):
        assert any(len(own[s][i] & own[t][i + 1]) >= max(got[s][2][i], got[t][2][i + 1], 1) for s in (0, 1) for t in (0, 1))


def test_survivors_are_rows(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, b), (2, c), (3, a + " more"), (3, d), (None, b + " more"), (None, "one two"), (None, "ONE two"), (4, c), (4, ""), (5, None), (5, None), (2, b)]
    got = corpus_pipeline.deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    got = [(r.doc_id, r.text.lower() if r.text else r.text) for r in got]
    want = [(1, a), (2, b), (2, c), (3, d), (None, "one two"), (4, ""), (5, None), (5, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
