"""Edge cases that every operator must have a defined result for, and brute-force versions on small tables."""

import base64
import collections
import hashlib
import io
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from actiscope.llm import flac, gru, jaccard, langid, mix, pieces, quality, tokens, topk, warc
from actiscope.llm import queries as llm
from actiscope.llm.base import utf8
from oracle import same

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, id string, n long, k string, kept_0 int, rows int, M_Position int, place int, size int, key int, first_id int"
LONG = "the quick brown fox " * 6000


def rows():
    base = "the cat sat on the mat and then it ran away from the dog in the yard"
    r = [(1, base), (2, base), (3, base.upper()), (4, base + " today"), (5, ""), (6, None), (7, "one"), (8, "ONE"), (9, "a  b\t\n　c \U0001f600 é"), (10, LONG), (None, base), (None, None), (11, "!!! 123 ..."), (11, "!!! 123 ..."), (12, "x y"), (13, "   \n ")]
    return [(i, t, "en" if i and i % 3 else None, f"s{(i or 0) % 3}" if i != 4 else None, "clash", 5, "k", 1, 2, 3, 4, 5, 6, 7) for i, t in r]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_equals_sql(spark, name):
    same(llm.QUERIES[name](spark, SF), llm.SQL[name], SF)


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = tokens.read_ids(tokens.write_ids(docs, BPE)).collect()
    want = collections.Counter((r[0], zlib.crc32(np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in rows())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tokens.read_ids(tokens.write_ids(none, BPE)).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_packed_file(bits):
    rng = np.random.default_rng(bits)
    lens = np.array([0, 5, 9000, 1])
    ids = rng.integers(0, 2**bits, lens.sum()).astype(np.uint32)
    out = io.BytesIO()
    w = tokens.Writer(out, bits)
    w.add(np.arange(4), np.zeros(4, np.int64), ids, lens)
    assert w.close() == (4, 9006)
    r = tokens.Reader(io.BytesIO(out.getvalue()))
    assert (r.ids(0, 9006) == ids).all() and (r.ids(4090, 4100) == ids[4090:4100]).all() and (r.document(2) == ids[5:9005]).all()
    with pytest.raises(ValueError):
        tokens.Reader(io.BytesIO(out.getvalue()[:-3]))


def test_topk(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0]), (6, [0.5]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [1e30, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_topk(e.where("vec_id = 0"), e, 2).orderBy("rank").collect()]
    assert [g[2] for g in got] == [8, 1] and got[1][3] == 65536
    assert topk.exact_topk(e.where("vec_id = -1"), e).count() == 0 and topk.exact_topk(e.where("vec_id = 0"), e.where("vec_id = 0")).count() == 0


def test_lm(spark, docs, none):
    assert gru.score(none).count() == 0
    got = gru.score(docs).collect()
    words = [((r[1] or "").encode().lower().split(), r[0]) for r in rows()]
    held = [(zlib.crc32(str(i).encode()) if i is not None else 0) % 10 == 0 for _, i in words]
    c = collections.Counter()
    for (w, _), h in zip(words, held, strict=True):
        if not h:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    want = sorted((len(w) + 1, sum(c[x] > 0 for x in [*w, None]), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 6)) for w, _ in words)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got) and {r.train_tokens for r in got} == {n}


def naive_likelihood(net, units):
    """A text's log-probability, one token after the other, by the formulas."""
    w, h, before, total = {k: v.astype(float) for k, v in net.w.items()}, np.zeros(gru.HIDDEN), gru.END, 0.0
    for unit in [*units, gru.END]:
        a, hu = (w["emb"][before] @ w["wx"] + w["b"]).reshape(3, -1), (h @ w["u"]).reshape(3, -1)
        r, z = 1 / (1 + np.exp(-(a[:2] + hu[:2])))
        h = z * h + (1 - z) * np.tanh(a[2] + r * hu[2])
        k, i = divmod(int(unit), gru.WITHIN)
        for logits, target in ((h @ w["wo"] + w["bo"], k), (h @ w["wi"][k] + w["bi"][k], i)):
            total += logits[target] - np.log(np.exp(logits).sum())
        before = int(unit)
    return total


def random_network(seed):
    net = gru.Network(seed=seed)
    net.flat[:] += np.random.default_rng(seed).standard_normal(net.flat.shape).astype(np.float32) * 0.3
    return net


def test_lm_gradient_and_lanes():
    net = random_network(1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, gru.UNITS, (4, 3)), rng.integers(0, gru.UNITS, (4, 3))
    fresh, live, h = np.zeros((4, 3), bool), np.ones((4, 3), bool), rng.standard_normal((gru.HIDDEN, 3)).astype(np.float32)
    fresh[2, 1], live[3, 2] = True, False
    g, _ = net.gradient(x, y, fresh, live, h)

    def loss(flat):
        m = gru.Network(flat)
        states = m.steps(x, fresh, h, False)[0].transpose(1, 0, 2).reshape(gru.HIDDEN, -1)
        return -m.log_probs(states, y.reshape(-1))[live.reshape(-1)].mean()

    big = np.flatnonzero(np.abs(g) > 1e-2)
    at = np.r_[0, np.cumsum([int(np.prod(v)) for v in gru.Network.SHAPES.values()])]
    for i in [int(rng.choice(big[(big >= a) & (big < b)])) for a, b in itertools.pairwise(at) if ((big >= a) & (big < b)).any() for _ in range(3)]:
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(g[i], rel=0.1, abs=1e-3)
    lens = np.array([3, 0, 200, 7, 1500])
    units = rng.integers(1, gru.UNITS, lens.sum())
    alone = [naive_likelihood(net, units[a:b]) for a, b in itertools.pairwise([0, *np.cumsum(lens)])]
    assert gru.likelihood(net, units, lens) == pytest.approx(alone, rel=1e-4)


def test_lm_pieces_and_stretches():
    rows = pa.table({"text": ["abcd" * 5, None, "x" * 30, "y", "z" * 3, "w" * 9], "b": [0, 0, 0, 2, 2, 5]})
    want = [(0, 0, 3), (2, 0, 2), (5, 0, 1)]
    cut = [(0, 0, 1), (0, 1, 2), (2, 0, 2), (5, 0, 1)]
    for step in (1, 2, 6):
        assert [(int(b), n, r.num_rows) for b, n, r in gru.pieces(iter(rows.to_batches(step)), 1000)] == want
        assert [(int(b), n, r.num_rows) for b, n, r in gru.pieces(iter(rows.to_batches(step)), 20)] == cut
    units, size, whole = gru.stretches(np.arange(25), np.array([10, 0, 15]), 6, 1)
    assert size.tolist() == [5, 5, 0, 5, 5, 5] and whole.tolist() == [False, True, True, False, False, True] and len(units) == 25
    units, size, whole = gru.stretches(np.arange(25), np.array([10, 0, 15]), 6, 3)
    assert size.tolist() == [5, 5] and units.tolist() == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_lm_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(gru, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(gru, "HEAD", 50)
    one, many = ({r.doc_id: r for r in gru.score(d.repartition(n)).collect()} for n in (1, 7))
    assert one == many and len(one) == d.count()
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_lm_score_by_hand(spark, monkeypatch):
    """The whole score of each text from a known network: its units and the counts inside shared units."""
    net = random_network(4)
    monkeypatch.setattr(gru, "fit", lambda *_: net)
    monkeypatch.setattr(gru, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(gru, "HEAD", 200)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in d.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = collections.Counter(w for i, t in texts.items() if not held[i] for w in t)
    h = lambda w: xxhash.xxh3_64_intdigest(w) - (1 << 64 if xxhash.xxh3_64_intdigest(w) >> 63 else 0)
    top = sorted(sorted(c, key=lambda w: (-c[w], h(w)))[: gru.FIRST_SHARED - 1], key=h)
    place = {w: 1 + i for i, w in enumerate(top)}
    shared = dict(zip(words := sorted({w for t in texts.values() for w in t}), gru.hashes(pa.array([w.decode() for w in words]))[1].tolist(), strict=True))
    mass = collections.Counter()
    for w in c:
        if w not in place:
            mass[shared[w]] += c[w] + 0.1
    for r in gru.score(d).collect():
        t = texts[r.doc_id]
        if len(t) < 300:
            want = naive_likelihood(net, [place.get(w, shared[w]) for w in t]) / math.log(10)
            want += sum(math.log10((c[w] + 0.1) / (mass[shared[w]] + 0.1)) for w in t if w not in place)
            assert r.score == pytest.approx(want, rel=1e-4)


def brute_groups(texts, ids, words, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    comp = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    name = {c: min((ids[i] for i in range(len(ids)) if comp[i] == c and ids[i] is not None), default=None) for c in set(comp)}
    return [(i, len(s), name[c] if s else i) for i, s, c in zip(ids, sets, comp, strict=True)]


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, none, words, num):
    assert jaccard.jaccard_join(none, words=words, num=num).count() == 0
    got = jaccard.jaccard_join(docs, words=words, num=num).collect()
    want = brute_groups([r[1] for r in rows()], [r[0] for r in rows()], words, num, 100)
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(d), words=words, num=num).collect()}
    assert got == {i: c for i, _, c in brute_groups(d.text, d.doc_id, words, num, 100)}


def test_jaccard_large_groups_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    texts = []
    for i in range(90):
        w = list(base)
        for j in rng.integers(0, 120, 1 + i % 3):
            w[j] = f"z{rng.integers(0, 50)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "GROUP", 1500)
    got = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(texts, list(range(90)), 3, 90, 100))


def test_search_against_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(60)]
    sets += [np.unique(np.r_[s[1:], np.uint64(99)]) for s in sets[:30]]
    links = jaccard.search(sets, 80, 100)
    comp = list(range(len(sets)))
    want = list(range(len(sets)))
    for c, es in ((comp, links), (want, [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))])):
        for i, j in es:
            a, b = sorted((c[i], c[j]))
            c[:] = [a if x == b else x for x in c]
    assert comp == want


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, 1), (10, 0), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    l = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    j = quality.classify(d, l).where("held_out").join(l, "doc_id")
    assert j.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_mix(spark, docs, none):
    assert mix.mix(none).count() == 0 and mix.mixed(none).count() == 0
    got = mix.mix(docs).collect()
    assert len(got) == len(rows()) and all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(repr, mix.mix(docs).collect())) == sorted(map(repr, got))
    out = mix.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = mix.mix(d).join(d.select("doc_id", "source"), "doc_id")
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("x"), F.first("source_size").alias("s")).collect():
        assert abs(r.t - r.g) <= r.x / 2 and r.g <= 2 * r.s


def test_mix_takes_a_share_of_equal_rows(spark):
    """Rows without an id and with one text, or with one id, have one place: as many of them are taken as fit the target."""
    rows = [(None, "a b c d e", "s", i) for i in range(1000)] + [(1, "q w e r t y", "t", i) for i in range(500)] + [(i, "one two three", "u", i) for i in range(100)] + [(7, None, None, 0)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, number int")
    sums = {r.source_size: (r.taken, r.target, r.rows, r.most - r.least) for r in mix.mix(d).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    assert [sums[n][2] for n in (0, 300, 3000, 5000)] == [3, 100, 500, 1000] and sums[5000][3] == 1
    assert all(abs(taken - target) <= 3 for taken, target, *_ in sums.values())
    out = mix.mixed(d)
    assert out.columns == d.columns and out.groupBy("source").count().where("source = 's'").first()["count"] * 5 == sums[5000][0]


def test_warc(spark):
    p = spark.createDataFrame([(3, "http://a/ b\r\nx", "same"), (1, None, "same"), (2, "http://c", None), (4, "u", ""), (None, "v", "same"), (5, "w", "é" * 70000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(p.withColumn("digest", F.lit(1)))).collect()}
    assert (got[1].record_type, got[3].record_type, got[3].refers_to, got[None].refers_to) == ("response", "revisit", 1, 1)
    assert (got[2].record_type, got[4].refers_to, got[5].payload_bytes) == ("response", 2, 140000)
    assert got[5].payload_digest == base64.b32encode(hashlib.sha1(("é" * 70000).encode()).digest()).decode()
    assert warc.read_archives(warc.write_archives(p.where("false"))).count() == 0
    good = warc.record("urn:page:1", "http://x", b"<p>hi</p>") + warc.record("urn:page:2", None, b"")
    assert [r.payload for r in warc.read(io.BytesIO(good))] == [b"<p>hi</p>", b""]
    for bad in (good[:-5], good[:40] + bytes([good[40] ^ 255]) + good[41:]):
        with pytest.raises(ValueError):
            list(warc.read(io.BytesIO(bad)))


def test_flac(spark, docs, none):
    assert flac.media_report(flac.encode_column(none)).count() == 0
    got = flac.media_report(flac.encode_column(docs)).collect()
    pad = lambda t: t + bytes(-len(t) % 64 if t else 64)
    want = collections.Counter((r[0], len((r[1] or "").encode()), hashlib.sha256(pad((r[1] or "").encode())).hexdigest(), zlib.crc32(pad((r[1] or "").encode())[-64:])) for r in rows())
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    rng = np.random.default_rng(0)
    for n, lo, hi in itertools.product((64, 1024, 1088, 5056), (0, 100), (1, 4, 256)):
        x = np.minimum(rng.integers(lo, lo + hi, n), 255).astype(np.uint8)
        s = flac.encode(x, np.array([0, n]))[0].tobytes()
        assert (flac.decode([s])[0] == x).all() and (flac.decode_range(s, n // 3, 40) == x[n // 3 : n // 3 + 40]).all()
        for k in (60, len(s) // 2, len(s) - 1):
            with pytest.raises(ValueError):
                flac.decode([s[:k] + bytes([s[k] ^ 16]) + s[k + 1 :]])


def test_language(spark, docs, none):
    assert langid.identify(none, langid.fit(none)).count() == 0
    got = langid.identify(docs, langid.fit(docs)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.lang_pred)
    assert by[5] == by[6] == by[13] == {"und"} and by[11] == {"und"} and by[1] == {"en"} and len(got) == len(rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.accepted(docs, langid.fit(docs)).columns == docs.columns
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    p = langid.identify(d, langid.fit(d)).join(d, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    assert p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert p.where("rejected").count() < 0.01 * p.count()


def test_pieces(spark, docs, none):
    assert pieces.encode(none, PIECES).count() == 0
    got = pieces.encode(docs, PIECES)
    text = collections.Counter(zlib.crc32((r[1] or "").encode()) for r in rows())
    first = got.where("sample = 1").collect()
    assert collections.Counter(r.text_crc32 for r in first) == text
    seen = collections.defaultdict(set)
    for r in got.collect():
        seen[r.doc_id, r.text_crc32].add((r.sample, tuple(r.ids)))
        assert r.log_inclusion <= 1e-9
    assert all(len({i for _, i in v}) == len(v) for v in seen.values())  # distinct
    back = pieces.decode(got.drop("doc_id").distinct(), PIECES).collect()
    assert all(zlib.crc32(r.text.encode()) == r.text_crc32 for r in back)


def test_pieces_follow_the_distribution():
    v = pieces.vocabulary(PIECES)
    index = {p: i for i, p in enumerate(v.pieces)}

    def every(s):
        return [()] if not s else [(index[s[:k]], *x) for k in range(1, len(s) + 1) if s[:k] in index for x in every(s[k:])]

    segs = every("▁tin")
    w = np.exp([0.5 * sum(v.logp[i] for i in s) for s in segs])
    p = dict(zip(segs, w / w.sum(), strict=True))
    n = 20000
    *found, after = pieces.samples(v, *utf8(pa.array(["tin"] * n)), np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64), 2, 0.5)
    draws = [[tuple(ids[at[i] : at[i + 1]].tolist()) for i in range(n)] for _, ids, at, _, _ in found]
    c = collections.Counter(zip(*draws, strict=True))
    assert all(a != b for a, b in c)
    assert max(abs(c[a, b] / n - p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b) < 0.012
    total = sum(np.exp(lp) / -np.expm1(-np.exp(lp + after)) for _, _, _, lp, _ in found)
    assert total.mean() == pytest.approx(1, abs=0.02)


def test_pipeline(spark, none):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.read.parquet(f"{SF}/documents.parquet").where("false"), SF)
        assert empty.count() == 0
    odd = spark.createDataFrame(rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
    kept = corpus_pipeline.deduplicated(spark, odd, SF).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6, 7} - set(ids) <= {4} and not {2, 3, 8} & set(ids)


def test_near_threshold_pairs_are_all_linked(spark):
    """Pairs of 12 and 11 words, 10 and 9 shingles, share just as many routes as they must: none may be lost."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(4000):
        w = [f"p{i}x{j}" for j in rng.integers(0, 10**9, 12)]
        texts += [" ".join(w), " ".join(w[:-1] if i % 2 else w[1:])]
    got = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.where("component_id = doc_id").count() == 4000 and got.where("component_id <> doc_id - doc_id % 2").count() == 0


def test_read_backs_are_spread(spark, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    d = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 20) AS text").repartition(12)
    files = tokens.write_ids(d, BPE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1 and tokens.read_ids(files).rdd.getNumPartitions() == files.count()
    archives = warc.write_archives(d.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html").repartition(9))
    assert archives.count() > 1 and warc.read_archives(archives).rdd.getNumPartitions() == archives.count()


def test_language_fit_is_bounded(spark, monkeypatch):
    """Rows without an id, or that repeat, don't multiply what the driver learns from."""
    learned = []
    real = langid.descend
    monkeypatch.setattr(langid, "descend", lambda rows, *a, **k: learned.append(len(rows)) or real(rows, *a, **{**k, "epochs": 1}))
    d = spark.range(6000).selectExpr("CAST(NULL AS long) AS doc_id", "concat('wort zahl ', id) AS text", "'de' AS lang")
    d = d.unionByName(spark.range(5000).selectExpr("7L AS doc_id", "'the same words' AS text", "'en' AS lang"))
    model = langid.fit(d, per_lang=200)
    assert model.langs == ["de", "en"] and 100 <= learned[0] <= 200


def test_other_warc_records():
    def member(head, block):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") + z.flush()

    info = member(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\n", b"software: x\r\n")
    request = member(b"WARC-Type: request\r\nWARC-Record-ID: <urn:b>\r\nContent-Type: application/http;msgtype=request\r\n", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n")
    got = list(warc.read(io.BytesIO(info + request + warc.record("urn:c", None, b"abc"))))
    assert [(r.kind, r.payload, r.size) for r in got] == [("warcinfo", b"software: x\r\n", 13), ("request", b"", 0), ("response", b"abc", 3)]
    for bad in (member(b"WARC-Type: warcinfo\r\n", b"x"), member(b"WARC-Type: response\r\nWARC-Record-ID: <u>\r\nContent-Type: application/http\r\n", b"no head")):
        with pytest.raises(ValueError):
            list(warc.read(io.BytesIO(bad)))


def test_quality_score_by_formula(spark):
    """The whole discriminant again, from the statistics of all labelled rows at once."""
    d, l = (spark.read.parquet(f"{SF}/{n}.parquet").toPandas() for n in ("documents", "labels"))
    x = quality.statistics(*utf8(pa.array(d.text)))
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in d.doc_id])
    label = d.doc_id.map(dict(zip(l.doc_id, l.quality, strict=True)))
    use = label.notna().to_numpy() & (fold != 1)
    t, y = x[use], label[use].astype(int).to_numpy()
    mean, spread = t.mean(0), np.sqrt(np.maximum(t.var(0), 1e-9))
    z = (t - mean) / spread
    cov = {k: np.cov(z[y == k].T, bias=True) for k in (0, 1)}
    within = sum(cov[k] * (y == k).mean() for k in (0, 1))
    log_density = {}
    for k in (0, 1):
        share = max(0.2, quality.D / (quality.D + (y == k).sum()))
        c = (1 - share) * cov[k] + share * within
        c = 0.98 * c + 0.02 * np.eye(quality.D) * np.trace(c) / quality.D + 1e-9 * np.eye(quality.D)
        gap = (x - mean) / spread - z[y == k].mean(0)
        log_density[k] = np.log((y == k).mean()) - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) - 0.5 * np.linalg.slogdet(c)[1]
    want = 1 / (1 + np.exp(-np.clip((log_density[1] - log_density[0]) / quality.TEMPERATURE, -500, 500)))
    got = quality.query(spark, SF).toPandas().set_index("doc_id").score[d.doc_id].to_numpy()
    assert got == pytest.approx(want, abs=1e-6)


def test_language_scores_by_windows(spark):
    """Every text's probabilities again, window by window, from the fitted table."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    for r in d.limit(40).collect():
        raw = bytes(langid.FOLDED[np.frombuffer((r.text or "").encode(), np.uint8)])
        buf = b"    " + raw + b"     "
        rows = []
        for i in range(3, 4 + len(raw)):
            a, b, c, e = buf[i : i + 4]
            three = a | b << 8 | c << 16
            if b != 32 and (c != 32 or a != 32 or True):
                rows += [((three * 2246822519) & 0xFFFFFFFF) >> 17]
                if c != 32 or a != 32:
                    rows += [(((three | e << 24) * 2654435761) & 0xFFFFFFFF) >> 17]
        z = (np.sum([model.rows[i].astype(float) for i in rows], 0) / max(1, len(rows)) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if got[r.doc_id].lang_pred != "und":
            assert got[r.doc_id].score == pytest.approx(p.max(), abs=1e-4) and got[r.doc_id].lang_pred == model.langs[int(p.argmax())]


def test_pcm_blocks_and_streams_without_a_table(spark):
    x = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    stream, _ = flac.encode(x, np.array([0, len(x)]))
    stream = stream.tobytes()
    size = int.from_bytes(stream[43:46], "big")
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[46 + size :]
    assert (flac.decode([bare])[0] == x).all() and (flac.decode_range(bare, 2000, 1500) == x[2000:3500]).all()
    some = stream[:42] + bytes([0x83]) + (18).to_bytes(3, "big") + stream[46 : 46 + 18] + stream[46 + size :]
    assert (flac.decode([some])[0] == x).all()
    with pytest.raises(ValueError):
        flac.decode([bare[:-600]])
    out = io.BytesIO()
    flac.write_pcm(out, x, 700)
    r = flac.PcmReader(out)
    assert r.samples == 5000 and all((r.range(a, n) == x[a : a + n]).all() for a, n in ((0, 5000), (699, 2), (700, 700), (4990, 100), (5000, 5)))
    for bad in (b"", b"PCMBLOCK", out.getvalue()[:40], b"x" * 60):
        with pytest.raises(ValueError):
            flac.PcmReader(io.BytesIO(bad)).range(0, 10)
    d = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None)], "doc_id long, text string")
    got = flac.pcm_column(flac.encode_column(d)).collect()
    assert sorted(bytes(flac.PcmReader(io.BytesIO(g.pcm)).range(0, 64)).rstrip(b"\0") for g in got) == [b"", b"abc", b"abc"]
