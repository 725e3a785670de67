"""The prefix trie, the filter audit and MinHash near duplicates against brute force, edge cases and skewed tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from actiscope.llm import audit, minhash, trie
from oracle import same

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, conv long, depth int, k1 int, i int, bytes int, task int"


def trie_by_hand(rows):
    """All nodes of the trie, one conversation after the other."""
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ended = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ended[seq].append(c)
    kids = collections.defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    out, totals = [], {}
    for s in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids[s]]
        own_saved = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        totals[s] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
        ends = hashlib.sha256(",".join(map(str, sorted(ended[s]))).encode()).hexdigest()
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(kids[s]), *totals[s], ends))
    return sorted(out, key=repr)


def trie_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in trie.trie(df).collect()), key=repr)


def conversations(spark, rows, parts=None):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], CONV)
    return df.repartition(parts) if parts else df


def test_trie_edge_cases(spark):
    rows = [(5, 2, "u", "b"), (5, None, "s", "a"), (5, 2, "u", "a"), (6, 1, None, None), (6, 1, None, None), (7, 3, "u", "é" * 3000), (None, 1, "u", "x"), (11, 0, "u", "q"), (-3, 1, "u", "n"), (-5, 1, "u", "m"), (-5, 2, "u", ""), (0, None, None, "z")]
    assert trie_of(conversations(spark, rows)) == trie_by_hand(rows)
    assert trie.trie(conversations(spark, [])).count() == 0
    assert trie_of(conversations(spark, rows[:1])) == trie_by_hand(rows[:1])


def test_trie_skewed(spark):
    """One conversation with a third of all rows, one first turn for most, many equal conversations, deep chains."""
    rng = random.Random(1)
    rows = [(40, t, "user", f"long {t % 7}") for t in range(900)] + [(41, t, "user", f"long {t % 7}") for t in range(700)]
    for c in range(100, 420):
        rows += [(c, 0, "system", "hello")] + [(c, t, rng.choice(("user", "bot")), rng.choice("ab")) for t in range(1, rng.randrange(1, 14))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1090) for t in range(12)]
    assert trie_of(conversations(spark, rows, 5)) == trie_by_hand(rows)


def test_trie_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(2000, 2200) for t in range(10)]
    assert trie_of(conversations(spark, rows)) == trie_by_hand(rows)


def test_trie_equals_sql(spark):
    same(trie.query(spark, SF), trie.SQL, SF)


AUDIT = "doc_id long, text string, source string, mask int, part string, f_id long, id int"


def audit_by_hand(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    fails = []
    for d, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        fails.append((part or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {x[0] for x in fails}:
            for s, name in enumerate(order, 1):
                before = set(order[: s - 1])
                rows = [x for x in fails if x[0] == part]
                here = [x for x in rows if name in x[1] and not x[1] & before]
                out[part, order, s] = [sum(not x[1] & (before | {name}) for x in rows), len(here), sum(name in x[1] and bool(x[1] & before) for x in rows), sum(x[1] == {name} for x in rows), sum(x[2] for x in here), sum(x[3] for x in here)]
    total = collections.Counter()
    for (part, order, s), v in out.items():
        total[part, order[s - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(1, words, "a"), (2, words, "a"), (3, words, None), (None, words, ""), (4, "", "a"), (5, None, "b"), (2, words, "a"), (6, "A # " * 30, "b"), (7, words + " $", "a"), (8, "x  \t\n y\x0b z", "b"), (9, "ÀÉ 　" * 40, "a"), (10, words * 2000, "c"), (11, words.upper(), "c")]
    labels = [(1, 1, 0), (2, 1, 1), (2, None, None), (4, 0, 1), (None, 1, 1), (6, None, 1), (3, 1, None), (99, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "p", 2, 3) for x in docs], AUDIT)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(audit.cells(audit.masks(d), lab)).collect()}
    assert got == audit_by_hand(docs, labels)
    assert audit.audit(audit.cells(audit.masks(d.where("false")), lab)).count() == 0


def test_audit_equals_sql(spark):
    same(audit.query(spark, SF), audit.SQL, SF)


def components_by_hand(docs, words, num, den):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    name = list(range(len(docs)))
    while True:
        old = list(name)
        for i, j in itertools.combinations(range(len(docs)), 2):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                name[i] = name[j] = min(name[i], name[j])
        if name == old:
            break
    ids = collections.defaultdict(list)
    for n, (d, _) in zip(name, docs, strict=True):
        ids[n] += [d] if d is not None else []
    return sorted(((d, len(s), min(ids[n], default=None)) for (d, _), s, n in zip(docs, sets, name, strict=True)), key=repr)


def near(spark, docs, **options):
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, n int, k string, component_id int")
    got = minhash.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize(("words", "num"), [(3, 85), (5, 80), (1, 50)])
def test_minhash_edge_cases(spark, words, num):
    base = "the cat sat on the mat and then it ran away from the dog in the yard"
    docs = [(1, base), (2, base.upper()), (3, base + " today"), (4, ""), (5, None), (6, "one"), (7, "ONE"), (None, base + " now"), (None, "all alone here"), (None, None), (8, "x y"), (8, base), (9, "  \t "), (10, "long text " * 20000)]
    assert near(spark, docs, words=words, num=num) == components_by_hand(docs, words, num, 100)
    assert near(spark, [], words=words) == []


def test_minhash_families(spark, monkeypatch):
    """Copies of a text that are similar to it and not to each other, in parts and blocks of few shingles; passages that many share."""
    monkeypatch.setattr(minhash, "GROUP", 900)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    docs, passage = [], [word() for _ in range(40)]
    for f in range(12):
        text = [word() for _ in range(rng.choice((8, 30, 120)))]
        docs.append(text)
        for _ in range(rng.choice((3, 25))):
            new = list(text)
            for _ in range(max(1, len(text) // 45)):
                new[rng.randrange(len(new))] = word()
            docs.append(new)
    docs += [passage + [word() for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(docs)
    want = components_by_hand(docs, 3, 85, 100)
    assert near(spark, docs, words=3, num=85) == want
    assert len({c for *_, c in want}) < len(docs) - 50


def test_minhash_buckets_lose_no_pair():
    """Pairs just at the threshold, of small and large sets, share a bucket; the sketch of a superset borrows alike."""
    rng = np.random.default_rng(4)
    missed = 0
    for n in [6, 7, 8, 10, 14, 20, 33, 60, 100, 170, 300, 900] * 40:
        both = n * 85 // 100 if n > 6 else 6
        both = next(b for b in range(both, n + 1) if 100 * b >= 85 * n)
        whole = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        part = np.sort(rng.permutation(whole)[:both])
        code, at = np.r_[whole, part], np.array([0, len(whole), len(whole) + both])
        names, name_at = minhash.buckets(code, at, 85, 100)
        if 100 * both >= 85 * len(whole) and both < len(whole):
            missed += not set(names[: name_at[1]]) & set(names[name_at[1] :])
    assert missed == 0
    assert (1 - 0.85**minhash.ROWS) ** minhash.bands(85, 100) <= minhash.MISS
