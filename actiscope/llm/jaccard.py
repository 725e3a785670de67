"""N-gram Jaccard join: every pair of documents whose sets of word shingles are similar enough ends in one component.

1. Sets.  A text's set is its distinct shingles, as 64-bit hashes; texts with equal sets are one node from here on, named by a hash of the set.
2. Routing.  Two sets of sizes a, b with Jaccard >= t differ in at most d = (a + b)(1 - t)/(1 + t) shingles.  Cut the hash range into d + 1 + s
   segments: at least 1 + s segments hold the same shingles in both sets.  A node is routed by the hashes of its segments, for the size
   class of its own and, if near its lower bound, of the class below.  Empty segments count only for a node with more than s of them; any
   node shares 1 + s routes less its empty ones, and one at least.  So routing loses no pair, and texts that merely share passages share too few routes.
   Routes with one node are dropped, nodes with too few of the others too; a bit map of fixed size keeps most of them from a second shuffle.  Of the
   routes left each node drops its most common ones, one less than it shares with any linked node at least: of the routes that two linked nodes share
   the least common stays in both (the prefix principle), and passages that many texts have bring few together.
3. Search.  Nodes that share a route meet in a group.  There every set queries an inverted index of the smaller sets: T-occurrence search by
   DivideSkip, which merges the short lists on a heap (by counting, where many entries are to merge), probes the long ones by binary
   search, or in a bit map of the longest, and keeps sets that reach the required overlap.  Groups of more than GROUP shingles are cut into blocks, and
   every pair of blocks is a group.
4. Links.  Every candidate is verified, and a link counts in the first group that its two sets share, so that a task gives a row a set, not a
   row a link: near copies by the thousand have links by the million.  Where only components are asked for, a candidate that is linked to the query
   already, through others, isn't verified.
5. Components of the links that span each group's by alternating large-star and small-star steps on tables.

Defined cases: words are maximal runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle has is one shingle; a text
without words, or null, has an empty set and is linked with nothing. Null ids take part; they are never a component's name unless all its ids are
null. Rows that repeat an id are nodes by their own texts. An empty table gives no rows. Other columns are ignored. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import binary_array, bit_map, bounded, dropped, in_map, list_array, ragged, slices, table, trimmed, written
from .gru import tokenized

#: Shingles of a group that one task searches.
GROUP = 2_000_000
#: Bytes of text whose shingles a task makes at once.
TEXT_BYTES = 1 << 20
#: Bits of the maps that keep rows from a shuffle, as a power of two.
MAP_BITS = 26
#: The published cost ratio of DivideSkip between probing and merging.
MU = 0.0085


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and offsets."""
    import xxhash

    tokens, names, lens = tokenized(col)
    listed = names.cast(pa.large_binary()).to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in listed), np.uint64, len(listed))[tokens] if len(tokens) else np.zeros(0, np.uint64)
    at = np.r_[0, np.cumsum(lens)]
    own = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(h)) - at[own]
    size = np.minimum(lens, words)[own]
    code = np.zeros(len(h), np.uint64)
    for j in range(min(words, len(h))):
        # A short text's only shingle takes the words that there are.
        shifted = np.zeros(len(h), np.uint64)
        shifted[: len(h) - j] = h[j:]
        code = np.where(j < size, mix(code * np.uint64(3) + shifted + np.uint64(j + 1)), code)
    begins = place <= lens[own] - size
    code, own = code[begins], own[begins]
    order = np.lexsort((code, own))
    code, own = code[order], own[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
    code, own = code[new], own[new]
    return code, np.r_[0, np.cumsum(np.bincount(own, minlength=len(lens)))]


def size_classes(num: int, den: int, top: int) -> np.ndarray:
    """Lower bounds of the size classes: similar sets are in the same or in neighbouring ones."""
    grow = max(1.5, 1.1 * den / num)
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(out[-1] * grow)))
    out.append(max(out[-1] + 1, int(out[-1] * grow)))
    return np.array(out, np.int64)


def routes(code: np.ndarray, at: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the size class of each set, and for the class below: route hashes, offsets by set, and how many of its routes a linked set shares at least."""
    n = np.diff(at)
    bounds = size_classes(num, den, int(n.max(initial=1)))
    own_class = np.searchsorted(bounds, np.maximum(n, 1), side="right") - 1
    found = []
    for down in (0, 1):
        use = np.flatnonzero(n > 0) if not down else np.flatnonzero((n > 0) & (own_class > 0) & (-(-num * n // den) <= bounds[own_class] - 1))
        a = bounds[own_class[use] - down + 1] - 1
        apart = (a + den * a // num) * (den - num) // (den + num)
        use, apart = use[apart > 0], apart[apart > 0]  # where sets can't differ, only equal ones are linked
        if not len(use):
            found.append((np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64), np.zeros(len(n), np.int64)))
            continue
        slack = 3 + apart // 8
        m = apart + 1 + slack
        base = np.r_[0, np.cumsum(m)]
        rows = np.repeat(np.arange(len(use)), n[use])
        h = code[ragged(at[use], n[use])]
        seg = ((h >> np.uint64(32)) * m[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[rows]
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        total, full = np.zeros(int(base[-1]), np.uint64), np.zeros(int(base[-1]), bool)
        total[seg[first]] = np.add.reduceat(mix(h), first)
        full[seg[first]] = True
        of = np.repeat(np.arange(len(use)), m)
        empty = m - np.bincount(of, weights=full, minlength=len(use)).astype(np.int64)
        every = empty > slack
        keep = full | every[of]
        tag = ((own_class[use] - down)[of] << 40 | np.arange(len(of)) - base[of]).astype(np.uint64)
        need = np.zeros(len(n), np.int64)
        # Segments that are empty in both sets are routes only if both have many: they can't be counted on.
        need[use] = np.maximum(1, 1 + slack - empty)
        count = np.zeros(len(n), np.int64)
        count[use] = np.bincount(of, weights=keep, minlength=len(use)).astype(np.int64)
        found.append((mix(total + mix(tag + np.uint64(1)))[keep], np.r_[0, np.cumsum(count)], need))
    return found


def set_keys(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        total[full] = np.add.reduceat(mix(code + np.uint64(0x9E3779B97F4A7C15)), at[full])
    return mix(total + np.diff(at).astype(np.uint64))


def _merge(lists: list[np.ndarray], least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that occur in `least` lists or more, of lists of numbers under size, and in how many; each list is ascending."""
    if sum(map(len, lists)) > 64:
        count = np.bincount(np.concatenate(lists), minlength=size)
        out = np.flatnonzero(count >= least)
        return out, count[out]
    count: dict[int, int] = {}
    for x in heapq.merge(*(p.tolist() for p in lists)):
        count[x] = count.get(x, 0) + 1
    out = [x for x, n in count.items() if n >= least]
    return np.array(out, np.int64), np.array([count[x] for x in out], np.int64)


def linked(sets: list[np.ndarray], num: int, den: int, every: bool = True, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each set, the earlier ones (by size) with Jaccard >= num / den, and which of those span the components. Sets are ascending and not empty.

    Unless every, only as many are found as span the components; known: the components that the sets are in already.
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])), np.int64)
    size = np.array([len(sets[i]) for i in order], np.int64)
    code = np.concatenate([sets[i] for i in order])
    doc = np.repeat(np.arange(len(order)), size)
    _, inverse = np.unique(code, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    post = doc[by]
    edge = np.r_[0, np.cumsum(np.bincount(inverse))]
    long_by = edge[1:] - edge[:-1]
    width = len(order)
    keyed = inverse[by].astype(np.int64) * width + post  # (list, entry), ascending: binary probes of many lists at once
    at = np.r_[0, np.cumsum(size)]
    comp = np.arange(len(order)) if known is None else known[order]
    # Lists with a 64th of the sets or more have a bit in each set's row of a map, which so takes no more than 8 bytes an entry.
    heavy = np.flatnonzero(long_by >= max(64, width // 64))
    spot = np.full(len(long_by), -1)
    spot[heavy] = np.arange(len(heavy))
    bits = np.zeros((width, -(-len(heavy) // 64)), np.uint64)
    for i, x in enumerate(heavy.tolist()):
        bits[post[edge[x] : edge[x + 1]], i // 64] |= np.uint64(1 << i % 64)
    for q in range(1, len(order)):
        n = int(size[q])
        low = int(np.searchsorted(size, -(-num * n // den)))
        if low >= q:
            continue
        mine = inverse[at[q] : at[q + 1]]
        need = -(-num * (int(size[low]) + n) // (num + den))
        lists = mine[np.argsort(long_by[mine], kind="stable")]
        most = int(long_by[lists[-1]])
        n_long = min(need - 1, int(need / (MU * np.log2(max(most, 2)) + 1)))
        short, far = lists[: n - n_long], lists[n - n_long :]
        short = short[long_by[short] > 1]
        if not len(short):
            continue
        parts = []
        for i in short.tolist():
            p = post[edge[i] : edge[i + 1]]
            parts.append(p[bisect_left(p, low) : bisect_left(p, q)] if len(p) < 32 else p[np.searchsorted(p, low) : np.searchsorted(p, q)])
        found, both = _merge(parts, max(1, need - n_long), width)
        probed, mapped = far[spot[far] < 0], spot[far[spot[far] >= 0]]
        mask = np.zeros(bits.shape[1], np.uint64)
        np.bitwise_or.at(mask, mapped // 64, np.uint64(1) << (mapped % 64).astype(np.uint64))
        words = np.flatnonzero(mask)
        while True:
            if not every:
                left = comp[found] != comp[q]
                found, both = found[left], both[left]
            if not len(found):
                break
            # Unless every, one candidate of each component that isn't the query's own yet; the first and so the smallest.
            pick = np.arange(len(found)) if every else np.unique(comp[found], return_index=True)[1]
            p, overlap = found[pick], both[pick]
            step = max(1, (1 << 20) // max(1, len(probed), len(words)))
            for i in range(0, len(p), step):
                part = p[i : i + step]
                if len(probed):
                    probe = probed[:, None] * width + part
                    overlap[i : i + step] += (keyed[np.minimum(np.searchsorted(keyed, probe), len(keyed) - 1)] == probe).sum(0)
                if len(words):
                    overlap[i : i + step] += np.bitwise_count(bits[part[:, None], words] & mask[words]).sum(1, dtype=np.int64)
            p = p[den * overlap >= num * (n + size[p] - overlap)]
            if len(p):
                names, first = np.unique(comp[p], return_index=True)
                first = first[names != comp[q]]
                yield int(order[q]), order[p], order[p[first]]
                if len(first):
                    names = np.r_[names, comp[q]]
                    comp[np.isin(comp, names)] = names.min()
            if every:
                break
            found, both = np.delete(found, pick), np.delete(both, pick)


def search(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """All pairs with Jaccard >= num / den. Sets are ascending and not empty."""
    return [(p, q) for q, found, _ in linked(sets, num, den) for p in found.tolist()]


def counted(sets: list[np.ndarray], num: int, den: int, rows: np.ndarray, elsewhere: list[list], dealt: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the components, and the rows that each set is linked with, of links that no other group counts.

    rows: the rows that have the set; elsewhere: the earlier groups that the set is in; dealt: the set's block; the links
    inside a block with a negative number count elsewhere.
    """
    spanning, total = [], np.zeros(len(sets), np.int64)
    members: dict = {}
    for i, names in enumerate(elsewhere):
        for name in names:
            members.setdefault(name, []).append(i)
    arrays = {name: np.array(m) for name, m in members.items() if len(m) > 1}
    mark = np.zeros(len(sets), bool)
    for q, found, span in linked(sets, num, den):
        spanning += [(p, q) for p in span.tolist()]
        if dealt[q] < 0:
            found = found[dealt[found] != dealt[q]]
        shared = [arrays[x] for x in elsewhere[q] if x in arrays]
        if shared:
            for m in shared:
                mark[m] = True
            found = found[~mark[found]]
            for m in shared:
                mark[m] = False
        total[q] += rows[found].sum()
        total[found] += rows[q]
    return spanning, total


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the row of each."""
    return lists.flatten().to_numpy().copy(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def shared_routes(routed: DataFrame) -> DataFrame:
    """v: the routes that more than one node has. routed has a row a node, or more of a few.

    A batch sends a route once, or twice if several of its rows have it: a node that occurs twice makes routes look shared, never unshared, and a
    route that a third of all nodes have is sent some times a batch, not a node.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (0, 1):
                v, _ = _flat(b.column(f"routes{s}"))
                v.sort()
                first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
                second = np.r_[False, ~first[1:] & first[:-1]] if len(v) else first
                yield pa.RecordBatch.from_arrays([pa.array(v[first | second])], ["v"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = np.zeros(0, np.int64), None
        for b in batches:
            v = np.concatenate([last, b.column("v").to_numpy()])
            hot = np.unique(v[1:][v[1:] == v[:-1]])
            hot = hot[hot != told] if told is not None else hot
            if len(hot):
                told = hot[-1]
                yield pa.RecordBatch.from_arrays([pa.array(hot)], ["v"])
            last = v[-1:]

    return routed.mapInArrow(trimmed(pack), "v long").repartition("v").sortWithinPartitions("v").mapInArrow(trimmed(several), "v long")


def one_each(made: DataFrame) -> DataFrame:
    """Routes of the nodes, those of texts with equal sets once: only rows whose set occurs again, by a bit map, are shuffled."""
    cols = ["k", "routes0", "need0", "routes1", "need1"]
    again = made.where("k IS NOT NULL").groupBy("k").count().where("count > 1")
    found = bit_map(again.select(F.col("k").alias("v")), MAP_BITS)

    def part(want: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_map(found, b.column("k").to_numpy()) == want))

        return trimmed(work)

    rows = made.where("k IS NOT NULL").select(*cols)
    repeated = rows.mapInArrow(part(True), rows.schema).groupBy("k").agg(*(F.first(c).alias(c) for c in cols[1:]))
    return rows.mapInArrow(part(False), rows.schema).unionByName(repeated)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of links (a, b): large-star and small-star steps until nothing changes."""
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    # a > b throughout.
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(down, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b")
        old, edges = edges, written(small.distinct(), "links")
        after = state(edges)
        dropped(old)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100, links: bool = False) -> DataFrame:
    """id, n_shingles, component_id: the smallest id that links of Jaccard >= num / den reach. One row per row of docs.

    With links also n_links: the other rows, copies too, that the row is linked with.
    """
    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            code, at = shingle_sets(b.column("text"), words)
            n = np.diff(at)
            cols = [b.column("id"), pa.array(n), pa.array(set_keys(code, at).view(np.int64), mask=n == 0)]
            for sig, sig_at, need in routes(code, at, num, den):
                cols += [list_array(sig.view(np.int64), sig_at, pa.int64()), pa.array(need.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "k", "routes0", "need0", "routes1", "need1"])

    made = written(d.mapInArrow(keys, f"id {kind}, n long, k long, routes0 array<long>, need0 int, routes1 array<long>, need1 int"), "sets")
    nodes = made.select("id", "n", "k")
    routed = one_each(made)
    shared = written(shared_routes(routed), "routes")
    route_map = bit_map(shared, MAP_BITS)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k").to_numpy()
            for s in (0, 1):
                v, own = _flat(b.column(f"routes{s}"))
                need = b.column(f"need{s}").to_numpy()
                hit = in_map(route_map, v)
                hit &= (np.bincount(own, weights=hit, minlength=b.num_rows) >= need)[own]
                v, own = v[hit], own[hit]
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(k[own]), pa.array(np.full(len(v), s, np.int32)), pa.array(need[own])], ["v", "k", "s", "need"])

    # One row per set and shared route, whatever the number of its copies; a set stays that shares as many routes as a linked one must.
    met = written(routed.mapInArrow(trimmed(meeting), "v long, k long, s int, need int").distinct().join(shared, "v"), "met")
    common = met.groupBy("v").agg(F.count(F.lit(1)).alias("nodes"))
    ranked = met.join(common, "v").groupBy("k", "s").agg(F.sort_array(F.collect_list(F.struct("nodes", "v"))).alias("r"), F.max("need").alias("need"))
    prefix = ranked.where("size(r) >= need").select("k", F.explode(F.expr("slice(r, 1, size(r) - need + 1)")).alias("r")).select("r.v", "k")
    met = written(prefix.distinct(), "prefix")
    # A route's nodes meet under the one of them with the most routes, so that a group has few names and its sets are sent few times.
    met = met.join(met.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "k")
    roots = met.groupBy("v").agg(F.max(F.struct("c", "k")).alias("most"), F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("v", F.col("most.k").alias("root"))
    groups = written(met.join(roots, "v").select("root", "k").distinct(), "groups")
    reps = nodes.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    chosen = written(groups.select("k").distinct().join(reps, "k"), "chosen")
    id_map = bit_map(chosen.select(F.xxhash64("rep").alias("v")), MAP_BITS)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = in_map(id_map, b.column("v").to_numpy())
            for part in slices(iter([b.filter(pa.array(hit))]), "text", TEXT_BYTES):
                code, at = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(code, at).view(np.int64)), binary_array(code.view(np.uint8), at * 8)], ["s", "codes"])

    sets = d.select("text", F.xxhash64("id").alias("v")).mapInArrow(again, "s long, codes binary")
    sets = sets.groupBy("s").agg(F.first("codes").alias("codes"))
    # Groups of bounded size: large ones by pairs of blocks.
    weight = groups.join(chosen.select("k", "n"), "k").groupBy("root").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("blocks")).withColumnRenamed("root", "w_root")
    dealt = groups.join(weight, F.col("root") == F.col("w_root")).withColumn("own", F.pmod(F.xxhash64("k", "root"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = dealt.withColumn("x", F.explode(other)).select("root", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "k", "own")
    if links:
        # A set's groups, and the rows that have it.
        several = groups.groupBy("k").agg(F.collect_list("root").alias("roots")).withColumnRenamed("k", "m_k")
        dealt = dealt.join(several, F.col("k") == F.col("m_k")).join(chosen.select(F.col("k").alias("c_k"), "rows"), F.col("k") == F.col("c_k"))
        dealt = dealt.select("root", "i", "j", "k", "own", "rows", F.filter("roots", lambda x: x < F.col("root")).alias("earlier"))

    def find(t: pa.Table) -> pa.Table:
        k = t.column("k").to_numpy()
        sets = [np.frombuffer(c, np.uint64) for c in t.column("codes").to_pylist()]
        if links:
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            own = t.column("own").to_numpy()
            # A block's inner links count where it meets the first other block.
            here = (i == j) | (i + j - own == np.where(own == 0, 1, 0))
            spanning, total = counted(sets, num, den, t.column("rows").to_numpy(), t.column("earlier").to_pylist(), np.where(here, own, -1 - own))
        else:
            spanning, total = [(p, q) for q, _, span in linked(sets, num, den, False) for p in span.tolist()], np.zeros(0, np.int64)
        a, b = (k[[x[i] for x in spanning]] if spanning else np.zeros(0, np.int64) for i in (0, 1))
        some = np.flatnonzero(total)
        none = pa.nulls(len(some), pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(a, pa.int64()), pa.array(k[some], pa.int64())]), "b": pa.concat_arrays([pa.array(b, pa.int64()), none]),
            "n": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(total[some], pa.int64())])})

    gathered = dealt.join(sets, F.col("k") == F.col("s")).drop("s").groupBy("root", "i", "j")
    found = gathered.applyInArrow(find, "a long, b long, n long")
    if links:
        found = written(found, "found")
    comps = components(found.where("n IS NULL").select("a", "b"))
    tied = comps.join(reps.select("k", "rep"), F.col("node") == F.col("k")).select("component", "rep", "k")
    names = tied.groupBy("component").agg(F.min("rep").alias("name")).withColumnRenamed("component", "c")
    named = tied.join(names, F.col("component") == F.col("c")).select(F.col("k").alias("l_k"), "name")
    every = reps.join(named, F.col("k") == F.col("l_k"), "left").select(F.col("k").alias("r_k"), F.coalesce("name", "rep").alias("component_id"), "rows")
    if links:
        near = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("near"))
        every = every.join(near, F.col("r_k") == F.col("a"), "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("near", F.lit(0)))
    out = nodes.join(every, F.col("k") == F.col("r_k"), "left")
    out = out.withColumn("component_id", F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id")))
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), links=True)
