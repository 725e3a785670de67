"""Near duplicates by one-permutation MinHash, with links confirmed on full sets.

1. Sets and sketches.  A text's set is its distinct word shingles (as in `jaccard`); texts with equal sets are one node.  One hash deals a set's
   shingles into BINS bins, whose least values are the sketch; an empty bin takes the value of the first bin with one along a sequence of bins that only
   depends on its own number (optimal densification), so that similar sets borrow alike.
2. Buckets.  ROWS bins in turn are a band; nodes with equal bands share a bucket.  Bands are as many as make the chance that two sets at the threshold share no
   bucket less than MISS.  Sets so small that only equal ones can be linked have no bands.  Buckets of one node are dropped by a bit map first.
3. Stars.  Each bucket's centre is its node with most shared buckets; a candidate edge joins it with every other node: as many edges as nodes, not pairs.
   Edges are confirmed on full sets; a centre's edges are dealt into parts of bounded size, so a centre with a third of all nodes is many tasks' work.
4. The rest, exactly.  Two nodes of a bucket may be linked with each other and not with its centre.  Buckets whose nodes, the centre left out, still are
   in several components after the stars are searched whole, by the inverted index of `jaccard.linked`, in blocks of bounded size.
5. Components of all confirmed links.

Defined cases: those of `jaccard`: words are maximal runs without ASCII white space, A-Z lower-cased; fewer words than a shingle has are one shingle; texts without
words, and null, are linked with nothing and kept. Null ids take part; they name a component only if all its ids are null. Rows that repeat an id
are nodes by their own texts. An empty table gives no rows; other columns are ignored; texts are never cut. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import binary_array, bit_map, bounded, in_map, list_array, ragged, slices, table, written
from .jaccard import GROUP, MAP_BITS, _flat, components, linked, mix, one_each, set_keys, shared_routes, shingle_sets

#: Bins of a band, and the chance that a pair at the threshold shares no bucket.
ROWS = 6
MISS = 1e-6
#: Sets that are sketched at once.
SKETCHED = 4096
#: Bins that are tried for an empty one before its neighbours are.
TRIES = 2000


def bands(num: int, den: int) -> int:
    """How many bands of ROWS bins lose a pair at the threshold with a chance under MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (num / den) ** ROWS))


def sketches(code: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """The densified sketch of each set (none may be empty), a row a set."""
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    cell = own * bins + ((code >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # codes are ascending in a set, so bins are
    out, full = np.zeros(len(n) * bins, np.uint64), np.zeros(len(n) * bins, bool)
    out[cell[first]] = np.minimum.reduceat(mix(code), first)
    full[cell[first]] = True
    out, full = out.reshape(-1, bins), full.reshape(-1, bins)
    row, col = np.nonzero(~full)
    for t in range(1, TRIES + bins):
        if not len(row):
            break
        # After TRIES hashes, bin after bin: every set has a full one.
        near = (mix(col.astype(np.uint64) * np.uint64(TRIES) + np.uint64(t)) % np.uint64(bins)).astype(np.int64) if t <= TRIES else (col + t - TRIES) % bins
        hit = full[row, near]
        out[row[hit], col[hit]] = out[row[hit], near[hit]]
        row, col = row[~hit], col[~hit]
    return out


def buckets(code: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket names of each set's bands and offsets by set; none where only equal sets can be linked."""
    n = np.diff(at)
    count = bands(num, den)
    use = np.flatnonzero((n > 0) & ((n * den // num > n) | (-(-n * num // den) < n)))
    names = np.zeros((len(use), count), np.uint64)
    for s in range(0, len(use), SKETCHED):
        part = use[s : s + SKETCHED]
        sketch = sketches(code[ragged(at[part], n[part])], np.r_[0, np.cumsum(n[part])], count * ROWS).reshape(len(part), count, ROWS)
        h = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(part), count))
        for j in range(ROWS):
            h = mix(h * np.uint64(3) + sketch[:, :, j])
        names[s : s + SKETCHED] = h
    size = np.zeros(len(n), np.int64)
    size[use] = count
    return names.ravel(), np.r_[0, np.cumsum(size)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links of Jaccard >= num / den reach), kept (is the component's name)."""
    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            code, at = shingle_sets(b.column("text"), words)
            n = np.diff(at)
            name, name_at = buckets(code, at, num, den)
            need, none = pa.array(np.ones(len(n), np.int32)), list_array(np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64), pa.int64())
            cols = [b.column("id"), pa.array(n), pa.array(set_keys(code, at).view(np.int64), mask=n == 0), list_array(name.view(np.int64), name_at, pa.int64()), need, none, need]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "k", "routes0", "need0", "routes1", "need1"])

    made = written(d.mapInArrow(keys, f"id {kind}, n long, k long, routes0 array<long>, need0 int, routes1 array<long>, need1 int"), "sketches")
    nodes = made.select("id", "n", "k")
    reps = nodes.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    banded = one_each(made)
    shared = written(shared_routes(banded), "buckets")
    bucket_map = bit_map(shared, MAP_BITS)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, own = _flat(b.column("routes0"))
            hit = in_map(bucket_map, v)
            yield pa.RecordBatch.from_arrays([pa.array(v[hit]), pa.array(b.column("k").to_numpy()[own[hit]])], ["v", "k"])

    met = written(banded.mapInArrow(meeting, "v long, k long").distinct().join(shared, "v"), "met")
    # Stars: a bucket's centre is the node with most buckets.
    weight = met.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    centres = met.join(weight, "k").groupBy("v").agg(F.max(F.struct("c", "k")).alias("most"), F.count(F.lit(1)).alias("members")).where("members > 1")
    starred = written(met.join(centres.select("v", F.col("most.k").alias("root")), "v"), "starred")
    edges = starred.where("k <> root").select("root", "k").distinct().join(reps.select("k", "n"), "k")
    edges = edges.join(reps.select(F.col("k").alias("root_k"), F.col("n").alias("root_n")), F.col("root") == F.col("root_k")).drop("root_k")
    edges = written(edges.where((F.least("n", "root_n") * den >= F.greatest("n", "root_n") * num)), "edges")
    chosen = written(starred.select("k").distinct().join(reps, "k"), "chosen")
    id_map = bit_map(chosen.select(F.xxhash64("rep").alias("v")), MAP_BITS)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = in_map(id_map, b.column("v").to_numpy())
            for part in slices(iter([b.filter(pa.array(hit))]), "text", 4 << 20):
                code, at = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(code, at).view(np.int64)), binary_array(code.view(np.uint8), at * 8)], ["s", "codes"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The rows (k, ...) with the sets of their nodes; texts are read once more."""
        sets = d.select("text", F.xxhash64("id").alias("v")).mapInArrow(again, "s long, codes binary").groupBy("s").agg(F.first("codes").alias("codes"))
        return wanted.join(sets, F.col("k") == F.col("s")).drop("s")

    def confirm(t: pa.Table) -> pa.Table:
        k, root = t.column("k").to_numpy(), t.column("root")[0].as_py()
        sets = [np.frombuffer(c, np.uint64) for c in t.column("codes").to_pylist()]
        centre = sets[int(np.flatnonzero(k == root)[0])]
        rest = [i for i in range(len(k)) if k[i] != root]
        code, size = np.concatenate([sets[i] for i in rest]), np.array([len(sets[i]) for i in rest], np.int64)
        inside = centre[np.minimum(np.searchsorted(centre, code), len(centre) - 1)] == code
        both = np.add.reduceat(inside, np.r_[0, np.cumsum(size)[:-1]], dtype=np.int64)
        good = k[rest][den * both >= num * (len(centre) + size - both)]
        return pa.table({"a": pa.array(np.full(len(good), root, np.int64)), "b": pa.array(good)})

    # A centre's edges in parts of GROUP shingles; every part gets the centre's set.
    parts = edges.groupBy("root").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("parts")).withColumnRenamed("root", "p_root")
    dealt = edges.join(parts, F.col("root") == F.col("p_root")).select("root", F.pmod(F.xxhash64("k", "root"), F.col("parts")).cast("int").alias("part"), "k")
    dealt = dealt.unionByName(dealt.select("root", "part", F.col("root").alias("k")).distinct())
    stars = written(sets_of(dealt).groupBy("root", "part").applyInArrow(confirm, "a long, b long"), "stars")
    # Buckets whose nodes beside the centre are in several components yet.
    comps = components(stars).withColumnRenamed("node", "c_node")
    placed = starred.where("k <> root").join(comps, F.col("k") == F.col("c_node"), "left").select("v", "root", "k", F.coalesce("component", "k").alias("comp"))
    open_buckets = placed.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("v")
    groups = written(placed.join(open_buckets, "v").select("root", "k", "comp").distinct(), "open")
    blocks = groups.join(chosen.select("k", "n"), "k").groupBy("root").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("blocks")).withColumnRenamed("root", "w_root")
    spread = groups.join(blocks, F.col("root") == F.col("w_root")).withColumn("own", F.pmod(F.xxhash64("k", "root"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    spread = spread.withColumn("x", F.explode(other)).select("root", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "k", "comp")

    def find(t: pa.Table) -> pa.Table:
        k = t.column("k").to_numpy()
        sets = [np.frombuffer(c, np.uint64) for c in t.column("codes").to_pylist()]
        known = np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]
        pairs = [(p, q) for q, _, span in linked(sets, num, den, False, known) for p in span.tolist()]
        a, b = (k[[x[i] for x in pairs]] if pairs else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    if groups.limit(1).count():
        rest = written(sets_of(spread).groupBy("root", "i", "j").applyInArrow(find, "a long, b long"), "rest")
        comps = components(comps.where("c_node <> component").select(F.col("c_node").alias("a"), F.col("component").alias("b")).unionByName(rest)).withColumnRenamed("node", "c_node")
    tied = comps.join(reps.select("k", "rep"), F.col("c_node") == F.col("k")).select("component", "rep", "k")
    names = tied.groupBy("component").agg(F.min("rep").alias("name")).withColumnRenamed("component", "c")
    named = tied.join(names, F.col("component") == F.col("c")).select(F.col("k").alias("l_k"), "name")
    every = reps.join(named, F.col("k") == F.col("l_k"), "left").select(F.col("k").alias("r_k"), F.coalesce("name", "rep").alias("component_id"))
    out = nodes.join(every, F.col("k") == F.col("r_k"), "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)
