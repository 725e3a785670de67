"""Set similarity over bit fingerprints: blocks of sets that meet once, top-k neighbours, coverage.

Sets are packed into words of 64 bits and dealt into blocks by a hash of their id; every two blocks meet as one key of an equi-join, and what two sets have in common is the
number of bits of their words' conjunction.  What is asked for (a least similarity, a sum, a largest value) is told as the pairs pass, so a pair that isn't asked for is never
written: a table is shuffled once a block, its pairs aren't.  The work is that of all pairs.  Bits beyond WORDS words are joined on the bits themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What rounding may take from a size bound: bounds are loosened by it, similarities themselves are exact.
SLIP = 1e-9
#: Sets of a block, words of a set, and tasks of a join.
BLOCK, WORDS, TASKS = 4096, 64, 2000


def set_bits(vec: str, above: float) -> Column:
    """Positions of a vector's components above a value, as an ascending array of set bits."""
    x = F.transform(F.col(vec).cast("array<double>"), lambda v, i: F.when(v > above, i))
    return F.array_compact(x)


def _common(a: DataFrame, b: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """a_id, b_id, a_n, b_n, c: bits in common of each pair that shares one; the join is on bits, pairs without a shared bit never meet."""
    x, y = (t.select(F.col("id").alias(f"{s}_id"), F.size("bits").alias(f"{s}_n"), *[F.col(k).alias(f"{s}_{k}") for k in keep], F.explode("bits").alias("bit")) for s, t in (("a", a), ("b", b)))
    return x.join(y, "bit").groupBy([c for s in (x, y) for c in s.columns if c != "bit"]).agg(F.count(F.lit(1)).alias("c"))


def _reach(fp: DataFrame) -> tuple[int, int | None]:
    """The number of rows and of words that hold all their bits; None if those are too many or a bit is negative."""
    r = fp.agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("bits")).alias("lo"), F.max(F.array_max("bits")).alias("hi")).first()
    words = 1 if r.hi is None else int(r.hi) // 64 + 1
    return r.n, words if words <= WORDS and (r.lo is None or r.lo >= 0) else None


def _packed(fp: DataFrame, words: int, keep: Sequence[str] = (), bare: bool = False) -> DataFrame:
    """id, n, w0, w1, ...: the sets that aren't empty (with `bare`, those too) as words."""
    one = F.lit(1).cast("long")
    word = lambda w: F.aggregate(F.filter("bits", lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", one, (b % 64).cast("int"))))
    return fp.where(F.size("bits") >= (0 if bare else 1)).select("id", F.size("bits").alias("n"), *[word(w).alias(f"w{w}") for w in range(words)], *keep)


def _shared(x: str, y: str, words: int) -> Column:
    """The number of bits that two sets share, whose columns have the given prefixes; sets of no words are compared on their bits."""
    if not words:
        return F.size(F.array_intersect(f"{x}bits", f"{y}bits"))
    return sum((F.bit_count(F.col(f"{x}w{w}").bitwiseAND(F.col(f"{y}w{w}"))) for w in range(1, words)), F.bit_count(F.col(f"{x}w0").bitwiseAND(F.col(f"{y}w0"))))


def _met(a: DataFrame, b: DataFrame | None, words: int, rows: tuple[int, int], where: Column | None = None, apart: str | None = None, every_pair: bool = False) -> DataFrame:
    """Every pair of packed sets, once, that shares a bit and fulfils a condition: their columns after a_ and b_, c (bits in common) and b_block.

    Without b, the pairs are those of a's own rows, either row first. With `apart` only rows of equal value of that column meet, of which rows counts the most.
    With `every_pair` pairs without a shared bit are told, too. Sets of no words (0) are compared on their bits.
    """
    same = b is None
    na, nb = (max(1, -(-n // BLOCK)) for n in rows)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    zero = F.lit(0).cast("long")
    x = a.withColumn("block", block(na))
    x = x.withColumn("m", every(F.col("block") if same else zero, F.lit(nb - 1).cast("long"))).withColumn("key", F.col("block") * nb + F.col("m")).drop("m")
    y = (a if same else b).withColumn("block", block(nb))
    y = y.withColumn("m", every(zero, F.col("block") if same else F.lit(na - 1).cast("long"))).withColumn("key", F.col("m") * nb + F.col("block")).drop("m")
    tasks = (na * (na + 1) // 2 if same else na * nb) * (1 if apart is None else 16)
    x, y = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns if c != "key"], (F.col("key") if apart is None else F.xxhash64(apart, "key")).alias("key")).repartition(min(tasks, TASKS), "key") for s, t in (("a", x), ("b", y)))
    c = _shared("a_", "b_", words)
    on = F.lit(True) if every_pair else c > 0
    if same:
        on = on & ((F.col("a_block") != F.col("b_block")) | (F.col("a_id") < F.col("b_id")))
    if apart is not None:
        on = on & F.col(f"a_{apart}").eqNullSafe(F.col(f"b_{apart}"))
    met = x.join(y.hint("shuffle_hash"), "key").where(on)
    met = met.withColumn("c", c)
    kept = [n for n in met.columns if n != "key" and n[2:] not in {"bits", *[f"w{w}" for w in range(words)]} and n != "a_block"]
    return (met if where is None else met.where(where)).select(*kept)


def _like() -> Column:
    return F.col("c") / (F.col("a_n") + F.col("b_n") - F.col("c"))


def _rare_pairs(fp: DataFrame, threshold: float) -> DataFrame:
    """a_id < b_id, similarity of all pairs of sets that share a bit and reach the threshold, however large the bits.

    Prefix filter: of two sets with Jaccard >= t one of the first n - ceil(t n) + 1 bits of each, in one order of all bits, is shared;
    only those are joined, rarest bits first, and candidates are verified on their arrays.
    """
    rare = fp.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("df"))
    ordered = fp.select("id", F.size("bits").alias("n"), F.explode("bits").alias("bit")).join(rare, "bit")  # a row per bit position
    w = Window.partitionBy("id").orderBy("df", "bit")
    prefix = ordered.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - SLIP) + 1).select("id", "n", "bit")
    a = prefix.select(F.col("id").alias("a_id"), F.col("n").alias("a_n"), "bit")
    b = prefix.select(F.col("id").alias("b_id"), F.col("n").alias("b_n"), "bit")
    size = (F.col("b_n") >= F.col("a_n") * threshold - SLIP) & (F.col("a_n") >= F.col("b_n") * threshold - SLIP)
    pairs = a.join(b, "bit").where((F.col("a_id") < F.col("b_id")) & size).select("a_id", "b_id").distinct()
    bits = lambda p: fp.select(F.col("id").alias(f"{p}_id"), F.col("bits").alias(f"{p}_bits"))
    v = pairs.join(bits("a"), "a_id").join(bits("b"), "b_id")
    c = F.size(F.array_intersect("a_bits", "b_bits"))
    s = c / (F.size("a_bits") + F.size("b_bits") - c)
    return v.select("a_id", "b_id", s.alias("similarity")).where(F.col("similarity") >= threshold)


def rows_and_similarity(fp: DataFrame) -> tuple[DataFrame, Callable[[str, str], Column]]:
    """The sets as rows, and the similarity of two whose columns have the given prefixes; two empty sets have similarity 1."""
    words = _reach(fp)[1]
    rows = fp.where("bits IS NOT NULL").select("id", F.size("bits").alias("n"), "bits") if words is None else _packed(fp, words, bare=True)

    def like(x: str, y: str) -> Column:
        c = _shared(x, y, words or 0)
        return F.coalesce(F.try_divide(c, F.col(f"{x}n") + F.col(f"{y}n") - c), F.lit(1.0))

    return rows, like


def similar_pairs(fp: DataFrame, threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    """a_id < b_id, similarity of all pairs that share a bit at the threshold or above, and columns to keep after a_ and b_; two empty sets have similarity 1."""
    rows, words = _reach(fp)
    named = [f"{s}_{k}" for s in "ab" for k in ("id", *keep)]
    if words is None:
        found = _rare_pairs(fp, threshold)
        for s in "ab" if keep else "":
            found = found.join(fp.select(F.col("id").alias(f"{s}_id"), *[F.col(k).alias(f"{s}_{k}") for k in keep]), f"{s}_id")
    else:
        # c >= t (n - c) needs no division; the exact quotient decides.
        enough = F.col("c") * (1 + threshold) >= (F.col("a_n") + F.col("b_n")) * threshold - SLIP
        found = _met(_packed(fp, words, keep), None, words, (rows, rows), enough).withColumn("similarity", _like()).where(F.col("similarity") >= threshold)
        turn = F.col("a_id") > F.col("b_id")
        found = found.select(*[F.when(turn, F.col(f"{o}_{k}")).otherwise(F.col(f"{s}_{k}")).alias(f"{s}_{k}") for s, o in ("ab", "ba") for k in ("id", *keep)], "similarity")
    bare = lambda p: fp.where(F.size("bits") == 0).select(*[F.col(k).alias(f"{p}_{k}") for k in ("id", *keep)], F.lit(0).alias("n"))
    return found.select(*named, "similarity").unionByName(bare("a").join(bare("b"), "n").where("a_id < b_id").select(*named, F.lit(1.0).alias("similarity")))


def every_pair(fp: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """a_id < b_id, similarity of all pairs of sets, shared bits or not, and columns to keep after a_ and b_; two empty sets have similarity 1.

    Nothing of the pairs is held: they pass one at a time, from blocks that meet once.
    """
    rows, words = _reach(fp)
    sets = fp.where("bits IS NOT NULL").select("id", F.size("bits").alias("n"), "bits", *keep) if words is None else _packed(fp, words, keep, bare=True)
    met = _met(sets, None, words or 0, (rows, rows), every_pair=True)
    turn = F.col("a_id") > F.col("b_id")
    named = [F.when(turn, F.col(f"{o}_{k}")).otherwise(F.col(f"{s}_{k}")).alias(f"{s}_{k}") for s, o in ("ab", "ba") for k in ("id", *keep)]
    return met.select(*named, F.when(F.col("a_n") + F.col("b_n") == 0, 1.0).otherwise(_like()).alias("similarity"))


def _tops(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """a_id, b_id, similarity: at least the k most similar other sets (all, if fewer) that share a bit with each query, and few more."""
    (nq, wq), (nr, wr) = _reach(queries), _reach(refs)
    if wq is None or wr is None:
        return _common(queries, refs).where("a_id <> b_id").select("a_id", "b_id", _like().alias("similarity"))
    words = max(wq, wr)
    q, r = _packed(queries, words), _packed(refs, words)
    # Of equal sets the k + 1 smallest ids can be among the k nearest.
    w = Window.partitionBy(*[f"w{i}" for i in range(words)]).orderBy("id")
    r = r.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    other = F.col("a_id") != F.col("b_id")
    # The k-th largest of the blocks' largest similarities is one that k others reach.
    parts = -(-8 * k // max(1, -(-nr // BLOCK)))
    part = F.pmod(F.xxhash64(F.lit(k), "b_id"), F.lit(parts)) if parts > 1 else F.lit(0)
    best = _met(q, r, words, (nq, nr), other).groupBy("a_id", "b_block", part.alias("part")).agg(F.max(_like()).alias("s"))
    least = best.groupBy(F.col("a_id").alias("l_id")).agg(F.get(F.sort_array(F.collect_list("s"), False), F.lit(k - 1)).alias("least"))
    held = q.join(least, F.col("id") == F.col("l_id")).drop("l_id").withColumn("least", F.coalesce("least", F.lit(0.0)))
    return _met(held, r, words, (nq, nr), other & (_like() >= F.col("a_least"))).select("a_id", "b_id", _like().alias("similarity"))


def nearest(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, ref_id, similarity of the k most similar others (all, if fewer), ties by id.

    Others that share no bit have similarity 0, of which only the k + 1 smallest ids can count; two empty sets have 1, and of those the
    same holds: both come from a broadcast of k + 1 rows, so only pairs with a shared bit are told apart.
    """
    q = queries.select(F.col("id").alias("a_id"), (F.size("bits") == 0).alias("bare"))
    low = lambda rows, s: rows.select(F.col("id").alias("b_id"), F.lit(s).alias("similarity")).orderBy("b_id").limit(k + 1)
    twins = q.where("bare").join(F.broadcast(low(refs.where(F.size("bits") == 0), 1.0))).where("a_id <> b_id").select("a_id", "b_id", "similarity")
    far = q.join(F.broadcast(low(refs, 0.0))).where("a_id <> b_id").select("a_id", "b_id", "similarity")
    c = _tops(queries, refs, k).unionByName(twins).unionByName(far).groupBy("a_id", "b_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("a_id").orderBy(F.desc("similarity"), "b_id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("a_id").alias("query_id"), "rank", F.col("b_id").alias("ref_id"), "similarity")


def closest(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """id, similarity of the most similar other of each query that shares a bit with one or is empty beside another empty one."""
    (nq, wq), (nr, wr) = _reach(queries), _reach(refs)
    if wq is None or wr is None:
        met = _common(queries, refs).where("a_id <> b_id")
    else:
        words = max(wq, wr)
        r = _packed(refs, words).withColumn("r", F.row_number().over(Window.partitionBy(*[f"w{i}" for i in range(words)]).orderBy("id"))).where("r <= 2").drop("r")
        met = _met(_packed(queries, words), r, words, (nq, nr), F.col("a_id") != F.col("b_id"))
    best = met.groupBy("a_id").agg(F.max(_like()).alias("similarity"))
    bare = refs.where(F.size("bits") == 0).select(F.col("id").alias("b_id")).orderBy("b_id").limit(2)
    twins = queries.where(F.size("bits") == 0).select(F.col("id").alias("a_id")).join(F.broadcast(bare)).where("a_id <> b_id").select("a_id", F.lit(1.0).alias("similarity")).distinct()
    return best.unionByName(twins).select(F.col("a_id").alias("id"), "similarity")


def similar_any(fp: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """a_id, b_id (either first), similarity of all pairs that share a bit or are both empty, and columns to keep after a_ and b_."""
    rows, words = _reach(fp)
    met = _common(fp, fp, keep).where("a_id < b_id") if words is None else _met(_packed(fp, words, keep), None, words, (rows, rows))
    named = [f"{s}_{k}" for s in "ab" for k in ("id", *keep)]
    bare = lambda p: fp.where(F.size("bits") == 0).select(*[F.col(k).alias(f"{p}_{k}") for k in ("id", *keep)], F.lit(0).alias("n"))
    return met.select(*named, _like().alias("similarity")).unionByName(bare("a").join(bare("b"), "n").where("a_id < b_id").select(*named, F.lit(1.0).alias("similarity")))


def shared_bits(fp: DataFrame, apart: str) -> DataFrame:
    """a_n, b_n, c and the column after a_ of all pairs that share a bit and have the same value (or none) of a column, each pair once."""
    words = _reach(fp)[1]
    if words is None:
        return _common(fp, fp, [apart]).where(F.col("a_id") < F.col("b_id")).where(F.col(f"a_{apart}").eqNullSafe(F.col(f"b_{apart}"))).select(f"a_{apart}", "a_n", "b_n", "c")
    most = fp.groupBy(apart).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return _met(_packed(fp, words, [apart]), None, words, (most, most), apart=apart).select(f"a_{apart}", "a_n", "b_n", "c")


def min_max(a: Column, b: Column) -> Column:
    """Similarity of two count vectors: the sum of the lesser counts over that of the greater ones; 1 for two empty ones."""
    both = F.zip_with(a, b, lambda x, y: F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")))
    total = lambda f: F.aggregate(F.transform(both, lambda p: p[f].cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(total("lo"), total("hi")), F.lit(1.0))


def cliffs(pairs: DataFrame, values: DataFrame, least_delta: float) -> DataFrame:
    """Similar pairs whose activities differ: a_id, b_id, similarity, delta, sali (null for identical fingerprints). values: id, value; pairs that hold a_value and b_value need none."""
    v = lambda p: values.select(F.col("id").alias(f"{p}_id"), F.col("value").alias(f"{p}_value"))
    j = pairs if "a_value" in pairs.columns else pairs.join(v("a"), "a_id").join(v("b"), "b_id")
    j = j.withColumn("delta", F.abs(F.col("a_value") - F.col("b_value")))
    return j.where(F.col("delta") >= least_delta).select("a_id", "b_id", "similarity", "delta", F.try_divide(F.col("delta"), 1 - F.col("similarity")).alias("sali"))
