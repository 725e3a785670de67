"""Prefix trie of conversations: every distinct sequence of first turns is a node, with what sharing it saves.

1. Turns.  Rows are range-sorted by conversation and order, so a conversation of any length is dealt over many tasks.  A turn's digest is the md5 of role
   and text, as four numbers modulo a prime; the digest of the first i turns is the sum of turn j's times r^j, lane by lane.  Such sums
   can be carried from task to task, and those of a sequence that starts later in a conversation follow from two of them: no turn is digested
   again when conversations are rebuilt.  Where a conversation goes on in the next task, one row a task says how far it has come.
2. Rebuilding.  The first turns of a conversation's base are at most HEAD rows of an array; a conversation is joined with its base's array, its later
   rows with their own conversation's figures.
3. Nodes.  Members are counted per digest, with the parent's digest: the edges.  A node with one member has one leaf and saves nothing below it, so
   only shared nodes take part in the rollup.
4. Rollup by pointer jumping.  In round j every node adds what it has gathered to the ancestor 2^j edges above and then points 2^(j+1) edges up, so the
   number of rounds is the logarithm of the depth.  The root gets the sum over all nodes.
5. The hash of a node's ended conversations: ids are range-sorted and joined to texts of at most CHUNK ids; a node's texts are hashed one after the
   other, so that memory is one text's, whatever the number of its conversations.

Defined cases: turns are ordered by turn (null first), role, text; repeated rows are repeated turns; null role or text is empty. Rows without a conversation's id
are left out. A base that isn't there gives no turns, and a rebuilt conversation may have none: it ends at the root. An empty table has no nodes. Other
columns are ignored, whatever their names. Texts are never cut; a text is hashed where it lies, in the JVM. Sequences are told apart by 124 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, dropped, table, written

#: The prime of the digests, and each lane's factor.
PRIME = (1 << 31) - 1
LANES = (16807, 48271, 69621, 630360016)
#: Turns that a base lends at most: fold - 1 of rebuilt().
FOLD = 9
#: Ids of a node that are joined to one text.
CHUNK = 1 << 15


def _powers(base: int, upto: int) -> np.ndarray:
    """base^0 .. base^upto modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) <= upto:
        step = out[-1] * np.uint64(base) % np.uint64(PRIME)
        out = np.r_[out, out * step % np.uint64(PRIME)]
    return out[: upto + 1]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's number, term and running sum in its conversation, as far as this task has it; at the end a row (turn null) for the last conversation."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    names = ["task", "conv", "i", "bytes", *(f"x{l}" for l in range(4)), *(f"p{l}" for l in range(4))]
    power = [_powers(r, 64) for r in LANES]
    last, count, carry = None, 0, np.zeros(4, np.uint64)

    def rows(conv: np.ndarray, i: np.ndarray, size: pa.Array, x: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        lanes = [pa.array(v[l].astype(np.int64)) for v in (x, p) for l in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), task, np.int32)), pa.array(conv), pa.array(i), size, *lanes], names)

    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv").to_numpy()
        digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), "<u4").reshape(-1, 4).astype(np.uint64) % np.uint64(PRIME)
        start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        goes_on = conv[0] == last
        of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(conv)]))
        i = np.arange(len(conv)) - start[of] + 1
        if goes_on:
            i[of == 0] += count
        x, p = np.zeros((4, len(conv)), np.uint64), np.zeros((4, len(conv)), np.uint64)
        for l, r in enumerate(LANES):
            if len(power[l]) <= i.max():
                power[l] = _powers(r, 2 * int(i.max()))
            x[l] = digest[:, l] * power[l][i] % np.uint64(PRIME)
            total = np.cumsum(x[l])
            p[l] = total - (total[start] - x[l][start])[of]
            if goes_on:
                p[l][of == 0] += carry[l]
            p[l] %= np.uint64(PRIME)
        yield rows(conv, i, b.column("bytes"), x, p)
        last, count, carry = conv[-1], int(i[-1]), p[:, -1].copy()
    if last is not None:
        yield rows(np.array([last]), np.array([count]), pa.nulls(1, pa.int64()), np.zeros((4, 1), np.uint64), carry[:, None])


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, i (from 1, by turn, role, text), bytes of the text, x0..x3: the turn's term, p0..p3: the digest of the first i turns."""
    bounded(conversations.sparkSession)
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    t = t.select("conv", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    lanes = ", ".join(f"{v}{l} long" for v in "xp" for l in range(4))
    made = written(t.mapInArrow(_sums, f"task int, conv long, i long, bytes long, {lanes}"), "turns")
    # One row a task: what a conversation has had before the task that it goes on in.
    ends = made.where("bytes IS NULL").orderBy("task").collect()
    before, at = [], {}
    for e in ends:
        if at.get("conv") != e.conv:
            at = {"conv": e.conv, "count": 0, "sums": (0,) * 4}
        sums = tuple((s + e[f"p{l}"] * pow(LANES[l], at["count"], PRIME)) % PRIME for l, s in enumerate(at["sums"]))
        at = {"conv": e.conv, "count": at["count"] + e.i, "sums": sums, "task": e.task}
        before.append((e.task + 1, e.conv, at["count"], *sums, *(pow(r, at["count"], PRIME) for r in LANES)))
    # A task without rows passes on what the one before has said.
    spans = [(later.task, *b[1:]) for b, later in zip(before, ends[1:], strict=False)]
    schema = "b_task int, b_conv long, b_i long, " + ", ".join(f"{v}{l} long" for v in ("b_p", "b_r") for l in range(4))
    carried = F.broadcast(conversations.sparkSession.createDataFrame(spans, schema))
    j = made.where("bytes IS NOT NULL").join(carried, (F.col("task") == F.col("b_task")) & (F.col("conv") == F.col("b_conv")), "left")
    shift = lambda v, l: F.col(f"{v}{l}") * F.coalesce(f"b_r{l}", F.lit(1))
    x = [(shift("x", l) % PRIME).alias(f"x{l}") for l in range(4)]
    p = [((F.coalesce(f"b_p{l}", F.lit(0)) + shift("p", l)) % PRIME).alias(f"p{l}") for l in range(4)]
    return j.select("conv", (F.col("i") + F.coalesce("b_i", F.lit(0))).alias("i"), "bytes", *x, *p)


def rebuilt(t: DataFrame, fold: int = FOLD, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, ends) of the rebuilt conversations. members: k1, k2 (node), q1, q2 (its parent, null at the root), depth, bytes, conv; ends: k1, k2, conv.

    The first h turns of conversation c - c % family, then c's own after its first h; h = crc32(c as text) % fold.
    """
    lane = lambda x, n: [x[f"{n}{l}"] for l in range(4)]
    some = F.when(F.col("i") < fold, F.struct("i", "bytes", *(f"{v}{l}" for v in "xp" for l in range(4))))
    heads = t.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(some)).alias("head"), F.max(F.struct("i", *(f"p{l}" for l in range(4)))).alias("end"))
    base = heads.select(F.col("conv").alias("b_conv"), F.col("n").alias("b_n"), F.col("head").alias("b_head"))
    info = heads.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % fold).join(base, F.col("conv") - F.col("conv") % family == F.col("b_conv"), "left")
    info = info.withColumn("m", F.least("h", F.coalesce("b_n", F.lit(0)))).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    zero = F.struct(*(F.lit(0).cast("long").alias(f"p{l}") for l in range(4)))
    only = lambda head: F.transform(head, lambda e: F.struct(*(e[f"p{l}"].alias(f"p{l}") for l in range(4))))
    at = lambda head, i: F.when(i > 0, F.coalesce(F.get(only(head), (i - 1).cast("int")), zero)).otherwise(zero)
    info = written(info.select("conv", "n", "h", "m", "length", "end", F.filter("b_head", lambda e: e["i"] <= F.col("m")).alias("lent"), at(F.col("head"), F.col("h")).alias("skipped"), at(F.col("b_head"), F.col("m")).alias("kept")), "rebuilt")
    # Own turns move down where the base lends fewer than h: their terms are divided by r as often.
    back = [F.array(*[F.lit(pow(r, -s, PRIME)) for s in range(fold)]) for r in LANES]
    moved = lambda l: F.get(back[l], (F.col("h") - F.col("m")).cast("int"))
    joined = lambda p, l: (F.col("kept")[f"p{l}"] + moved(l) * F.pmod(p - F.col("skipped")[f"p{l}"], F.lit(PRIME)) % PRIME) % PRIME

    def pair(v: list[Column], k: str) -> list[Column]:
        return [(F.shiftleft(v[j], 31) + v[j + 1]).alias(f"{k}{j // 2 + 1}") for j in (0, 2)]

    lent = info.select("conv", F.explode("lent").alias("e"))
    parent = [F.pmod(F.col("e")[f"p{l}"] - F.col("e")[f"x{l}"], F.lit(PRIME)) for l in range(4)]
    lent = lent.select(*pair(lane(F.col("e"), "p"), "k"), *pair(parent, "q"), F.col("e.i").alias("depth"), F.col("e.bytes").alias("bytes"), "conv")
    own = t.withColumnRenamed("conv", "t_conv").join(info.select("conv", "h", "m", "skipped", "kept"), F.col("t_conv") == F.col("conv")).where(F.col("i") > F.col("h"))
    here = [joined(F.col(f"p{l}"), l) for l in range(4)]
    parent = [joined(F.pmod(F.col(f"p{l}") - F.col(f"x{l}"), F.lit(PRIME)), l) for l in range(4)]
    own = own.select(*pair(here, "k"), *pair(parent, "q"), (F.col("m") + F.col("i") - F.col("h")).alias("depth"), "bytes", "conv")
    none = F.lit(None).cast("long")
    root = info.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), none.alias("q1"), none.alias("q2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "conv")
    last = [F.when(F.col("n") > F.col("h"), joined(F.col("end")[f"p{l}"], l)).otherwise(F.col("kept")[f"p{l}"]) for l in range(4)]
    return lent.unionByName(own).unionByName(root), info.select(*pair(last, "k"), "conv")


def ended(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the conversations (conv) that end at a node, ascending."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k1, k2, conv = (b.column(c).to_numpy() for c in ("k1", "k2", "conv"))
            start = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            stop = np.r_[start[1:], len(conv)]
            cut = np.concatenate([np.arange(s, e, CHUNK) for s, e in zip(start, stop, strict=True)]) if (stop - start).max() > CHUNK else start
            ids = b.column("conv").cast(pa.string()).to_pylist()
            joined = [",".join(ids[s:e]) for s, e in zip(cut, np.r_[cut[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cut]), pa.array(k2[cut]), pa.array(conv[cut]), pa.array(joined)], ["k1", "k2", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            done = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if at == (k1, k2):
                    sha.update(b"," + ids.encode())
                else:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, sha.hexdigest())], ["k1", "k2", "ends_sha256"])

    order = ["k1", "k2", "conv"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(texts, "k1 long, k2 long, first long, ids string")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def rollup(shared: DataFrame) -> DataFrame:
    """k1, k2 with the sums of leaves and saved over each node's subtree. shared: k1, k2, q1, q2, depth (1 or more), leaves, saved; parents are in it.

    As many rounds as the logarithm of the depth; each gathers, points twice as far and ends in a table.
    """
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    top = F.col("depth") <= 1
    cur = written(shared.select("k1", "k2", F.when(~top, F.col("q1")).alias("q1"), F.when(~top, F.col("q2")).alias("q2"), "leaves", "saved"), "rollup")
    reach = 1
    while reach < deepest:
        up = cur.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("u1"), F.col("q2").alias("u2")).agg(F.sum("leaves").alias("u_leaves"), F.sum("saved").alias("u_saved"))
        far = cur.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("q1").alias("n1"), F.col("q2").alias("n2"))
        new = cur.join(up, (F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2")), "left").join(far, (F.col("q1") == F.col("a1")) & (F.col("q2") == F.col("a2")), "left")
        new = new.select("k1", "k2", F.col("n1").alias("q1"), F.col("n2").alias("q2"), (F.col("leaves") + F.coalesce("u_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("u_saved", F.lit(0))).alias("saved"))
        old, cur = cur, written(new, "rollup")
        dropped(old)
        reach *= 2
    return cur.select("k1", "k2", "leaves", "saved")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes), ends_sha256."""
    members, ends = rebuilt(turns(conversations, conv_col, turn_col, role_col, text_col))
    first = lambda c: F.min(c).alias(c)  # noqa: E731  equal in all members
    nodes = members.groupBy("k1", "k2").agg(first("q1"), first("q2"), first("depth"), first("bytes"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = written(nodes, "nodes")
    kids = nodes.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("c1"), F.col("q2").alias("c2")).agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.when(F.col("n_convs") == 1, 1).otherwise(0)).alias("lone"))
    full = nodes.join(kids, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").drop("c1", "c2").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    values = full.where((F.col("n_convs") > 1) | (F.col("depth") == 0)).select("k1", "k2", "q1", "q2", "depth", F.when(F.col("n_children") == 0, 1).otherwise(F.col("lone")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    values = written(values, "values")
    total = values.agg(F.lit(0).cast("long").alias("t_depth"), F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))  # one row
    rolled = rollup(values.where("depth > 0")).select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "leaves", "saved")
    above = nodes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv_id").alias("parent_conv_id"))
    out = full.join(above, (F.col("q1") == F.col("a1")) & (F.col("q2") == F.col("a2")), "left")
    out = out.join(rolled, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
    hashes = ended(ends).withColumnsRenamed({"k1": "e1", "k2": "e2"})
    out = out.join(hashes, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left").join(F.broadcast(total), F.col("depth") == F.col("t_depth"), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("t_leaves", "leaves", F.lit(1)).alias("n_leaves"), F.coalesce("t_saved", "saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT i AS b, 0 AS step, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT b, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE step < 8
), crc8 AS (SELECT b, v FROM crc WHERE step = 8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
walk AS (
  SELECT c, CAST(c AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS v FROM ids
  UNION ALL SELECT w.c, w.s, w.i + 1, xor(w.v >> 8, t.v) FROM walk w JOIN crc8 t ON t.b = xor(w.v % 256, ascii(substr(w.s, w.i + 1, 1))) WHERE w.i < length(w.s)
), h AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM walk WHERE i = length(s)),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT h.c, t.i AS o, t.role, t.text FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.i <= h.h
  UNION ALL SELECT h.c, 1000000 + t.i, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.i > h.h
), p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, md5(length(role) || ':' || role || text) AS g, strlen(text) AS bytes FROM r),
s AS (SELECT c, d, bytes, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM p),
m AS (
  SELECT c, d, bytes, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), 'root') AS q FROM s UNION ALL SELECT c, 0, 0, 'root', NULL FROM ids
), l AS (SELECT c, max(d) AS n FROM m GROUP BY c),
n AS (
  SELECT k, any_value(q) AS q, any_value(d) AS d, any_value(bytes) AS bytes, min(c) AS c, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN d = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends
  FROM m JOIN l USING (c) GROUP BY k
), kids AS (SELECT q, count(*) AS n_children FROM n WHERE q IS NOT NULL GROUP BY q),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM n LEFT JOIN kids ON n.k = kids.q),
up AS (SELECT k AS top, k, n_children, saved FROM v UNION ALL SELECT p.q, up.k, up.n_children, up.saved FROM up JOIN v p ON p.k = up.top WHERE p.q IS NOT NULL),
totals AS (SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM up GROUP BY top)
SELECT v.c AS conv_id, v.d AS depth, pa.c AS parent_conv_id, v.n_convs, v.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(totals.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN totals ON v.k = totals.top LEFT JOIN n pa ON pa.k = v.q
"""
