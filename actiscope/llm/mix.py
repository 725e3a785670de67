"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Every source has a weight schedule w(t) = w * (1 + g * (2t - 1)) over training time t in 0..1.  Its integral is w, so the
targets don't depend on g; the integral up to t, as a share, is F(t) = (1 - g) t + g t^2.  A source's stream runs through
its documents in the order of a hash of their ids, as often as the target asks; a copy whose middle lies at share y of the stream is wanted
at the time F^-1(y), its training position.  Documents are range-sorted by position.

Targets: all sources share budget * (all words) by weight; a target stops at max_repeat times its source's words, and the excess is
reshared by weight among the others (water filling, in closed form over the sources sorted by cap / weight).

Where a document lies in its stream: its place in 0..1 comes from md5(id).  A source's words are summed in KNOTS equal steps of the place, so
the stream's running sum is known exactly at each knot.  Which rows are taken once more is decided exactly: rows of the steps below the one
that the target ends in are, those above aren't, and in that step rows are summed in order of place and size; a row is taken if the middle of its words lies
below the target.  Rows of one place and size (of one id, or copies without an id) that the target ends in are numbered, and as many of them are taken as fit.
So the words that a mix takes of a source miss the target by half of one document's at most.  Positions in training time take the running sum as linear between two knots.
With it a row's copies and positions follow from the row and a table of KNOTS sums a source: no text is joined or sorted with others but for the range sort at
the end, and no task holds a source (one orders the distinct places of one step of a source, a KNOTS-th of it).

Defined cases: null text has size 0; null source is a source of its own, last in order; a null id has its place from its text. Documents of size 0
get as many copies as their place says, 0 words each. Rows that repeat an id have one place; which of those of one size are taken once more isn't defined,
how many are is. An empty table gives no rows. Other columns are ignored by `mix` and carried by `mixed`, whatever their names. Very long texts are one document: never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .base import WORD, fresh, table, written

WEIGHTS = (3.0, 1.0, 2.0)
#: Slope g of each source's schedule, in turn: rising, level, falling.
SLOPES = (0.5, 0.0, -0.5)
#: Steps in which a source's running sum of words is known exactly.
KNOTS = 1024
#: Rows of the table of steps that are broadcast at most, some 60 bytes each.
BROADCAST_ROWS = 500_000


def _cycle(values: tuple[float, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(i - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_repeat: float = 2.0, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """source, source_size -> with target and slope. One row per source, so the windows over all of them are small."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    s = sources.withColumn("i", F.row_number().over(by_name)).withColumn("w", _cycle(weights, F.col("i"))).withColumn("slope", _cycle(slopes, F.col("i")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("i"))
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"), "slope")


def position(share: Column, slope: Column) -> Column:
    """The time t with (1 - g) t + g t^2 = share."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / F.when(slope == 0, F.lit(1.0)).otherwise(2 * slope))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_repeat: float = 2.0, slopes: tuple[float, ...] = SLOPES) -> tuple[DataFrame, list[str]]:
    """docs and the columns size, source_size, target, copies, positions (of the copies, ascending), under the returned names."""
    names = fresh(docs, "size", "source_size", "target", "copies", "positions", "place", "knot", "key", "k_key", "k_knot", "offset", "inside", "slope", "last", "t_place", "t_size", "t_rows", "number", "rank")
    size, source_size, target, copies, positions, place, knot, key, k_key, k_knot, offset, inside, slope, last, t_place, t_size, t_rows, number, rank = names
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    rows = docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn(place, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2.0**32))
    rows = rows.withColumn(knot, F.floor(F.col(place) * KNOTS).cast("int")).withColumn(key, F.col(source_col).cast("string"))
    narrow = written(rows.select(F.col(key).alias("source"), F.col(place).alias("place"), F.col(knot).alias("step"), F.col(size).alias("size")), "mix")
    # KNOTS rows a source at most: the sums of the steps, folded on the map side first.
    steps = written(narrow.groupBy("source", "step").agg(F.sum("size").alias("words")), "steps")
    small = steps.count() <= BROADCAST_ROWS
    # Their size is known: up to BROADCAST_ROWS rows are sent to every task, so that the texts stay where they are; beyond, both sides are shuffled.
    sent = F.broadcast if small else lambda df: df
    sources = targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_repeat, slopes)
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("offset", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    steps = steps.join(sources.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source")))
    steps = steps.withColumn("rest", F.col("target") - _whole(F.col("target"), F.col("source_size")) * F.col("source_size"))
    ends = steps.where((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("words"))).select(F.col("source").alias("e_source"), F.col("step").alias("last"), F.col("offset").alias("e_offset"), "rest")
    ends = written(ends, "ends")  # a row a source
    # In the step that a target ends in: how many rows of each place and size are taken, and the first of which not all are.
    met = narrow.join(sent(ends), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("step") == F.col("last")))
    groups = met.groupBy("source", "place", "size", "e_offset", "rest").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("e_offset") - F.coalesce(F.sum(F.col("rows") * F.col("size")).over(before), F.lit(0))
    fit = F.when(F.col("size") == 0, F.when(left > 0, F.col("rows")).otherwise(0)).otherwise(F.least("rows", F.greatest(F.lit(0), F.ceil(left / F.greatest("size", F.lit(1)) - 0.5))))
    groups = groups.withColumn("fit", fit).where(F.col("fit") < F.col("rows"))
    first = groups.groupBy(F.col("source").alias("f_source")).agg(F.min(F.struct("place", "size", "fit")).alias("f"))
    first = written(ends.join(first, F.col("e_source").eqNullSafe(F.col("f_source")), "left").select("e_source", "last", F.col("f.place").alias("t_place"), F.col("f.size").alias("t_size"), F.coalesce("f.fit", F.lit(0)).cast("long").alias("t_rows")), "first")
    steps = steps.join(sent(first), F.col("source").eqNullSafe(F.col("e_source")), "left")
    steps = steps.select(F.col("source").alias(k_key), F.col("step").alias(k_knot), F.col("offset").alias(offset), F.col("words").alias(inside), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("slope").alias(slope), F.col("last").alias(last), F.col("t_place").alias(t_place), F.col("t_size").alias(t_size), F.col("t_rows").alias(t_rows))
    run = rows.join(sent(steps), F.col(key).eqNullSafe(F.col(k_key)) & (F.col(knot) == F.col(k_knot)))
    here = F.struct(F.col(place), F.col(size)) < F.struct(F.col(t_place), F.col(t_size))
    more = F.when(F.col(knot) < F.col(last), 1).when(F.col(knot) > F.col(last), 0).when(F.col(last).isNull(), 0).otherwise(F.when(F.col(t_place).isNull() | here, 1).otherwise(0))
    split = F.coalesce((F.col(knot) == F.col(last)) & (F.col(place) == F.col(t_place)) & (F.col(size) == F.col(t_size)) & (F.col(t_rows) > 0), F.lit(False))
    run = run.withColumn(copies, _whole(F.col(target), F.col(source_size)).cast("int") + more)
    if first.where("t_rows > 0").limit(1).count():
        # Rows alike of which some are taken: numbered in ranges, source by source.
        alike = written(run.where(split).withColumn(number, F.monotonically_increasing_id()), "alike")
        ordered = ranked(alike, [key, number], rank)
        begin = ordered.groupBy(F.col(key).alias("b_key")).agg(F.min(rank).alias("b_rank"))
        ordered = ordered.join(sent(begin), F.col(key).eqNullSafe(F.col("b_key")))
        ordered = ordered.withColumn(copies, F.col(copies) + F.when(F.col(rank) - F.col("b_rank") < F.col(t_rows), 1).otherwise(0)).select(*run.columns)
        run = run.where(~split).unionByName(ordered)
    middle = F.col(offset) + (F.col(place) * KNOTS - F.col(knot)) * F.col(inside)
    share = lambda j: F.least(F.lit(1.0), F.coalesce(F.try_divide(j * F.col(source_size) + middle, F.col(target)), F.lit(0.0)))
    times = F.transform(F.sequence(F.lit(0), F.greatest(F.col(copies) - 1, F.lit(0))), lambda j: position(share(j), F.col(slope)))
    run = run.withColumn(positions, F.when(F.col(copies) > 0, times).otherwise(F.array().cast("array<double>")))
    return run.select(*docs.columns, size, source_size, target, copies, positions), [size, source_size, target, copies, positions]


def _whole(target: Column, source_size: Column) -> Column:
    """How often a source is taken whole."""
    return F.coalesce(F.floor(F.try_divide(target, source_size)), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row: id, size, source_size, target, taken, copies, position (of the first copy, else null); range-sorted by position."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    p, (size, source_size, target, copies, positions) = placed(narrow, "id", "text", "source", **options)
    first = F.round(F.get(F.col(positions), F.lit(0)), 9)
    out = p.select(F.col("id").alias(id_col), F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), (F.col(copies) * F.col(size)).alias("taken"), F.col(copies).alias("copies"), first.alias("position"))
    out = written(out, "mixed")  # narrow rows: the range sort's sample reads them, not the texts again
    return out.repartitionByRange(F.asc_nulls_last("position"), id_col).sortWithinPartitions(F.asc_nulls_last("position"), id_col)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training order: the rows of docs, each as often as it is taken, range-sorted by training position; columns as before.

    The texts are shuffled once, in that sort.
    """
    p, (*_, copies, positions) = placed(docs, id_col, text_col, source_col, **options)
    at = fresh(p, "position")[0]
    rows = p.where(F.col(copies) > 0).select(*docs.columns, F.explode(positions).alias(at))
    return rows.repartitionByRange(at, id_col).sortWithinPartitions(at, id_col).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS place FROM documents
), e AS (SELECT *, CAST(floor(place * 1024) AS INTEGER) AS knot FROM d),
k AS (SELECT source, knot, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY source, knot),
o AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY knot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(i - 1) % 3 + 1]::DOUBLE AS wt, [0.5, 0.0, -0.5][(i - 1) % 3 + 1]::DOUBLE AS g, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, g, least(cap, (SELECT max(lv) FROM l) * wt) AS target FROM l),
b AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole, target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS rest FROM t),
x AS (SELECT b.source, o.knot AS last, o.before, b.rest FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source AND o.before <= b.rest AND b.rest < o.before + o.words),
r AS (
  SELECT e.doc_id, e.size, b.source_size, b.target, b.g, b.whole, o.before + (e.place * 1024 - e.knot) * o.words AS middle, e.knot, x.last, b.rest,
         coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY e.place, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + e.size / 2.0::DOUBLE AS exact
  FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source JOIN o ON e.source IS NOT DISTINCT FROM o.source AND e.knot = o.knot LEFT JOIN x ON x.source IS NOT DISTINCT FROM e.source
), c AS (SELECT *, whole + CASE WHEN last IS NULL OR knot > last THEN 0 WHEN knot < last THEN 1 WHEN exact < rest THEN 1 ELSE 0 END AS copies,
                least(1.0::DOUBLE, coalesce(middle / nullif(target, 0), 0)) AS y FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
       round(CASE WHEN copies = 0 THEN NULL WHEN g = 0 THEN y ELSE (sqrt((1 - g) * (1 - g) + 4 * g * y) - (1 - g)) / (2 * g) END, 9) AS position
FROM c
"""
