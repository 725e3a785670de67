"""What each filter of a chain removes, in every order of the chain.

1. Every document gets a mask: which of the five filters it fails, each filter judged on its own.  A document fails E if a smaller id has its text; the
   smallest id of a text is found by its digest, folded on the map side, and joined back by id and digest, so that copies of one text, however
   many, are dealt over all tasks.
2. Documents are counted per part, mask and label: a cell.  There are at most 32 masks and 4 kinds of labels a part, whatever the number of documents.
3. Cells are unpivoted against the steps of all orders: a row per cell, order and step.  The running bit-or of the filters before a step, along the
   order, tells which failures came earlier; sums over conditions of it are the metrics, windows over a filter's rows the totals over orders.

Defined cases: null text is empty (and equal to other empty texts), a null part is the empty string. Rows that repeat an id and text fail E only if a
smaller id has the text. A row without an id never fails E and makes no other row fail it. Labels of an id that repeats count if any says so; null ones
don't. An empty table gives no rows. Other columns are ignored. Texts are never cut. Texts are told apart by their SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table, written

FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """The conditions that look at a text alone: few words, repeated words, capitals, marks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask (bit j: fails the j-th filter) of every document."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << FILTERS.index(name)).otherwise(0) for name, c in failures(F.col("text")).items()), F.lit(0))
    d = written(d.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")), "masks")
    first = d.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("f_id")).withColumnRenamed("digest", "f_digest")
    j = d.join(first, (F.col("id") == F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left")
    again = F.col("id").isNotNull() & F.col("f_id").isNull()
    return j.select("id", "part", (F.col("mask") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, docs, good, toxic: documents, and those that are labelled so; a few rows a part."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")))
    j = masked.join(said, F.col("id") == F.col("l_id"), "left")
    return j.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """part, filter_order, step with kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: every part, order and step."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = F.array(*[F.lit(i) for i in range(1, len(FILTERS) + 1)])
    long = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    name = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.ascii(name) - F.lit(ord(FILTERS[0])))
    long = long.withColumn("filter", name).withColumn("failed", F.col("mask").bitwiseAND(bit))
    along = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(along), F.lit(0)))
    fails, gone = F.col("failed") > 0, F.col("earlier") > 0
    total = lambda of, when: F.sum(F.when(when, F.col(of)).otherwise(0))
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("docs", ~fails & ~gone).alias("kept"), total("docs", fails & ~gone).alias("removed"), total("docs", fails & gone).alias("redundant"),
        total("docs", fails & (F.col("mask") == F.col("failed"))).alias("unique_fails"), total("good", fails & ~gone).alias("good_lost"), total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN g USING (doc_id)
), o AS (SELECT '' AS p UNION ALL SELECT p || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(p, c) AND length(p) < 5),
s AS (SELECT p AS filter_order, step, substr(p, step, 1) AS filter FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) WHERE length(p) = 5),
c AS (SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (
  SELECT part, filter_order, step, filter, docs, good, toxic, fails[ascii(filter) - 64] AS bad, len(list_filter(fails, lambda v: v)) = 1 AS alone,
         len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64])) > 0 AS gone
  FROM c, s
), r AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT bad AND NOT gone THEN docs ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN bad AND gone THEN docs ELSE 0 END) AS redundant, sum(CASE WHEN bad AND alone THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
