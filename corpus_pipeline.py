"""From raw documents to sampled piece ids, in five stages.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.  All stages but the last
return the columns of documents.  Empty tables pass through all stages as empty tables; how nulls, empty texts and repeated rows are
treated, the operators' modules say.  The third stage keeps a row of each group, also of groups without an id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiscope.llm import jaccard, langid, mix, pieces, quality
from actiscope.llm.base import fresh, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough."""
    return langid.accepted(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as labels of documents that are still there teach it."""
    return quality.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows are told apart by id and text; a group without an id keeps a row too. Rows without words are in no group and all stay.
    """
    key, first_key, first_rows, first_n = fresh(docs, "dedup_key", "first_key", "first_rows", "first_n")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    groups = jaccard.jaccard_join(keyed, id_col=key, words=5, num=80, den=100)
    first = groups.where((F.col("n_shingles") == 0) | (F.col(key) == F.col("component_id"))).groupBy(F.col(key).alias(first_key))
    first = written(first.agg(F.count(F.lit(1)).alias(first_rows), F.max("n_shingles").alias(first_n)), "first")
    out = keyed.join(first, F.col(key) == F.col(first_key))
    if first.where((F.col(first_n) > 0) & (F.col(first_rows) > 1)).limit(1).count():
        out = out.where(F.col(first_n) == 0).unionByName(out.where(F.col(first_n) > 0).dropDuplicates([key]))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    return mix.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("quality classifier", good), ("n-gram Jaccard join", deduplicated), ("mixing sources to target weights", mixed), ("SentencePiece encoding and decoding", encoded)]

#: Trained models, hashes of shingles and random segmentations can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
