"""How diverse libraries are: pairwise distances, bits, scaffolds; one row a library.

Pairs that share a bit are counted by their sizes and common bits as the sets meet: all other pairs have the distance 1 (0, if both sets are empty), so their number follows from the
sizes.  Mean, median and least distance come from the table of counts, which has as many rows as there are different similarities, not pairs.

Rows without an id or bits take no part; ids must be unique; a null library is one of its own. A library of one row has null distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similarity


def _entropy(p: Column) -> Column:
    """-p ln p, 0 at 0."""
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def compared(fp: DataFrame, size: int, library: str) -> DataFrame:
    """library, n, mean_distance, median_distance, min_distance (Jaccard, of all pairs of a library), bit_entropy (mean over `size` bits, natural logarithm). fp: id, bits, library."""
    d = fp.where("id IS NOT NULL AND bits IS NOT NULL").select("id", F.size("bits").alias("n"), "bits", F.col(library).alias("lib"))
    rows = d.groupBy("lib").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") == 0).alias("bare"))
    bits = d.select("lib", F.explode("bits").alias("bit"))
    both = similarity.shared_bits(d.select("id", "bits", "lib"), "lib")
    shared = both.groupBy(F.col("a_lib").alias("lib"), "a_n", "b_n", "c").agg(F.count(F.lit(1)).alias("pairs"))
    shared = shared.groupBy("lib", (1 - F.col("c") / (F.col("a_n") + F.col("b_n") - F.col("c"))).alias("distance")).agg(F.sum("pairs").alias("pairs"))
    # The other pairs of a library: two empty sets are equal, the rest share nothing.
    half = lambda n: F.col(n) * (F.col(n) - 1) / 2
    known = shared.groupBy(F.col("lib").alias("k_lib")).agg(F.sum("pairs").alias("known"))
    left = rows.join(known, F.col("lib").eqNullSafe(F.col("k_lib")), "left").withColumn("same", half("bare").cast("long")).withColumn("far", half("rows").cast("long") - F.col("same") - F.coalesce("known", F.lit(0)))
    ends = left.select("lib", F.explode(F.array(F.struct(F.lit(0.0).alias("distance"), F.col("same").alias("pairs")), F.struct(F.lit(1.0).alias("distance"), F.col("far").alias("pairs")))).alias("e")).select("lib", "e.*")
    table = shared.unionByName(ends).where("pairs > 0").groupBy("lib", "distance").agg(F.sum("pairs").alias("pairs"))
    upto = Window.partitionBy("lib").orderBy("distance")
    every = Window.partitionBy("lib")
    t = table.withColumn("upto", F.sum("pairs").over(upto)).withColumn("all", F.sum("pairs").over(every))
    low, high = (F.min(F.when(F.col("upto") >= F.floor((F.col("all") + add) / 2), F.col("distance"))) for add in (1, 2))
    figures = t.groupBy(F.col("lib").alias("t_lib")).agg((F.sum(F.col("distance") * F.col("pairs")) / F.max("all")).alias("mean_distance"), ((low + high) / 2).alias("median_distance"), F.min("distance").alias("min_distance"))
    share = bits.groupBy(F.col("lib").alias("b_lib"), "bit").agg(F.count(F.lit(1)).alias("on")).join(rows.select(F.col("lib").alias("r_lib"), "rows"), F.col("b_lib").eqNullSafe(F.col("r_lib")))
    p = F.col("on") / F.col("rows")
    entropy = share.groupBy("b_lib").agg((F.sum(_entropy(p) + _entropy(1 - p)) / size).alias("bit_entropy"))
    out = rows.join(figures, F.col("lib").eqNullSafe(F.col("t_lib")), "left").join(entropy, F.col("lib").eqNullSafe(F.col("b_lib")), "left")
    return out.select(F.col("lib").alias(library), F.col("rows").alias("n"), "mean_distance", "median_distance", "min_distance", F.coalesce("bit_entropy", F.lit(0.0)).alias("bit_entropy"))


def scaffold_figures(df: DataFrame, scaffold: str, library: str) -> DataFrame:
    """library, n, n_scaffolds, scaffold_diversity (a molecule), acyclic_fraction, scaffold_entropy (natural logarithm, over rows with rings); '' is no ring, null no molecule."""
    d = df.where(F.col(scaffold).isNotNull()).groupBy(F.col(library).alias("lib"), F.col(scaffold).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    ring = F.col("s") != ""
    g = d.groupBy("lib").agg(F.sum("c").alias("n"), F.count_if(ring).alias("n_scaffolds"), F.sum(F.when(~ring, F.col("c")).otherwise(0)).alias("open"), F.sum(F.when(ring, F.col("c") * F.log("c")).otherwise(0.0)).alias("clogc"))
    cyclic = F.col("n") - F.col("open")
    # -sum p ln p = ln m - sum c ln c / m.
    entropy = F.when(cyclic > 0, F.log(cyclic) - F.col("clogc") / cyclic).otherwise(0.0)
    return g.select(F.col("lib").alias(library), "n", "n_scaffolds", (F.col("n_scaffolds") / F.col("n")).alias("scaffold_diversity"), (F.col("open") / F.col("n")).alias("acyclic_fraction"), entropy.alias("scaffold_entropy"))


def is_binary(df: DataFrame, vec: str) -> DataFrame:
    """One row: whether all components of all vectors are 0 or 1; null for no vectors."""
    return df.where(F.col(vec).isNotNull()).agg(F.bool_and(F.forall(vec, lambda v: F.coalesce((v == 0) | (v == 1), F.lit(False)))).alias("binary"))
