"""Queries on distances to a training table and on models beyond linear ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distances, diversity, gaussian, hierarchy, isolation, models, selection, similarity, spaces
from .registry import _SIM, fingerprints, query, read, rounded

_V = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len([z for z in embedding if z IS NULL OR NOT isfinite(z::DOUBLE)]) = 0), t AS (SELECT * FROM v WHERE label < 7)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").cast("double").alias("y"))


@query(f"""WITH {_V}, d AS (SELECT v.id, list_distance(v.x, t.x) AS d FROM v, t), r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d), m AS (SELECT id, avg(d) AS distance FROM r WHERE r <= 5 GROUP BY id),
o AS (SELECT a.id, list_distance(a.x, b.x) AS d FROM t a JOIN t b ON a.id <> b.id), s AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM o), n AS (SELECT avg(d) AS d FROM s WHERE r <= 5 GROUP BY id)
SELECT id, round(distance, 6) AS distance, distance <= (SELECT quantile_cont(d, 0.95) FROM n) AS inside FROM m""")
def knn_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir)
    return rounded(distances.knn_domain(d.where("y < 7"), d, "id", "x"))


@query(f"""WITH {_V}, a AS (SELECT id, x, label < 7 AS own FROM v UNION ALL SELECT id, [z * 30 for z in x], false FROM v WHERE label = 0), n AS (SELECT *, row_number() OVER () AS r FROM a),
p AS (SELECT r, n.id, own, list_distance(n.x, t.x) ** 2 AS d FROM n, t), m AS (SELECT r, min(d) AS m FROM p GROUP BY r),
d AS (SELECT p.r, id, own, -m / 0.5 + ln(sum(exp((m - d) / 0.5)) / (SELECT count(*) FROM t)) AS log_density FROM p JOIN m USING (r) GROUP BY p.r, id, own, m)
SELECT id, round(log_density, 6) AS log_density, log_density >= (SELECT quantile_cont(log_density, 0.05) FROM d WHERE own) - 1e-9 AS inside FROM d""")
def density_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows, and those of one label again under their ids and far away: these have a density too, and lie outside."""
    d = rows(spark, sf_dir).withColumn("x", F.col("x").cast("array<double>"))
    train = d.where("y < 7")
    every = d.unionByName(d.where("y = 0").withColumn("x", F.transform("x", lambda z: z * 30)))
    least = distances.quantiles(distances.density(train, train, "id", "x", 0.5), "log_density", {"least": 0.05})
    return rounded(distances.density(every, train, "id", "x", 0.5).join(F.broadcast(least)).select("id", "log_density", (F.col("log_density") >= F.col("least") - 1e-9).alias("inside")))


@query()
def component_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir)
    return distances.component_domain(d.where("y < 7"), d, "id", "x")


@query(f"""WITH RECURSIVE {_V}, c AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS m FROM v, range(1, 65) r(i) GROUP BY i)),
p AS (SELECT 1 AS pick, [(SELECT id FROM v, c ORDER BY round(list_distance(x, m), 12), id LIMIT 1)] AS ids
  UNION ALL SELECT pick + 1, list_append(ids, (SELECT id FROM (SELECT a.id, min(list_distance(a.x, b.x)) AS d FROM v a JOIN v b ON list_contains(p.ids, b.id) WHERE NOT list_contains(p.ids, a.id) GROUP BY a.id) ORDER BY round(d, 12) DESC, id LIMIT 1)) FROM p WHERE pick < 6)
SELECT ids[i] AS id, i::INTEGER AS pick FROM (SELECT ids FROM p ORDER BY pick DESC LIMIT 1), range(1, 7) r(i)""")
def maxmin_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.picked(rows(spark, sf_dir), "id", "x", 6)


@query(f"""WITH RECURSIVE {_V}, f AS (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON a.id < b.id ORDER BY round(list_distance(a.x, b.x), 12) DESC, a.id, b.id LIMIT 1),
p AS (SELECT 2 AS pick, [i, j] AS ids FROM f
  UNION ALL SELECT pick + 1, list_append(ids, (SELECT id FROM (SELECT a.id, min(list_distance(a.x, b.x)) AS d FROM v a JOIN v b ON list_contains(p.ids, b.id) WHERE NOT list_contains(p.ids, a.id) GROUP BY a.id) ORDER BY round(d, 12) DESC, id LIMIT 1)) FROM p WHERE pick < 20)
SELECT ids[i] AS id, i::INTEGER AS pick FROM (SELECT ids FROM p ORDER BY pick DESC LIMIT 1), range(1, 21) r(i)""")
def kennard_stone_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rows farthest from each other and 18 more."""
    return distances.picked(rows(spark, sf_dir), "id", "x", 20, "kennard_stone")


@query()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of the labels, learned from the even ids and told for the odd ones, with the trees' spread."""
    d = rows(spark, sf_dir).where("y IS NOT NULL")
    model = models.fitted(d.where("id % 2 = 0"), "x", "y", "forest", numTrees=20)
    return model.predict(d.where("id % 2 = 1"), "id").join(model.spread(d.where("id % 2 = 1"), "id"), "id")


@query()
def partial_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir).where("y IS NOT NULL")
    return rounded(models.PartialLeastSquares(d, "x", "y", 3).predict(d, "id"))


@query(f"""WITH {_V}, d AS (SELECT a.id, b.id AS other, round(list_distance(a.x, b.x), 12) AS d, list_distance(a.x[1:16], b.x[1:16]) AS e FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT rank() OVER (PARTITION BY id ORDER BY d) AS r, row_number() OVER (PARTITION BY id ORDER BY e, other) AS s FROM d), n AS (SELECT count(*) AS n FROM v)
SELECT any_value(n) AS n, round(1 - 2.0 / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(greatest(r - 5, 0)), 6) AS trustworthiness FROM r, n WHERE s <= 5""")
def projection_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir).withColumn("e", F.slice("x", 1, 16))
    return rounded(spaces.trustworthiness(d, "id", "x", "e", 5))


@query()
def isolation_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir)
    return rounded(isolation.isolation_domain(d.where("y < 7"), d, "id", "x"))


@query()
def gaussian_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the odd rows from those of the even ones, with their spread."""
    d = rows(spark, sf_dir).where("y IS NOT NULL")
    model = gaussian.process(d.where("id % 2 = 0"), "id", "x", "y", gaussian.gaussian(1.0), 1.0, 256)
    return rounded(model.predict(d.where("id % 2 = 1"), "id", "x"))


@query()
def quantile_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices between their regression quantiles by quantity, discount and tax."""
    d = read(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.array("l_quantity", "l_discount", "l_tax").alias("x"), F.col("l_extendedprice").alias("y"))
    out = gaussian.quantile_interval(d, d, "id", "x", "y", 0.1, 0.9)
    return rounded(out.select("id.l_orderkey", "id.l_linenumber", "lower", "upper", "width"))


def _distances(spark: SparkSession, sf_dir: str, least: float) -> tuple[DataFrame, DataFrame]:
    f = fingerprints(spark, sf_dir)
    return f.select("id"), similarity.similar_pairs(f, least).withColumn("distance", 1 - F.col("similarity"))


@query(f"WITH RECURSIVE {_SIM}, e AS (SELECT a_id, b_id FROM s WHERE similarity > 0.5), r AS (SELECT id, id AS c FROM fp UNION SELECT e.b_id, r.c FROM r JOIN e ON e.a_id = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id")
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose nearest rows are under half a Jaccard distance apart."""
    return hierarchy.clusters(*_distances(spark, sf_dir, 0.5), "single", threshold=0.5 - 1e-9)


@query()
def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose farthest rows are under half a Jaccard distance apart."""
    return hierarchy.clusters(*_distances(spark, sf_dir, 0.5), "complete", threshold=0.5 - 1e-9)


@query()
def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges below a mean Jaccard distance of 0.7: the pairs of rows below it, and the rows themselves for what their clusters have besides."""
    rows, like = similarity.rows_and_similarity(fingerprints(spark, sf_dir))
    # At the threshold itself a pair is one too many, which the merges leave out.
    return rounded(hierarchy.merges(*_distances(spark, sf_dir, 0.3 - 1e-9), "average", threshold=0.7, between=(rows, lambda x, y: 1 - like(x, y))))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with numbers that their price depends on, and some that it doesn't."""
    p = read(spark, sf_dir, "part")
    x = F.array(F.col("p_partkey") % 1000, F.col("p_partkey") % 7, F.col("p_partkey") / 10 % 20001, F.col("p_size"))
    return p.select(F.col("p_partkey").alias("id"), x.cast("array<double>").alias("x"), F.col("p_retailprice").alias("y"))


@query()
def recursive_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(selection.eliminated(_priced(spark, sf_dir), "x", "y", 1, 1, "tree"), "component int, rank int")


@query()
def shadow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(selection.shadowed(_priced(spark, sf_dir), "id", "x", "y", 12, numTrees=8), "component int, hits int, decision string")


@query(f"""WITH {_SIM}, p AS (SELECT a_label AS label, 1 - similarity AS d FROM s WHERE a_id < b_id AND a_label = b_label), n AS (SELECT label, count(*) AS n FROM fp GROUP BY label),
b AS (SELECT label, bit, count(*) / any_value(n) AS q FROM (SELECT label, unnest(bits) AS bit FROM fp) JOIN n USING (label) GROUP BY label, bit),
e AS (SELECT label, sum(-q * ln(q) - CASE WHEN q < 1 THEN (1 - q) * ln(1 - q) ELSE 0 END) / 64 AS bit_entropy FROM b GROUP BY label)
SELECT label, any_value(n) AS n, round(avg(d), 6) AS mean_distance, round(median(d), 6) AS median_distance, round(min(d), 6) AS min_distance, round(coalesce(any_value(bit_entropy), 0), 6) AS bit_entropy FROM n LEFT JOIN p USING (label) LEFT JOIN e USING (label) GROUP BY label""")
def library_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each label as a library."""
    return rounded(diversity.compared(fingerprints(spark, sf_dir), 64, "label"))
