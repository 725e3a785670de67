"""More queries: uncertainty, conformal sets, neighbours, clusters, splits, structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, domain, neighbours, preparation, similarity, splits, structures, uncertainty
from .registry import _LONG, _SIM, SCORED, TRAIN, fingerprints, query, read, rounded, scored, vectors


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a predicted charge, the true one and a spread."""
    y = F.col("l_extendedprice") / 1000
    return read(spark, sf_dir, "lineitem").select(y.alias("t"), (y * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("e"), (F.col("l_quantity") / 10).alias("s"))


SPREADS = "x AS (SELECT l_extendedprice / 1000 AS t, l_extendedprice / 1000 * (1 - l_discount) * (1 + l_tax) AS e, l_quantity / 10 AS s FROM lineitem)"
_LEVELS = ", ".join(f"({v!r}::DOUBLE, {uncertainty.quantile_of(v)!r}::DOUBLE)" for v in uncertainty.levels())
_CURVE = f"{SPREADS}, v(nominal, z) AS (VALUES {_LEVELS}), c AS (SELECT nominal, avg((abs(t - e) <= s * z)::INTEGER) AS observed FROM x, v GROUP BY nominal)"


@query(f"WITH {_CURVE} SELECT round(nominal, 6) AS nominal, round(observed, 6) AS observed FROM c")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uncertainty.coverage_curve(spreads(spark, sf_dir), "t", "e", "s"))


@query(f"WITH {_CURVE}, g AS (SELECT nominal AS n, abs(observed - nominal) AS g, lag(nominal) OVER w AS n0, lag(abs(observed - nominal)) OVER w AS g0 FROM c WINDOW w AS (ORDER BY nominal)) SELECT round(sum((g + g0) / 2 * (n - n0)), 6) AS area FROM g")
def miscalibration_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uncertainty.miscalibration_area(spreads(spark, sf_dir), "t", "e", "s"))


@query(f"""WITH {SPREADS}, d AS (SELECT s, abs(t - e) AS a FROM x), r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS u, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS v FROM d)
SELECT round(corr(u, v), 6) AS spearman FROM r""")
def spread_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uncertainty.spread_correlation(spreads(spark, sf_dir), "t", "e", "s"))


_Z68, _Z95 = uncertainty.quantile_of(0.68), uncertainty.quantile_of(0.95)


@query(f"WITH {SPREADS} SELECT count(*) AS n, round(avg((abs(t - e) <= s * {_Z68!r})::INTEGER), 6) AS coverage_68, round(avg((abs(t - e) <= s * {_Z95!r})::INTEGER), 6) AS coverage_95, round(avg(s), 6) AS mean_sigma, round(sqrt(avg((t - e) * (t - e))), 6) AS rmse FROM x")
def spread_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uncertainty.spread_report(spreads(spark, sf_dir), "t", "e", "s"))


def class_scores(df: DataFrame) -> DataFrame:
    """id, y, label, s: how strange each class would be for a document scored by length."""
    rows = df.select("id", "y", F.explode(F.array(F.struct(F.lit(0).alias("label"), F.col("score").alias("s")), F.struct(F.lit(1).alias("label"), (1 - F.col("score")).alias("s")))).alias("r"))
    return rows.select("id", "y", "r.label", "r.s")


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = class_scores(scored(spark, sf_dir))
    return uncertainty.conformal_p_values(c.where("id % 2 = 0 AND label = y"), c.where("id % 2 = 1"), "s")


_PV = f"""{SCORED}, c AS (SELECT id, y, 0 AS label, score AS s FROM s UNION ALL SELECT id, y, 1, 1 - score FROM s), k AS (SELECT s FROM c WHERE id % 2 = 0 AND label = y),
p AS (SELECT id, y, label, ((SELECT count(*) FROM k WHERE k.s >= c.s) + 1) / ((SELECT count(*) FROM k) + 1) AS p FROM c WHERE id % 2 = 1)"""


@query(f"WITH {_PV} SELECT id, label, round(p, 6) AS p FROM p")
def conformal_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(p_values(spark, sf_dir).select("id", "label", "p"))


@query(f"""WITH {_PV}, g AS (SELECT id, count(*) FILTER (p > 0.1) AS n, count(*) FILTER (p > 0.1 AND label = y) AS hit FROM p GROUP BY id)
SELECT round(avg(hit), 6) AS coverage, round(avg(n), 6) AS mean_size, round(avg((n = 1)::INTEGER), 6) AS singletons, round(avg((n = 0)::INTEGER), 6) AS empty FROM g""")
def conformal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = p_values(spark, sf_dir)
    sets = uncertainty.conformal_sets(p, "id", "label").join(p.select("id", "y").distinct(), "id")
    return rounded(uncertainty.conformal_evaluation(sets, "y"))


@query("""WITH x AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice / 1000 AS t, l_extendedprice / 1000 * (1 - l_discount) * (1 + l_tax) AS e FROM lineitem),
r AS (SELECT row_number() OVER w AS k, sum((t - e) * (t - e)) OVER w AS sq, sum(abs(t - e)) OVER w AS ab, count(*) OVER () AS n FROM x WINDOW w AS (ORDER BY q, id, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)),
g AS (SELECT DISTINCT 1 + (i * (n - 1)) // (least(20, n) - 1) AS k FROM (SELECT count(*) AS n FROM lineitem), range(20) t(i) WHERE i < least(20, n))
SELECT round(k / n, 6) AS coverage, k AS n_samples, round(sqrt(sq / k), 6) AS rmse, round(ab / k, 6) AS mae FROM r JOIN g USING (k)""")
def accuracy_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_extendedprice") / 1000
    x = read(spark, sf_dir, "lineitem").select(F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("a"), "l_partkey", "l_suppkey").alias("id"), F.col("l_quantity").alias("q"), y.alias("t"), (y * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("e"))
    return rounded(domain.accuracy_by_coverage(x, "q", "id", "t", "e"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = fingerprints(spark, sf_dir)
    return f, f.where(f"NOT ({TRAIN})").select("id", "bits"), f.where(TRAIN).select("id", "bits")


_NEAR = f"{_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) AS rank FROM s WHERE a_label >= 7 AND b_label < 7), k AS (SELECT * FROM r WHERE rank <= 5)"


@query(f"""WITH {_NEAR}, v AS (SELECT a_id AS query_id, b_label AS label, round(sum(similarity), 9) AS w FROM k GROUP BY a_id, b_label)
SELECT query_id, label, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS share FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) = 1""")
def knn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, q, refs = _halves(spark, sf_dir)
    return rounded(neighbours.vote(similarity.nearest(q, refs, 5), f.select("id", "label")))


@query(f"WITH {_NEAR} SELECT a_id AS query_id, round(sum(similarity * b_label) / sum(similarity), 6) AS value FROM k GROUP BY a_id")
def knn_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, q, refs = _halves(spark, sf_dir)
    return rounded(neighbours.mean(similarity.nearest(q, refs, 5), f.select("id", F.col("label").cast("double").alias("value"))))


@query(f"WITH {_NEAR}, m AS (SELECT a_id AS id, sum(similarity) / 5 AS m FROM k GROUP BY a_id) SELECT id, round(coalesce(m, 0), 6) AS similarity, coalesce(m, 0) >= 0.3 AS inside FROM fp LEFT JOIN m USING (id) WHERE label >= 7")
def similarity_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, refs = _halves(spark, sf_dir)
    return rounded(neighbours.similarity_domain(q, refs, 5))


@query(f"WITH {_SIM}, m AS (SELECT a_id AS id, max(similarity) AS m FROM s GROUP BY a_id) SELECT id, round(1 - coalesce(m, 0), 6) AS novelty FROM fp LEFT JOIN m USING (id)")
def library_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark, sf_dir).select("id", "bits")
    return rounded(neighbours.novelty(f, f))


@query(f"WITH {_SIM}, m AS (SELECT a_id AS id, max(similarity) AS m FROM s GROUP BY a_id) SELECT round(avg((coalesce(m, 0) >= 0.5)::INTEGER), 6) AS share FROM fp LEFT JOIN m USING (id)")
def library_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.redundancy(fingerprints(spark, sf_dir).select("id", "bits"), 0.5))


@query(f"""WITH {_SIM}, m AS (SELECT a_id AS id, max(similarity) AS m FROM s WHERE (a_label >= 7) <> (b_label >= 7) GROUP BY a_id), u AS (SELECT label >= 7 AS a, coalesce(m, 0) AS m FROM fp LEFT JOIN m USING (id))
SELECT round(avg((m >= 0.3)::INTEGER) FILTER (a), 6) AS a_covered, round(avg((m >= 0.3)::INTEGER) FILTER (NOT a), 6) AS b_covered, round(avg(m) FILTER (a), 6) AS a_mean, round(avg(m) FILTER (NOT a), 6) AS b_mean FROM u""")
def library_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, refs = _halves(spark, sf_dir)
    return rounded(neighbours.coverage(q, refs, 0.3))


_GRAPH = f"{_SIM}, e AS (SELECT a_id AS id, b_id AS other, similarity FROM s WHERE similarity >= 0.3), n AS (SELECT id, (SELECT count(*) FROM e WHERE e.id = fp.id) AS d FROM fp)"
_GREEDY = """{graph}, o AS (SELECT id, row_number() OVER (ORDER BY {order}) AS place FROM n), a AS (SELECT o.id, place, (SELECT coalesce(list(other), []) FROM e WHERE e.id = o.id) AS others FROM o),
w AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS heads UNION ALL SELECT a.place, CASE WHEN list_has_any(a.others, w.heads) THEN w.heads ELSE list_append(w.heads, a.id) END FROM w JOIN a ON a.place = w.place + 1),
h AS (SELECT unnest(heads) AS head FROM (SELECT heads FROM w ORDER BY place DESC LIMIT 1))
SELECT n.id, CASE WHEN n.id IN (FROM h) THEN n.id ELSE (SELECT arg_min(other, {nearest}) FROM e JOIN h ON other = head JOIN o ON o.id = head WHERE e.id = n.id) END AS centre FROM n"""


@query("WITH RECURSIVE " + _GREEDY.format(graph=_GRAPH, order="d DESC, id", nearest="place"))
def butina_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark, sf_dir)
    return clustering.butina(f, similarity.similar_pairs(f, 0.3))


@query("WITH RECURSIVE " + _GREEDY.format(graph=_GRAPH, order="id", nearest="(-similarity, place)"))
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark, sf_dir)
    return clustering.leaders(f, similarity.similar_pairs(f, 0.3))


@query(f"""WITH {_LONG}, g AS (SELECT a.dim AS i, b.dim AS j, abs(corr(a.x, b.x)) AS r FROM l a JOIN l b USING (id) GROUP BY a.dim, b.dim), b AS (SELECT j AS dim, list(i) FILTER (r > 0.1) AS others FROM g WHERE i < j GROUP BY j UNION ALL SELECT 0, []),
t AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT -1::BIGINT AS dim, []::BIGINT[] AS kept UNION ALL SELECT b.dim, CASE WHEN list_has_any(coalesce(b.others, []), f.kept) THEN f.kept ELSE list_append(f.kept, b.dim) END FROM f JOIN b ON b.dim = f.dim + 1) SELECT kept FROM f ORDER BY dim DESC LIMIT 1))
SELECT unnest(kept)::INTEGER AS dim FROM t""")
def correlation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.correlation_filter(vectors(spark, sf_dir), "id", "v", 0.1)


@query(f"""WITH {_LONG}, c AS (SELECT dim, avg(x) AS m FROM l GROUP BY dim), d AS (SELECT id, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM l JOIN c USING (dim) GROUP BY id), n AS (SELECT greatest(1, round_even(count(*) * 0.2::DOUBLE, 0)) AS k FROM d)
SELECT id, row_number() OVER (ORDER BY d, id) <= k AS is_test FROM d, n""")
def split_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return splits.perimeter_split(domain.centroid_distance(v, v, "id", "v"), "distance", "id").select("id", "is_test")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (ORDER BY md5('0:' || event_id), event_id) <= 100")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sampled(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 100)


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id), event_id) AS r FROM events WHERE event_type IS NOT NULL), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM r GROUP BY event_type))
SELECT event_id, event_type FROM r, n WHERE r <= n""")
def balanced_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balanced(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


#: Structures that break each rule, and some that break none.
SMILES = ["CC(=O)Oc1ccccc1C(=O)[O-].[Na+]", "CCO", "OCC", "[Na+].[Cl-]", "c1ccccc1", "O", "CCN", "CCO.CCN", "[Fe]CCCCC", "[13CH3]C", "CC(=O)[O-]", "C" * 160, "!!bad!!", "CC(", "", "BrCCCl", "C[N+](C)(C)CC([O-])=O", "c1ccc2[nH]cnc2c1"]
_LISTED = ", ".join(f"'{s}'" for s in SMILES)
_ATOMS = f"m AS (SELECT c_custkey AS id, [{_LISTED}, NULL][c_custkey % {len(SMILES) + 1} + 1] AS smiles FROM customer), a AS (SELECT *, [CASE WHEN x[1] = '[' THEN upper(regexp_extract(x, '{structures.SYMBOL}', 1)[1]) || regexp_extract(x, '{structures.SYMBOL}', 1)[2:] ELSE upper(x[1]) || x[2:] END for x in regexp_extract_all(smiles, '{structures.ATOM}')] AS es FROM m)"


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with one of the structures, or none."""
    listed = F.array(*[F.lit(s) for s in SMILES], F.lit(None))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(listed, (F.col("c_custkey") % (len(SMILES) + 1)).cast("int")).alias("smiles"))


@query(f"""WITH {_ATOMS}, b AS (SELECT *, len([e for e in es if e <> 'H']) AS n, smiles IS NULL OR len(es) = 0 OR len(replace(smiles, '(', '')) <> len(replace(smiles, ')', '')) OR regexp_matches(smiles, '[!?$&{{}}~]') AS bad,
  coalesce(list_sum([(CASE WHEN regexp_matches(c, '[0-9]') THEN regexp_extract(c, '([0-9]+)', 1)::INTEGER ELSE len(c) END) * (CASE WHEN c[1] = '+' THEN 1 ELSE -1 END) for c in regexp_extract_all(smiles, '([+-]+[0-9]*)(?::[0-9]+)?\\]', 1)]), 0) AS q FROM a),
u AS (SELECT id, unnest(CASE WHEN bad THEN ['unparseable'] ELSE list_filter([CASE WHEN contains(smiles, '.') THEN 'mixture' END, CASE WHEN NOT list_has_all(['H', 'B', 'C', 'N', 'O', 'F', 'Si', 'P', 'S', 'Cl', 'Se', 'Br', 'I'], es) THEN 'inorganic' END,
  CASE WHEN NOT list_contains(es, 'C') THEN 'no_carbon' END, CASE WHEN regexp_matches(smiles, '\\[[0-9]') THEN 'isotope' END, CASE WHEN n < 3 THEN 'too_small' END, CASE WHEN n > 150 THEN 'too_large' END, CASE WHEN q <> 0 THEN 'charged' END], lambda x: x IS NOT NULL) END) AS code FROM b)
SELECT id, code, code <> 'charged' AS fatal FROM u""")
def structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.issues(molecules(spark, sf_dir), "id", "smiles")


@query(f"""WITH {_ATOMS}, p AS (SELECT id, unnest(string_split(smiles, '.')) AS p FROM m WHERE smiles IS NOT NULL), h AS (SELECT id, p, len([x for x in regexp_extract_all(p, '{structures.ATOM}') if NOT regexp_matches(x, '^\\[[0-9]*H[^a-z]')]) AS n FROM p)
SELECT m.id, (SELECT arg_max(p, (n, len(p), p)) FROM h WHERE h.id = m.id) AS fragment FROM m""")
def largest_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules(spark, sf_dir).select("id", structures.largest_fragment(F.col("smiles")).alias("fragment"))
