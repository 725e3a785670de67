"""Every query by name, and its DuckDB equivalent. Results are rounded where their value depends on the order of a sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric
from ..operators import classification, curation, domain, preparation, regression, similarity, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and true charges of line items, in thousands."""
    y = F.col("l_extendedprice") / 1000
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", y.alias("y_true"), (y * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y_pred"))


PAIRS = "p AS (SELECT l_returnflag, l_shipdate, l_extendedprice / 1000 AS t, l_extendedprice / 1000 * (1 - l_discount) * (1 + l_tax) AS e FROM lineitem)"

_REPORT = f"""
WITH {PAIRS}, a AS (
  SELECT l_returnflag, count(*) AS n, sum((t - e) * (t - e)) AS press, avg(abs(t - e)) AS mae, quantile_cont(abs(t - e), 0.5) AS median_ae, avg(e - t) AS bias,
    avg(t) AS mt, avg(e) AS mp, var_pop(t) AS vt, var_pop(e) AS vp, covar_pop(t, e) AS cov, sum(t * e) AS tp, sum(t * t) AS tt, sum(e * e) AS pp FROM p GROUP BY l_returnflag),
b AS (SELECT *, tp / tt AS k, tp / pp AS k_prime, cov * cov / (vt * vp) AS corr2, 1 - press / (vt * n) AS r2 FROM a),
c AS (SELECT *, 1 - (pp - 2 * k * tp + k * k * tt) / (vp * n) AS r02, 1 - (tt - 2 * k_prime * tp + k_prime * k_prime * pp) / (vt * n) AS r02_prime FROM b),
d AS (SELECT *, corr2 * (1 - sqrt(abs(corr2 - r02))) AS r2m, corr2 * (1 - sqrt(abs(corr2 - r02_prime))) AS r2m_prime, corr2 > 0.6 AS gt_r2, abs(r02 - r02_prime) < 0.3 AS gt_delta,
  (k BETWEEN 0.85 AND 1.15 AND (corr2 - r02) / corr2 < 0.1) OR (k_prime BETWEEN 0.85 AND 1.15 AND (corr2 - r02_prime) / corr2 < 0.1) AS gt_slope FROM c)
SELECT l_returnflag, n, round(press / n, 6) AS mse, round(sqrt(press / n), 6) AS rmse, round(mae, 6) AS mae, round(median_ae, 6) AS median_ae, round(bias, 6) AS bias, round(press, 3) AS press,
  round(r2, 6) AS r2, round(2 * cov / (vt + vp + (mt - mp) * (mt - mp)), 6) AS ccc, round(k, 6) AS k, round(k_prime, 6) AS k_prime, round(r02, 6) AS r02, round(r02_prime, 6) AS r02_prime,
  round(r2m, 6) AS r2m, round(r2m_prime, 6) AS r2m_prime, round((r2m + r2m_prime) / 2, 6) AS average_r2m, round(abs(r2m - r2m_prime), 6) AS delta_r2m, gt_r2, gt_slope, gt_delta, gt_r2 AND gt_slope AND gt_delta AS passed FROM d
"""


@query(_REPORT)
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regression.report(pairs(spark, sf_dir), by=["l_returnflag"])
    return rounded(r.withColumn("press", F.round("press", 3)))


@query(f"""WITH {PAIRS}, s AS (SELECT *, l_shipdate >= TIMESTAMP '1997-01-01' AS test FROM p), m AS (SELECT avg(t) AS m, var_pop(t) AS v FROM s WHERE NOT test)
SELECT round(1 - sum((t - e) * (t - e)) / sum((t - m) * (t - m)), 6) AS q2_f1, round(1 - sum((t - e) * (t - e)) / (var_pop(t) * count(*)), 6) AS q2_f2, round(1 - avg((t - e) * (t - e)) / any_value(v), 6) AS q2_f3 FROM s, m WHERE test""")
def q2_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, late = pairs(spark, sf_dir), F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")
    return rounded(regression.external(p.where(late), p.where(~late)))


@query(f"WITH {PAIRS}, a AS (SELECT count(*) AS n, sum((t - e) * (t - e)) AS s, var_pop(t) AS v FROM p) SELECT round(sqrt(s / (n - 3)), 6) AS see, round(1 - s / (v * n) * (n - 1) / (n - 3), 6) AS adjusted_r2 FROM a")
def error_of_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression.error_of_estimate(pairs(spark, sf_dir), 2))


@query(f"""WITH {PAIRS}, r AS (SELECT e - t AS r FROM p), m AS (SELECT avg(r) AS m, var_pop(r) AS v FROM r)
SELECT round(any_value(m), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(avg(pow(r - m, 3)) / pow(any_value(v), 1.5), 6) AS skewness, round(avg(pow(r - m, 4)) / pow(any_value(v), 2) - 3, 6) AS kurtosis FROM r, m""")
def residual_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression.residual_moments(pairs(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents scored by their length."""
    s = F.least(F.lit(1.0), F.col("n_chars") / 5000)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", s.alias("score")).join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id")
    return d.withColumn("pred", (F.col("score") >= 0.3).cast("int"))


SCORED = "s AS (SELECT doc_id AS id, lang, quality AS y, least(1.0::DOUBLE, n_chars / 5000::DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"
_RATES = """round((tp + tn) / n, 6) AS accuracy, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, round(prec, 6) AS precision,
  round(coalesce(2 * prec * sens / nullif(prec + sens, 0), 0), 6) AS f1, round((sens + spec) / 2, 6) AS balanced_accuracy,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
  round(coalesce(((tp + tn) / n - pe) / nullif(1 - pe, 0), 1), 6) AS kappa"""
_DERIVED = """d AS (SELECT *, tp + fp + tn + fn AS n, coalesce(tp / nullif(tp + fn, 0), 0) AS sens, coalesce(tn / nullif(tn + fp, 0), 0) AS spec, coalesce(tp / nullif(tp + fp, 0), 0) AS prec,
  ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn)) AS pe FROM c)"""


@query(f"""WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (y = 1 AND score >= 0.3)::DOUBLE AS tp, count(*) FILTER (y = 0 AND score >= 0.3)::DOUBLE AS fp, count(*) FILTER (y = 0 AND score < 0.3)::DOUBLE AS tn, count(*) FILTER (y = 1 AND score < 0.3)::DOUBLE AS fn FROM s GROUP BY lang), {_DERIVED}
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, {_RATES} FROM d""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classification.confusion(scored(spark, sf_dir), by=["lang"]))


_SWEEP = f"""{SCORED}, g AS (SELECT score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY score),
c AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(neg) FROM g) - sum(neg) OVER w AS tn, (SELECT sum(pos) FROM g) - sum(pos) OVER w AS fn FROM g WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 'inf'::DOUBLE, 0, 0, sum(neg), sum(pos) FROM g), {_DERIVED}"""


@query(f"WITH {_SWEEP} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, {_RATES} FROM d")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = classification.sweep(scored(spark, sf_dir))
    return s.select("threshold", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes if c != "threshold"])


@query(f"""WITH {_SWEEP}, v AS (SELECT threshold, round(sens + spec - 1, 12) AS youden, round(coalesce(2 * prec * sens / nullif(prec + sens, 0), 0), 12) AS f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 12) AS mcc, round((sens + spec) / 2, 12) AS balanced_accuracy FROM d),
u AS (SELECT 'youden' AS criterion, youden AS value, threshold FROM v UNION ALL SELECT 'f1', f1, threshold FROM v UNION ALL SELECT 'mcc', mcc, threshold FROM v UNION ALL SELECT 'balanced_accuracy', balanced_accuracy, threshold FROM v)
SELECT criterion, round(value, 6) AS value, round(threshold, 6) AS threshold FROM u QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY value DESC, threshold) = 1""")
def optimal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classification.optimal(scored(spark, sf_dir)))


@query(f"""WITH {_SWEEP}, u AS (SELECT 'cost' AS criterion, 3 * fn + fp AS value, -(3 * fn + fp) AS goal, threshold, 3 * fn + fp AS reached FROM d UNION ALL SELECT 'precision', sens, sens, threshold, prec FROM d WHERE prec >= 0.25 UNION ALL SELECT 'recall', prec, prec, threshold, sens FROM d WHERE sens >= 0.8),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY round(goal, 12) DESC, threshold) = 1), k(criterion) AS (VALUES ('cost'), ('precision'), ('recall'))
SELECT criterion, round(value, 6) AS value, round(threshold, 6) AS threshold, round(coalesce(reached, CASE criterion WHEN 'precision' THEN (SELECT max(prec) FROM d) ELSE (SELECT max(sens) FROM d) END), 6) AS reached FROM k LEFT JOIN b USING (criterion)""")
def bounded_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missed positive costs three times a false one; recall at a precision of a quarter; precision at a recall of four fifths."""
    return rounded(classification.bounded_optima(scored(spark, sf_dir), cost_fn=3.0, min_precision=0.25, min_recall=0.8))


@query(f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s),
g AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS c FROM s GROUP BY score), w AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS m FROM g)
SELECT round((SELECT (sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) FROM r)::DOUBLE, 6) AS roc_auc, round((SELECT sum(pos * tp / m) / sum(pos) FROM w), 6) AS pr_auc""")
def ranking_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classification.areas(scored(spark, sf_dir)))


@query(f"""WITH {SCORED}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS r FROM s), n AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS a, greatest(1, round_even(count(*) * 0.1::DOUBLE, 0)) AS k FROM s),
t AS (SELECT n, a, a / n AS ra, k, count(*) FILTER (r <= k) AS hits, sum(exp(-20.0::DOUBLE * r / n)) AS s FROM r, n WHERE y = 1 GROUP BY n, a, k),
u AS (SELECT *, s / (ra * (1 - exp(-20.0::DOUBLE)) / (exp(20.0::DOUBLE / n) - 1)) AS rie FROM t)
SELECT round(hits / k / ra, 6) AS ef, round(rie, 6) AS rie, round(rie * ra * ((exp(10.0::DOUBLE) - exp(-10.0::DOUBLE)) / 2) / ((exp(10.0::DOUBLE) + exp(-10.0::DOUBLE)) / 2 - (exp(10.0::DOUBLE - 20 * ra) + exp(20 * ra - 10.0::DOUBLE)) / 2) + 1 / (1 - exp(20.0::DOUBLE * (1 - ra))), 6) AS bedroc FROM u""")
def enrichment_bedroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classification.enrichment(scored(spark, sf_dir), fraction=0.1))


_BINS = f"{SCORED}, b AS (SELECT least(floor(score * 10), 9)::INTEGER AS bin, avg(score) AS mean_prob, avg(y::DOUBLE) AS rate, count(*) AS count FROM s GROUP BY 1)"


@query(f"WITH {_BINS} SELECT bin, round(mean_prob, 6) AS mean_prob, round(rate, 6) AS rate, count FROM b")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classification.calibration(scored(spark, sf_dir)))


@query(f"""WITH {_BINS}, o AS (SELECT avg((score - y) * (score - y)) AS brier, avg(y::DOUBLE) AS base_rate, count(*) AS n FROM s)
SELECT round(sum(abs(rate - mean_prob) * count) / sum(count), 6) AS ece, round(max(abs(rate - mean_prob)), 6) AS mce, round(any_value(brier), 6) AS brier, round(any_value(base_rate), 6) AS base_rate, round(1 - any_value(brier) / (any_value(base_rate) * (1 - any_value(base_rate))), 6) AS skill, any_value(n) AS n FROM b, o""")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classification.calibration_report(scored(spark, sf_dir)))


_DUP = "g AS (SELECT user_id, min(event_id) AS first, count(*) AS size, CASE WHEN count(value) >= 2 THEN max(value) - min(value) ELSE 0 END AS spread FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 2)"


@query(f"WITH {_DUP} SELECT user_id, first, size, round(spread, 6) AS spread, spread <= 100 AS consistent FROM g")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curation.duplicate_groups(read(spark, sf_dir, "events"), "user_id", "event_id", "value", 100.0))


@query(f"""WITH {_DUP}, n AS (SELECT count(*) AS n FROM events) SELECT any_value(n) AS n_records, any_value(n) - sum(size - 1)::BIGINT AS n_unique, count(*) AS groups, sum(size - 1)::BIGINT AS redundant,
round(sum(size - 1) / any_value(n), 6) AS fraction, count(*) FILTER (spread > 100) AS inconsistent, round(max(spread), 6) AS max_spread FROM g, n""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curation.duplicate_report(read(spark, sf_dir, "events"), "user_id", "event_id", "value", 100.0))


for _name, _agg in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)"), ("geometric_mean", "exp(avg(ln(value)) FILTER (value > 0))"), ("min", "min(value)"), ("max", "max(value)")):

    def _merge(spark: SparkSession, sf_dir: str, method: str = _name) -> DataFrame:
        return rounded(curation.merge_replicates(read(spark, sf_dir, "events"), "user_id", "event_id", "value", method, 400.0))

    QUERIES[f"merge_replicates_{_name}"] = _merge
    SQL[f"merge_replicates_{_name}"] = f"""SELECT user_id, min(event_id) AS first, count(*) AS n, round({_agg}, 6) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING coalesce(max(value) - min(value), 0) <= 400
UNION ALL SELECT user_id, event_id, 1, round(value, 6) FROM events WHERE user_id IS NULL"""

_OUT = {
    "zscore": ("SELECT avg(value) AS m, stddev_samp(value) AS s FROM events", "abs(value - m) / s", 3.0),
    "modified_zscore": ("SELECT any_value(m) AS m, quantile_cont(abs(value - m), 0.5) AS s FROM events, (SELECT quantile_cont(value, 0.5) AS m FROM events)", "0.6745 * abs(value - m) / s", 3.5),
    "iqr": ("SELECT quantile_cont(value, 0.25) AS m, quantile_cont(value, 0.75) AS s FROM events", "greatest(m - value, value - s, 0) / (s - m)", 1.5),
}
for _name, (_stat, _score, _limit) in _OUT.items():

    def _outliers(spark: SparkSession, sf_dir: str, method: str = _name, limit: float = _limit) -> DataFrame:
        e = read(spark, sf_dir, "events").select("event_id", "value")
        return rounded(curation.outlier_scores(e, "value", method).withColumn("outlier", F.col("score") > limit).drop("value"))

    QUERIES[f"activity_outliers_{_name}"] = _outliers
    SQL[f"activity_outliers_{_name}"] = f"WITH m AS ({_stat}), x AS (SELECT event_id, {_score} AS score FROM events, m) SELECT event_id, round(score, 6) AS score, score > {_limit} AS outlier FROM x"


@query("""SELECT count(*) AS n, count(*) - count(value) AS missing, count(*) FILTER (value <= 0) AS non_positive, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS median,
round(log10(max(value) / min(value) FILTER (value > 0)), 6) AS log_range, min(value) >= -2 AND max(value) <= 15 AS looks_logarithmic FROM events""")
def activity_units_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curation.units_check(read(spark, sf_dir, "events"), "value"))


@query("""WITH g AS (SELECT text, quality, count(*) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), t AS (SELECT text, sum(c) AS size, max(c) AS top, count(*) AS labels FROM g GROUP BY 1)
SELECT sum(size)::BIGINT AS n, count(*) AS distinct_rows, count(*) FILTER (size > 1) AS collision_groups, count(*) FILTER (labels > 1) AS conflicting_groups, coalesce(sum(size) FILTER (labels > 1), 0)::BIGINT AS in_conflict,
sum(size - top)::BIGINT AS irreducible_errors, round(1 - sum(size - top) / sum(size), 6) AS max_accuracy FROM t""")
def representation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(curation.representation_conflicts(d, ["text"], "quality"))


@query("""SELECT event_id, round(CASE WHEN value > 0 THEN -log10(value * 1e-9) END, 6) AS p_activity, round(CASE WHEN value > 0 THEN log10(value * 1e-9) * 2.302585092994046 * 1.987204259e-3 * 298.15 END, 6) AS delta_g FROM events""")
def activity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = numeric.p_activity(F.col("value"), F.lit("nM"))
    return rounded(read(spark, sf_dir, "events").select("event_id", p.alias("p_activity"), numeric.delta_g(p).alias("delta_g")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


#: A third of the vectors, by class, is held apart from training.
TRAIN = "label < 7"
_LONG = "l AS (SELECT vec_id AS id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""WITH {_LONG}, b AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM l WHERE label < 7 GROUP BY dim)
SELECT id, count(*) FILTER (x < lo OR x > hi) AS outside, count(*) FILTER (x < lo OR x > hi) <= 0 AS inside FROM l JOIN b USING (dim) GROUP BY id""")
def range_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return domain.range_domain(v.where(TRAIN), v, "id", "v")


@query(f"""WITH {_LONG}, c AS (SELECT dim, avg(x) AS m FROM l WHERE label < 7 GROUP BY dim), d AS (SELECT id, label, sqrt(sum((x - m) * (x - m))) AS distance FROM l JOIN c USING (dim) GROUP BY id, label),
q AS (SELECT quantile_cont(distance, 0.95) AS q FROM d WHERE label < 7) SELECT id, round(distance, 6) AS distance, distance <= q + 1e-12 AS inside FROM d, q""")
def distance_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(domain.distance_domain(v.where(TRAIN), v, "id", "v"))


@query(f"""WITH {PAIRS}, f AS (SELECT *, l_returnflag <> 'R' AS inside, e - t AS d FROM p)
SELECT round(avg(inside::INTEGER), 6) AS coverage, count(*) FILTER (inside) AS n_inside, count(*) FILTER (NOT inside) AS n_outside, round(sqrt(avg(d * d) FILTER (inside)), 6) AS rmse_inside, round(sqrt(avg(d * d) FILTER (NOT inside)), 6) AS rmse_outside,
round(avg(abs(d)) FILTER (inside), 6) AS mae_inside, round(avg(abs(d)) FILTER (NOT inside), 6) AS mae_outside, round(sqrt(avg(d * d) FILTER (NOT inside)) / sqrt(avg(d * d) FILTER (inside)), 6) AS rmse_ratio FROM f""")
def domain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.domain_report(pairs(spark, sf_dir).withColumn("inside", F.col("l_returnflag") != "R"), "inside", "y_true", "y_pred"))


@query(f"""WITH {PAIRS}, c AS (SELECT abs(t - e) AS s, row_number() OVER (ORDER BY abs(t - e)) AS r, count(*) OVER () AS n FROM p WHERE l_shipdate < TIMESTAMP '1997-01-01'),
q AS (SELECT min(s) AS q FROM c WHERE r >= greatest(1, least(n, ceil((n + 1) * 0.9::DOUBLE)))) SELECT l_returnflag, count(*) AS n, round(avg((abs(t - e) <= q)::INTEGER), 6) AS coverage, round(any_value(2 * q), 6) AS width FROM p, q WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_returnflag""")
def conformal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, late = pairs(spark, sf_dir), F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")
    d = domain.conformal_interval(p.where(~late), p.where(late), "y_true", "y_pred")
    inside = F.abs(F.col("y_true") - F.col("y_pred")) <= (F.col("hi") - F.col("lo")) / 2 + 1e-12
    return rounded(d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.first(F.round(F.col("hi") - F.col("lo"), 9)).alias("width")))


@query("""WITH x AS (SELECT l_extendedprice / 1000 AS t, l_extendedprice / 1000 * (1 - l_discount) * (1 + l_tax) AS e, ntile(10) OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b, l_quantity / 10 AS s FROM lineitem),
g AS (SELECT b, avg(s) AS s, sqrt(avg((t - e) * (t - e))) AS r FROM x GROUP BY b) SELECT round(avg(abs(s - r) / s), 6) AS ence FROM g""")
def uncertainty_ence(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_extendedprice") / 1000
    x = read(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), y.alias("t"), (y * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("e"), (F.col("l_quantity") / 10).alias("s"))
    return rounded(domain.ence(x, "id", "t", "e", "s"))


@query("WITH n AS (SELECT greatest(1, round_even(count(*) * 0.2::DOUBLE, 0)) AS k FROM events) SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) <= k AS is_test FROM events, n")
def split_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_split(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "is_test")


@query("WITH n AS (SELECT greatest(1, round_even(count(*) * 0.2::DOUBLE, 0)) AS k FROM events) SELECT event_id, row_number() OVER (ORDER BY md5('0:' || event_id), event_id) <= k AS is_test FROM events, n")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(read(spark, sf_dir, "events").select("event_id"), "event_id")


@query("SELECT event_id, ((row_number() OVER (ORDER BY md5('0:' || event_id), event_id) - 1) % 5)::INTEGER AS fold FROM events")
def kfold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(read(spark, sf_dir, "events").select("event_id"), "event_id")


@query("""WITH RECURSIVE g AS (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS i FROM part GROUP BY p_type), t AS (SELECT sum(n) - greatest(1, round_even(sum(n) * 0.2::DOUBLE, 0)) AS target FROM g),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, '' AS p_type, false AS is_test UNION ALL
  SELECT g.i, CASE WHEN f.used + g.n <= target THEN f.used + g.n ELSE f.used END, g.p_type, f.used + g.n > target FROM f JOIN g ON g.i = f.i + 1, t)
SELECT p_partkey, is_test FROM part JOIN f USING (p_type)""")
def split_group_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_fill(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type").select("p_partkey", "is_test")


@query(f"""WITH {_LONG} SELECT dim::INTEGER AS dim, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS min, round(max(x), 6) AS max,
round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75 FROM l GROUP BY dim""")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preparation.column_statistics(vectors(spark, sf_dir), "id", "v"))


for _how, _c, _w in (("standard", "avg(x)", "stddev_pop(x)"), ("minmax", "min(x)", "max(x) - min(x)"), ("robust", "quantile_cont(x, 0.5)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")):

    def _scaled(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        return rounded(preparation.scale(vectors(spark, sf_dir), "id", "v", how))

    QUERIES[f"scale_{_how}"] = _scaled
    SQL[f"scale_{_how}"] = f"WITH {_LONG}, s AS (SELECT dim, {_c} AS c, {_w} AS w FROM l GROUP BY dim) SELECT id, dim::INTEGER AS dim, round((x - c) / (CASE WHEN w = 0 THEN 1 ELSE w END), 6) AS x FROM l JOIN s USING (dim)"


@query(f"WITH {_LONG} SELECT dim::INTEGER AS dim, round(var_pop(x), 6) AS variance FROM l GROUP BY dim HAVING var_pop(x) > 0.015")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preparation.variance_filter(vectors(spark, sf_dir), "id", "v", 0.015))


@query("SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events)), 6) AS value FROM events")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preparation.impute(read(spark, sf_dir, "events").select("event_id", "value"), ["value"]))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large components of each vector as set bits, none for some."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similarity.set_bits("embedding", 0.15).alias("bits"), "label")


_FP = "f AS (SELECT vec_id AS id, label, [i - 1 for i in range(1, len(embedding) + 1) if embedding[i]::DOUBLE > 0.15] AS bits FROM embeddings), fp AS (SELECT * FROM f)"
_SIM = f"{_FP}, j AS (SELECT a.id AS a_id, b.id AS b_id, a.label AS a_label, b.label AS b_label, len(list_intersect(a.bits, b.bits)) AS c, len(a.bits) AS a_n, len(b.bits) AS b_n FROM fp a JOIN fp b ON a.id <> b.id), s AS (SELECT *, coalesce(c / nullif(a_n + b_n - c, 0), 1) AS similarity FROM j)"


@query(f"WITH {_SIM} SELECT a_id, b_id, round(similarity, 6) AS similarity FROM s WHERE a_id < b_id AND similarity >= 0.5")
def tanimoto_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.similar_pairs(fingerprints(spark, sf_dir), 0.5))


@query(f"WITH {_SIM}, r AS (SELECT a_id AS query_id, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id)::INTEGER AS rank, b_id AS ref_id, round(similarity, 6) AS similarity FROM s) SELECT * FROM r WHERE rank <= 5")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark, sf_dir)
    return rounded(similarity.nearest(f.select("id", "bits"), f.select("id", "bits"), 5))


@query(f"WITH {_SIM} SELECT a_id, b_id, round(similarity, 6) AS similarity, abs(a_label - b_label)::DOUBLE AS delta, round(abs(a_label - b_label) / nullif(1 - similarity, 0), 6) AS sali FROM s WHERE a_id < b_id AND similarity >= 0.5 AND abs(a_label - b_label) >= 2")
def activity_cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark, sf_dir).withColumn("value", F.col("label").cast("double"))
    return rounded(similarity.cliffs(similarity.similar_pairs(f, 0.5, ["value"]), f, 2.0))
