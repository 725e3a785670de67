"""Classification, ranking, threshold and calibration metrics.

Ranking metrics aggregate by distinct score first; the distinct scores are then summed up in ranges of their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, square
from .ranking import ranked, running


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    tp, fp, tn, fn = (x.cast("double") for x in (tp, fp, tn, fn))
    n = tp + fp + tn + fn
    sens, spec, prec = ratio(tp, tp + fn, 0), ratio(tn, tn + fp, 0), ratio(tp, tp + fp, 0)
    acc = ratio(tp + tn, n, 0)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n, 0)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)
    return {"accuracy": acc, "sensitivity": sens, "specificity": spec, "precision": prec, "f1": ratio(2 * prec * sens, prec + sens, 0), "balanced_accuracy": (sens + spec) / 2, "mcc": mcc, "kappa": ratio(acc - chance, 1 - chance, 1.0)}


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and the rates that follow, in one aggregate."""
    t, p = F.col(y) == 1, F.col(pred) == 1
    a = df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    return a.select("*", *[c.alias(k) for k, c in rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).items()])


def by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """score, positives, negatives of each distinct score."""
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def sweep(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row per distinct score as threshold (score >= threshold is positive), with counts and rates, and one above all that predicts nothing."""
    g = by_score(df, y, score)
    every = g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    s = running(g.withColumn("neg_score", -F.col("score")), ["neg_score"], {"tp": F.col("pos"), "fp": F.col("neg")}).withColumnRenamed("score", "threshold").join(F.broadcast(every))  # one row
    nothing = every.where("p + q > 0").select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "p", "q")
    s = s.select("threshold", "tp", "fp", "p", "q").unionByName(nothing)
    s = s.select("threshold", "tp", "fp", (F.col("q") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))
    return s.select("*", *[c.alias(k) for k, c in rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).items()])


def optimal(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """criterion, value, threshold of the best of each criterion, ties to the lowest threshold."""
    s = sweep(df, y, score).withColumn("youden", F.round(F.col("sensitivity") + F.col("specificity") - 1, 12))
    names = ("youden", "f1", "mcc", "balanced_accuracy")
    best = s.agg(*[F.max(F.struct(F.round(c, 12).alias("value"), (-F.col("threshold")).alias("low"))).alias(c) for c in names])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}.value").alias("value"), (-F.col(f"{c}.low")).alias("threshold")) for c in names]))
    return best.select(rows.alias("r")).select("r.*")


def bounded_optima(df: DataFrame, y: str = "y", score: str = "score", cost_fn: float = 1.0, cost_fp: float = 1.0, min_precision: float = 0.0, min_recall: float = 0.0) -> DataFrame:
    """criterion, value, threshold, reached: least cost of the errors; most recall at a least precision; most precision at a least recall. Ties to the lowest threshold.

    Where no threshold has the precision (recall) asked for, value and threshold are null and reached is the best there is; else reached is what the threshold has.
    """
    s = sweep(df, y, score)
    cost = F.round(cost_fn * F.col("fn") + cost_fp * F.col("fp"), 12)
    low = (-F.col("threshold")).alias("low")
    floor = lambda c, least, goal: F.max(F.when(F.col(c) >= least, F.struct(F.round(goal, 12).alias("value"), low, F.col(c).alias("reached"))))
    best = s.agg(F.max(F.struct((-cost).alias("value"), low)).alias("cost"), floor("precision", min_precision, "sensitivity").alias("precision"), floor("sensitivity", min_recall, "precision").alias("recall"), F.max("precision").alias("p"), F.max("sensitivity").alias("r"), F.count(F.lit(1)).alias("n"))
    row = lambda name, value, reached: F.struct(F.lit(name).alias("criterion"), value.alias("value"), (-F.col(f"{name}.low")).alias("threshold"), reached.alias("reached"))
    rows = F.array(row("cost", -F.col("cost.value"), -F.col("cost.value")), row("precision", F.col("precision.value"), F.coalesce("precision.reached", "p")), row("recall", F.col("recall.value"), F.coalesce("recall.reached", "r")))
    return best.where("n > 0").select(F.explode(rows).alias("r")).select("r.*")


def threshold_report(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """criterion, threshold and rates at the best threshold of each criterion and at 0.5, beside base_rate, n_samples, roc_auc, pr_auc of all rows.

    The cut at 0.5 takes the rates of the lowest threshold of the sweep that is 0.5 or above.  Rows without a score or label don't count; of none, all rates are null.
    """
    shown = ("sensitivity", "specificity", "precision", "f1", "mcc", "balanced_accuracy", "accuracy")
    s = sweep(df, y, score).withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1)
    row = F.struct("threshold", *shown).alias("row")
    names = ("youden", "mcc", "f1", "balanced_accuracy")
    best = s.agg(*[F.max(F.struct(F.round(c, 12).alias("value"), (-F.col("threshold")).alias("low"), row)).alias(c) for c in names], F.min(F.when(F.col("threshold") >= 0.5, F.struct("threshold", row))).alias("half"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}.row.threshold").alias("threshold"), *[F.col(f"{c}.row.{k}").alias(k) for k in shown]) for c in names], F.struct(F.lit("default_0.5").alias("criterion"), F.lit(0.5).alias("threshold"), *[F.col(f"half.row.{k}").alias(k) for k in shown])))
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).agg(F.avg(F.col(y).cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("n_samples"))
    return best.select(rows.alias("r")).select("r.*").join(F.broadcast(known)).join(F.broadcast(areas(df, y, score)))  # one row each


def areas(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """roc_auc with ties as half, and average precision with ties grouped; null if a class is missing."""
    s = running(by_score(df, y, score).withColumn("neg_score", -F.col("score")), ["neg_score"], {"tp": F.col("pos"), "fp": F.col("neg")})
    a = s.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return a.select(ratio(F.col("won"), F.col("p") * F.col("q")).alias("roc_auc"), ratio(F.col("ap"), F.col("p")).alias("pr_auc"))


def enrichment(df: DataFrame, y: str = "y", score: str = "score", idx: str = "id", fraction: float = 0.01, alpha: float = 20.0) -> DataFrame:
    """Enrichment factor in the top share, robust initial enhancement and its bounded form; ties by idx, rows without a score last."""
    d = ranked(df.select(F.col(y), F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))).alias("neg_score"), F.col(idx).alias("i")), ["neg_score", "i"], "r")
    n = d.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("a"))
    d = d.where(F.col(y) == 1).join(F.broadcast(n))  # one row
    top = F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("long"))
    g = d.groupBy("n", "a").agg(F.count_if(F.col("r") <= top).alias("hits"), F.sum(F.exp(-alpha * F.col("r") / F.col("n"))).alias("s"))
    ra = F.col("a") / F.col("n")
    expected = ra * (1 - F.exp(F.lit(-alpha))) / (F.exp(alpha / F.col("n")) - 1)
    scale = F.try_divide(ra * F.sinh(F.lit(alpha / 2)), F.cosh(F.lit(alpha / 2)) - F.cosh(alpha / 2 - alpha * ra))
    rie = F.col("s") / expected
    # Without a negative the bounded form isn't defined; the other two are.
    bedroc = F.when(F.col("a") < F.col("n"), rie * scale + F.try_divide(F.lit(1.0), 1 - F.exp(alpha * (1 - ra))))
    return g.select(((F.col("hits") / top) / ra).alias("ef"), rie.alias("rie"), bedroc.alias("bedroc"))


def calibration(df: DataFrame, y: str = "y", prob: str = "score", bins: int = 10) -> DataFrame:
    """bin, mean_prob, rate, count of uniform bins, the last one closed; empty bins and rows without a score or label are left out."""
    df = df.where(F.col(prob).isNotNull() & F.col(y).isNotNull())
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(prob).alias("mean_prob"), F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("count"))


def calibration_report(df: DataFrame, y: str = "y", prob: str = "score", bins: int = 10) -> DataFrame:
    """ece, mce, brier, base_rate, skill and n, of rows with a score and a label."""
    df = df.where(F.col(prob).isNotNull() & F.col(y).isNotNull())
    c = calibration(df, y, prob, bins).withColumn("gap", F.abs(F.col("rate") - F.col("mean_prob")))
    e = c.agg((F.sum(F.col("gap") * F.col("count")) / F.sum("count")).alias("ece"), F.max("gap").alias("mce"))
    o = df.agg(F.avg(square(F.col(prob) - F.col(y))).alias("brier"), F.avg(F.col(y).cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("n"))
    return o.join(F.broadcast(e)).select("ece", "mce", "brier", "base_rate", (1 - ratio(F.col("brier"), F.col("base_rate") * (1 - F.col("base_rate")))).alias("skill"), "n")
