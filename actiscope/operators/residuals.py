"""Are residuals normal: quantile-quantile points and the line through their quartiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import quantiles, ranked

# The rational approximations of algorithm AS 241 (Wichura 1988), ascending powers, numerator and denominator, in the middle, the tails and far out.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _rational(parts: tuple[tuple[float, ...], tuple[float, ...]], r: Column) -> Column:
    top, bottom = (reduce(lambda s, c: s * r + F.lit(c), reversed(p[:-1]), F.lit(p[-1])) for p in parts)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability, to about 1e-15; null outside of 0 to 1, both excluded."""
    q = p - 0.5
    least = F.least(p, 1 - p)
    r = F.sqrt(-F.log(F.when(least > 0, least)))
    outer = F.when(r <= 5, _rational(TAIL, r - 1.6)).otherwise(_rational(FAR, r - 5))
    inner = q * _rational(MIDDLE, F.lit(0.180625) - q * q)
    return F.when((p <= 0) | (p >= 1), None).when(F.abs(q) <= 0.425, inner).when(q < 0, -outer).otherwise(outer)


def points(df: DataFrame, y: str, p: str, idx: str, standardize: bool = True) -> DataFrame:
    """idx, sample, theoretical: residuals y - p in order beside the normal quantiles of (rank - 3/8) / (n + 1/4).

    Standardised by the mean and the sample deviation; where that is 0 or undefined, only centred.  Residuals that are null or not finite have no point;
    equal ones are ranked by idx.  An empty table has no points.
    """
    e = (F.col(y) - F.col(p)).cast("double")
    d = df.select(F.col(idx), e.alias("e")).where(F.col("e").isNotNull() & ~F.isnan("e") & (F.abs("e") < float("inf")))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("m"), F.stddev_samp("e").alias("s"))
    at = normal_quantile((F.col("r") - 0.375) / (F.col("n") + 0.25))
    spread = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    sample = (F.col("e") - F.col("m")) / spread if standardize else F.col("e")
    return ranked(d, ["e", idx], "r").join(F.broadcast(s)).select(idx, sample.alias("sample"), at.alias("theoretical"))  # one row


def reference_line(qq: DataFrame) -> DataFrame:
    """slope, intercept of the line through the first and third quartiles of both axes; slope 1 where the theoretical quartiles are equal."""
    t, s = quantiles(qq, "theoretical", {"t1": 0.25, "t3": 0.75}), quantiles(qq, "sample", {"s1": 0.25, "s3": 0.75})
    slope = F.coalesce(F.try_divide(F.col("s3") - F.col("s1"), F.col("t3") - F.col("t1")), F.lit(1.0))
    return t.join(F.broadcast(s)).select(slope.alias("slope"), (F.col("s1") - slope * F.col("t1")).alias("intercept"))  # one row each
