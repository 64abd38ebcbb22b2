"""Scores of predictions against observations: (id, observed, predicted, variance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import inv_norm_cdf_col


def metrics(cv: DataFrame) -> DataFrame:
    """One row: n, me, mae, mse, rmse, rme, rmae, rrmse (percent of the mean), vecv, e1, msdr."""
    o, p, v = F.col("observed"), F.col("predicted"), F.col("variance")
    mean = cv.select(F.avg("observed").alias("_mean"))
    rows = cv.crossJoin(F.broadcast(mean))  # one row
    e = p - o
    away, spread = F.sum((o - F.col("_mean")) ** 2), F.sum(F.abs(o - F.col("_mean")))
    m = F.first("_mean")
    usable = v > 1e-12
    ratio = lambda x: F.when(m != 0, 100 * x / m)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("me"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        ratio(F.avg(-e)).alias("rme"),
        ratio(F.avg(F.abs(e))).alias("rmae"),
        ratio(F.sqrt(F.avg(e * e))).alias("rrmse"),
        F.when(away > 0, 100 * (1 - F.sum(e * e) / away)).alias("vecv"),
        F.when(spread > 0, 100 * (1 - F.sum(F.abs(e)) / spread)).alias("e1"),
        F.avg(F.when(usable, e * e / v)).alias("msdr"),
    )


def accuracy_plot(cv: DataFrame, probabilities: list[float]) -> DataFrame:
    """p, observed_p: the share of observations inside the central Gaussian interval of each probability."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities]))
    rows = cv.filter("variance > 0").withColumn("p", p)
    half = inv_norm_cdf_col((1 + F.col("p")) / 2) * F.sqrt("variance")
    inside = (F.abs(F.col("observed") - F.col("predicted")) <= half).cast("double")
    return rows.groupBy("p").agg(F.avg(inside).alias("observed_p"))


def goodness(plot: DataFrame) -> DataFrame:
    """One row: 1 minus the mean distance from the diagonal, doubled below it; is_accurate: nowhere below it."""
    gap = F.col("observed_p") - F.col("p")
    return plot.agg((1 - F.avg(F.when(gap < 0, -2 * gap).otherwise(gap))).alias("goodness"), F.bool_and(gap >= 0).alias("is_accurate"))


def accuracy_plot_ccdf(rows: DataFrame, cutoffs: list[float], probabilities: list[float], low: float, high: float) -> DataFrame:
    """As accuracy_plot for ccdfs (observed, ccdf array): intervals between their quantiles, linear between cutoffs and to low and high."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities]))
    rows = rows.withColumn("p", p)
    inside = (F.col("observed") >= ccdf_quantile(F.col("ccdf"), (1 - F.col("p")) / 2, cutoffs, low, high)) & (F.col("observed") <= ccdf_quantile(F.col("ccdf"), (1 + F.col("p")) / 2, cutoffs, low, high))
    return rows.groupBy("p").agg(F.avg(inside.cast("double")).alias("observed_p"))


def ccdf_quantile(ccdf: Column, q: Column, cutoffs: list[float], low: float, high: float) -> Column:
    """Quantile of a step of linear pieces through (low, 0), the cutoffs and (high, 1)."""
    z = [low, *cutoffs, high]
    f = [F.lit(0.0), *[F.get(ccdf, k) for k in range(len(cutoffs))], F.lit(1.0)]
    out = F.lit(float(high))
    for k in reversed(range(1, len(z))):
        out = F.when(q <= f[k], F.when(f[k] > f[k - 1], F.lit(float(z[k - 1])) + (q - f[k - 1]) / (f[k] - f[k - 1]) * float(z[k] - z[k - 1])).otherwise(F.lit(float(z[k])))).otherwise(out)
    return out


def rps(rows: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Ranked probability score: mean over points of the mean squared distance of ccdf and indicator."""
    c = F.array(*[F.lit(float(x)) for x in cutoffs])
    squares = F.zip_with("ccdf", c, lambda f, z: F.pow(f - (F.col("observed") <= z).cast("double"), F.lit(2.0)))
    return rows.agg(F.avg(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / len(cutoffs)).alias("rps"))
