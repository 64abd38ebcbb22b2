"""Inverse distance weighting and k-NN means over a kNN join; cross-validation and tuning in the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pairs import knn_join

EXACT = 1e-12


def _near(targets: DataFrame, data: DataFrame, k: int, radius: float | None, self_out: bool) -> DataFrame:
    return knn_join(targets, data, k, radius, exclude_self=self_out).join(data.select("id", "value"), "id")


def _idw(near: DataFrame, power: float, keys: tuple[str, ...] = ("target_id",)) -> DataFrame:
    w = F.pow(F.col("d"), F.lit(-float(power)))
    exact = F.min_by(F.when(F.col("d") < EXACT, F.col("value")), "rank")
    return near.groupBy(*keys).agg(F.coalesce(exact, F.sum(F.when(F.col("d") >= EXACT, w * F.col("value"))) / F.sum(F.when(F.col("d") >= EXACT, w))).alias("prediction"))


def idw(targets: DataFrame, data: DataFrame, power: float = 2.0, k: int = 16, radius: float | None = None) -> DataFrame:
    """id, prediction; NULL without a neighbour."""
    out = _idw(_near(targets, data, k, radius, False), power)
    return targets.select("id").join(out.withColumnRenamed("target_id", "id"), "id", "left")


def knn_mean(targets: DataFrame, data: DataFrame, k: int = 8, radius: float | None = None) -> DataFrame:
    """id, prediction: the mean of the k nearest (k = 1: the nearest)."""
    out = _near(targets, data, k, radius, False).groupBy("target_id").agg(F.avg("value").alias("prediction"))
    return targets.select("id").join(out.withColumnRenamed("target_id", "id"), "id", "left")


def _against(data: DataFrame, predicted: DataFrame) -> DataFrame:
    rows = predicted.select(F.col("target_id").alias("id"), F.col("prediction").alias("predicted"))
    return data.select("id", F.col("value").alias("observed")).join(rows, "id", "left").withColumn("variance", F.lit(None).cast("double"))


def neighbors_of_all(data: DataFrame, k: int) -> DataFrame:
    """Each point's k nearest others, with their values: what cross-validations of several methods can share."""
    return _near(data, data, k, None, True)


def idw_cross_validate(data: DataFrame, power: float = 2.0, k: int = 16, near: DataFrame | None = None) -> DataFrame:
    """near: neighbors_of_all for k or more, if there is one already."""
    near = neighbors_of_all(data, k) if near is None else near.filter(F.col("rank") <= k)
    return _against(data, _idw(near, power))


def knn_cross_validate(data: DataFrame, k: int = 8, near: DataFrame | None = None) -> DataFrame:
    near = neighbors_of_all(data, k) if near is None else near.filter(F.col("rank") <= k)
    return _against(data, near.groupBy("target_id").agg(F.avg("value").alias("prediction")))


def tune_idw_power(data: DataFrame, powers: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0), k: int = 16) -> DataFrame:
    """param, vecv for each power: one neighbour join for all."""
    near = _near(data, data, k, None, True).withColumn("param", F.explode(F.array(*[F.lit(float(p)) for p in powers])))
    w = F.pow(F.col("d"), -F.col("param"))
    each = near.groupBy("param", "target_id").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("prediction"))
    return _vecv(each, data)


def tune_knn_k(data: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12, 16, 24)) -> DataFrame:
    near = _near(data, data, max(ks), None, True).withColumn("param", F.explode(F.array(*[F.lit(float(k)) for k in ks]))).filter("rank <= param")
    return _vecv(near.groupBy("param", "target_id").agg(F.avg("value").alias("prediction")), data)


def _vecv(each: DataFrame, data: DataFrame) -> DataFrame:
    met = each.join(data.select(F.col("id").alias("target_id"), "value"), "target_id")
    error = F.sum((F.col("value") - F.col("prediction")) ** 2)
    return met.groupBy("param").agg((100 * (1 - error / (F.var_pop("value") * F.count(F.lit(1))))).alias("vecv"))


def best_param(tuned: DataFrame) -> float:
    """Of the largest VEcv, the last parameter on ties."""
    return tuned.agg(F.max_by("param", F.struct("vecv", "param"))).first()[0]
