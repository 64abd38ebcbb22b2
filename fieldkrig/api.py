"""The functions a notebook needs, over DataFrames of points (id, x, y[, z], value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.models import BEST, VariogramModel
from .operators import cokriging, fit, indicator, interpolation, kriging, simulate, transform, validate, variogram, vecchia
from .operators.kriging import Neighbors
from .operators.transform import Tail
from .plans.lineage import written
from .sources.points import Grid, bbox, coords, points

__all__ = [
    "BEST", "Grid", "Neighbors", "Tail", "VariogramModel", "accuracy_plot", "co_kriging", "collocated_cokriging", "collocated_stats", "compare_methods", "decluster_weights", "experimental_variogram", "experimental_variogram_3d",
    "fit_anisotropic", "fit_variogram", "fit_variogram_3d", "grid_over", "idw", "indicator_kriging", "knn", "krige", "krige_3d", "krige_grid", "lognormal_kriging", "loo_cv", "points", "regression_kriging", "sgs", "sis", "tgs",
    "tune_idw_power", "tune_knn_k", "tune_kriging_neighbors", "variogram_map", "vecchia_krige", "vecchia_loglik", "vecchia_mle", "vecchia_param_se", "vecchia_reml", "vecchia_reml_drift",
]

experimental_variogram = experimental_variogram_3d = variogram.experimental_variogram
variogram_map = variogram.variogram_map
krige = krige_3d = kriging.krige
krige_grid = kriging.krige_grid
lognormal_kriging = kriging.lognormal_kriging
loo_cv = kriging.leave_one_out
accuracy_plot = validate.accuracy_plot
co_kriging = cokriging.cokrige
collocated_stats = transform.collocated_stats
collocated_cokriging = cokriging.collocated_cokrige
idw, knn = interpolation.idw, interpolation.knn_mean
tune_idw_power, tune_knn_k = interpolation.tune_idw_power, interpolation.tune_knn_k
decluster_weights = transform.decluster
indicator_kriging = indicator.indicator_krige
sgs, tgs, sis = simulate.sgs, simulate.tgs, simulate.sis
fit_anisotropic = fit.fit_anisotropic


def fit_variogram(df: DataFrame, kinds=BEST, n_lags: int = 15, max_dist: float | None = None, weights: str = "n/h2") -> fit.Fit:
    """The best of the kinds for the experimental variogram of df."""
    return fit.fit_best(experimental_variogram(df, n_lags, max_dist), kinds, weights)


def fit_variogram_3d(df: DataFrame, kinds=tuple(k for k in BEST if k != "circular"), **options) -> fit.Fit:
    return fit_variogram(df, kinds, **options)


def grid_over(df: DataFrame, n: tuple[int, ...] | None = None, resolution: float | None = None) -> Grid:
    """A grid over the bounding box: 100 cells an axis unless told otherwise."""
    b, names = bbox(df), coords(df)
    low, high = [b[f"min_{c}"] for c in names], [b[f"max_{c}"] for c in names]
    return Grid.with_resolution(low, high, resolution) if resolution else Grid.from_bbox(low, high, n or (100,) * len(names))


def regression_kriging(targets: DataFrame, df: DataFrame, model: VariogramModel, covariates: tuple[str, ...], **options) -> DataFrame:
    """A linear trend in covariates fitted here, its residuals kriged."""
    terms = [F.col(c) for c in covariates]
    trend = transform.trend_col(transform.ols(df, terms), terms)
    return kriging.regression_kriging(targets.withColumn("trend", trend), df.withColumn("trend", trend), model, **options)


def compare_methods(df: DataFrame, model: VariogramModel, neighbors: int = 32, idw_power: float = 2.0, knn_k: int = 8) -> DataFrame:
    """Leave-one-out scores of kriging, IDW, k-NN and the nearest neighbour, best VEcv first."""
    near = written(interpolation.neighbors_of_all(df, max(16, knn_k)), "neighbors")  # one search for the three
    frames = {
        "ok": kriging.leave_one_out(df, model, neighbors=Neighbors(max=neighbors)),
        "idw": interpolation.idw_cross_validate(df, idw_power, near=near),
        "knn": interpolation.knn_cross_validate(df, knn_k, near=near),
        "nn": interpolation.knn_cross_validate(df, 1, near=near),
    }
    out = None
    for name, cv in frames.items():
        row = validate.metrics(cv).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("vecv"))


def tune_kriging_neighbors(df: DataFrame, model: VariogramModel, counts: tuple[int, ...] = (4, 8, 12, 16, 24, 32, 48)) -> DataFrame:
    """param, vecv: one search and one growing factor for all numbers of neighbours; a power model is solved for each."""
    if not model.has_power:
        each = kriging.leave_one_out_sizes(df, model, counts)
        error, away = F.sum((F.col("predicted") - F.col("observed")) ** 2), F.var_pop("observed") * F.count(F.lit(1))
        return each.groupBy(F.col("size").cast("double").alias("param")).agg(F.when(away > 0, 100 * (1 - error / away)).alias("vecv"))
    out = None
    for k in counts:
        row = validate.metrics(kriging.leave_one_out(df, model, neighbors=Neighbors(max=k))).select(F.lit(float(k)).alias("param"), "vecv")
        out = row if out is None else out.unionByName(row)
    return out


def _arrays(df: DataFrame, extras: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    return kriging.collect_points(df, extras)


def vecchia_loglik(df: DataFrame, model: VariogramModel, m: int = 20) -> float:
    p = _arrays(df)
    return vecchia.loglik_frame(df.sparkSession, p["xyz"], p["value"], model, vecchia.make_plan(p["xyz"], m, spark=df.sparkSession)).first()["loglik"]


def vecchia_mle(df: DataFrame, kind: str = "exponential", m: int = 20, grouped: bool = False) -> vecchia.Estimate:
    p = _arrays(df)
    return vecchia.mle_matern(p["xyz"], p["value"], m, df.sparkSession) if kind == "matern" else vecchia.mle(p["xyz"], p["value"], kind, m, grouped, df.sparkSession)


def vecchia_reml(df: DataFrame, kind: str = "exponential", degree: int = 1, m: int = 20, grouped: bool = False) -> vecchia.Estimate:
    p = _arrays(df)
    return vecchia.reml(p["xyz"], p["value"], kind, degree, m, None, grouped, df.sparkSession)


def vecchia_reml_drift(df: DataFrame, covariates: tuple[str, ...], kind: str = "exponential", m: int = 20, grouped: bool = False) -> vecchia.Estimate:
    p = _arrays(df, covariates)
    return vecchia.reml(p["xyz"], p["value"], kind, 1, m, np.stack([p[c] for c in covariates], axis=-1), grouped, df.sparkSession)


def vecchia_param_se(df: DataFrame, model: VariogramModel, m: int = 20) -> dict[str, float]:
    p = _arrays(df)
    return dict(zip(("nugget", "sill", "range"), vecchia.param_se(p["xyz"], p["value"], model, m, df.sparkSession).tolist()))


def vecchia_krige(spark: SparkSession, df: DataFrame, targets: DataFrame, model: VariogramModel, m: int = 20) -> DataFrame:
    """Joint prediction; sequential along the targets, so targets come to the driver (bounded as the data are)."""
    p, t = _arrays(df), _arrays(targets)
    mean, var = vecchia.predict(p["xyz"], p["value"], t["xyz"], model, m)
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in zip(t["id"], mean, var)], "id long, prediction double, variance double")
