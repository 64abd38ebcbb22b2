"""Command line: python -m fieldkrig.cli COMMAND ...; tables in and out are CSV, Parquet or GeoPackage."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .errors import EngineError, InvalidParameter
from .functions.models import VariogramModel, parse_kinds
from .operators import cokriging, fit, interpolation, kriging, transform, validate, variogram
from .sources import gpkg
from .sources import points as src


def _load(spark: SparkSession, a, path: str | None = None, value: bool = True, extras: tuple[str, ...] = ()) -> DataFrame:
    path = path or a.input
    if path.endswith(".gpkg"):
        if extras or a.z:
            raise InvalidParameter("GeoPackage layers give no covariates and no z")
        df, skipped = gpkg.read_points(spark, path, a.layer, a.value if value else None)
    elif path.endswith(".parquet"):
        df, skipped = src.points(spark.read.parquet(path), a.x, a.y, a.value if value else None, a.z, None, extras).dropna(), 0
    else:
        df, skipped = src.read_csv(spark, path, a.x, a.y, a.value if value else None, a.z, extras)
    if skipped:
        print(f"skipped {skipped} rows without a number", file=sys.stderr)
    return df


def _save(df: DataFrame, path: str | None) -> None:
    if path is None:
        df.show(50, truncate=False)
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".gpkg"):
        gpkg.write_points(df, path, "result")
    else:
        src.write_csv(df, path)


def _near(a) -> kriging.Neighbors:
    ellipsoid = None if a.search_azimuth is None else kriging.Anisotropy(a.search_azimuth, a.search_ratio)
    return kriging.Neighbors(a.max_neighbors, a.radius, a.min_neighbors, a.octant, ellipsoid)


def _grid(a, df: DataFrame):
    return api.grid_over(df, (a.nx, a.ny, *([a.nz] if a.z else [])), a.resolution)


def _model(a) -> VariogramModel:
    if not a.model:
        raise InvalidParameter("--model is needed")
    return src.read_model(a.model)


def _kinds(text: str) -> list[str]:
    return [k if p is None else f"{k}:{p}" for k, p in parse_kinds(text)]


def run_variogram(spark, a):
    covariates = tuple(a.covariates)
    df = _load(spark, a, extras=covariates)
    if a.detrend or covariates:
        df = transform.detrend(df, [F.col(c) for c in covariates] or transform.polynomial_terms(df, a.detrend))
    if a.mle:
        e = api.vecchia_reml(df, a.mle, a.detrend or 1, a.cond) if a.reml else api.vecchia_mle(df, a.mle, a.cond)
        return print(json.dumps({"model": json.loads(e.model.to_json()), "loglik": e.loglik}))
    if a.fit and a.estimator == "madogram":
        raise InvalidParameter("a madogram is no semivariogram and can't be fitted")
    ev = variogram.experimental_variogram(df, a.n_lags, a.max_dist, a.estimator, a.azimuth, a.tolerance, a.dip)
    _save(ev.orderBy("lag"), a.output)
    if a.fit:
        f = fit.fit_anisotropic(df, _kinds(a.fit), max_dist=a.max_dist) if a.anisotropic else fit.fit_best(ev, _kinds(a.fit), a.weights)
        print(json.dumps({"model": json.loads(f.model.to_json()), "wsse": f.wsse}))


def run_vmap(spark, a):
    _save(variogram.variogram_map(_load(spark, a), a.n_lags, a.lag_width), a.output)


def run_krige(spark, a):
    covariates = tuple(a.covariates)
    df = _load(spark, a, extras=(*covariates, *([a.error] if a.error else [])))
    if covariates and not a.targets:
        raise InvalidParameter("external drift needs --targets with the covariates")
    targets = _load(spark, a, a.targets, False, covariates) if a.targets else _grid(a, df).frame(spark).withColumnRenamed("node", "id")
    model, options = _model(a), {"neighbors": _near(a)}
    if a.vecchia:
        return _save(targets.join(api.vecchia_krige(spark, df, targets, model, a.cond), "id"), a.output)
    method = "drift" if covariates else a.method
    if a.lognormal:
        return _save(kriging.lognormal_kriging(targets, df, model, method, **options), a.output)
    block = None if not a.block else (tuple(a.block), tuple(a.discretization[: len(a.block)]))
    if method == "universal":
        options["degree"] = a.degree
    if method == "simple":
        options["mean"] = a.mean
    _save(kriging.krige(targets, df, model, covariates, a.error, block, method=method, **options), a.output)


def run_cokrige(spark, a):
    df = _load(spark, a, extras=() if a.secondary_file else (a.secondary,))
    if a.secondary_file:
        if not a.model:
            raise InvalidParameter("a secondary file needs --model with a coregionalization")
        other = _load(spark, a, a.secondary_file)
    else:
        other = df.select("id", "x", "y", F.col(a.secondary).alias("value"))
    first = df.select("id", "x", "y", "value")
    if a.model:
        with open(a.model, encoding="utf-8") as f:
            lmc = cokriging.Lmc.from_json(f.read())
    else:
        lmc = cokriging.fit_lmc_collocated(first, other, a.n_lags, a.max_dist)
    _save(cokriging.cokrige(_grid(a, df).frame(spark), [first, other], lmc, key="node", neighbors=_near(a), ridge=a.ridge), a.output)


def run_collocated(spark, a):
    df = _load(spark, a, extras=(a.secondary,))
    targets = _load(spark, a, a.targets, False, (a.secondary,))
    second = read_model(a.secondary_model) if a.secondary_model else None
    _save(cokriging.collocated_cokrige(targets, df, _model(a), a.secondary, markov=a.markov, secondary_model=second, neighbors=_near(a), ridge=a.ridge), a.output)


def run_cv(spark, a):
    covariates = tuple(a.covariates)
    if covariates and (a.folds or a.blocks):
        raise InvalidParameter("drift takes leave-one-out only")
    df, fold = _load(spark, a, extras=covariates), None
    if a.folds:
        df, fold = kriging.shuffled_fold(df, a.folds, a.seed), "fold"
    elif a.blocks:
        df, fold = kriging.block_fold(df, tuple(a.blocks)), "fold"
    cv = kriging.leave_one_out(df, _model(a), covariates, fold=fold, method="drift" if covariates else a.method, neighbors=_near(a))
    if a.output:
        _save(cv, a.output)
    validate.metrics(cv).show(vertical=True, truncate=False)
    validate.accuracy_plot(cv, [i / 10 for i in range(1, 10)]).orderBy("p").show()


def _tail(text: str | None, default: float) -> transform.Tail:
    t = transform.Tail.parse(text or f"linear:{default}")
    return t if t.bound is not None or t.kind in ("none", "hyperbolic") else transform.Tail(t.kind, default, t.omega)


def run_sgs(spark, a):
    df = _load(spark, a)
    if a.model:
        model = _model(a)
    else:
        scores = transform.forward_scores(df, transform.normal_scores(df)).withColumn("value", F.col("score"))
        model = api.fit_variogram(scores, _kinds(a.fit or "best"), a.n_lags, a.max_dist).model
    weight = None
    if a.decluster:
        df, weight = transform.decluster(df, a.decluster, 4), "weight"
    sims = api.sgs(df, _grid(a, df), model, a.realizations, a.seed, a.max_neighbors or 16, a.nodmax, a.radius, a.multigrid, weight, transform.Tail.parse(a.lower or "none"), transform.Tail.parse(a.upper or "none"))
    _save(src.wide_simulations(sims, a.realizations), a.output)


def run_tgs(spark, a):
    df = _load(spark, a).withColumn("category", F.col("value"))
    k = int(df.agg(F.max("category")).first()[0]) + 1
    _save(src.wide_simulations(api.tgs(df, _grid(a, df), _model(a), k, a.realizations, a.seed, a.max_neighbors or 16, a.radius, a.multigrid), a.realizations), a.output)


def _cutoffs(df: DataFrame, a) -> list[float]:
    return a.cutoffs or transform.quantile_cutoffs(df, a.quantiles)


def _indicator(a, df: DataFrame):
    cutoffs = _cutoffs(df, a)
    models = [_model(a)] if a.model else [f.model for f in fit.fit_indicator_models(df, cutoffs, _kinds(a.fit or "spherical,exponential"), a.n_lags, a.max_dist)]
    low, high = df.agg(F.min("value"), F.max("value")).first()
    return cutoffs, models, _tail(a.lower, low), _tail(a.upper, high)


def run_sis(spark, a):
    df = _load(spark, a)
    _save(src.wide_simulations(api.sis(df, _grid(a, df), *_indicator(a, df), a.realizations, a.seed, a.max_neighbors or 16, a.radius), a.realizations), a.output)


def run_ik(spark, a):
    df = _load(spark, a)
    cutoffs, models, low, high = _indicator(a, df)
    out = api.indicator_kriging(_grid(a, df).frame(spark), df, cutoffs, models, low, high, a.method != "simple", _near(a), key="node")
    _save(src.wide_ccdf(out, len(cutoffs)), a.output)


def run_declus(spark, a):
    df = _load(spark, a)
    diagonal = src.diagonal(df)
    if a.cell:
        cell = a.cell
    else:
        scan = transform.decluster_scan(df, [diagonal * (1 / 50 + i / 19 * (1 / 5 - 1 / 50)) for i in range(20)], 4)
        cell = transform.best_cell(scan, not a.maximum)
    print(f"cell size {cell}")
    _save(transform.decluster(df, cell, 4), a.output)


def run_rk(spark, a):
    covariates = tuple(a.covariates)
    _save(api.regression_kriging(_load(spark, a, a.targets, False, covariates), _load(spark, a, extras=covariates), _model(a), covariates, neighbors=_near(a)), a.output)


def run_compare(spark, a):
    _save(api.compare_methods(_load(spark, a), _model(a), a.max_neighbors or 32, a.idw_power, a.knn_k), a.output)


def run_tune(spark, a):
    df = _load(spark, a)
    tuned = {"idw": lambda: api.tune_idw_power(df), "knn": lambda: api.tune_knn_k(df), "ok": lambda: api.tune_kriging_neighbors(df, _model(a))}[a.what]()
    _save(tuned, a.output)
    print(f"best {interpolation.best_param(tuned)}")


def run_gpkg_info(spark, a):
    for kind in ("features", "2d-gridded-coverage"):
        for layer, srs in gpkg.list_layers(a.input, kind):
            print(f"{layer}\t{kind}\t{srs}")


def run_gpkg_sample(spark, a):
    raster, grid = gpkg.read_raster(spark, a.raster, a.raster_layer)
    _save(src.sample_raster(_load(spark, a, value=False), raster, grid), a.output)


COMMANDS = {
    "variogram": run_variogram, "vmap": run_vmap, "krige": run_krige, "cokrige": run_cokrige, "collocated-cokrige": run_collocated, "cv": run_cv, "sgs": run_sgs, "tgs": run_tgs,
    "declus": run_declus, "sis": run_sis, "ik": run_ik, "rk": run_rk, "compare": run_compare, "tune": run_tune, "gpkg-info": run_gpkg_info, "gpkg-sample": run_gpkg_sample,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldkrig", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    numbers = lambda kind: lambda t: [kind(v) for v in t.split(",")]
    names = lambda t: [v for v in t.split(",") if v]
    for command in COMMANDS:
        c = sub.add_parser(command)
        c.add_argument("input")
        for flag, kind, default in (
            ("x", str, "x"), ("y", str, "y"), ("z", str, None), ("value", str, "value"), ("layer", str, None), ("output", str, None), ("model", str, None), ("targets", str, None),
            ("n-lags", int, 15), ("max-dist", float, None), ("lag-width", float, None), ("estimator", str, "matheron"), ("azimuth", float, None), ("tolerance", float, 22.5), ("dip", float, 0.0),
            ("fit", str, None), ("weights", str, "n/h2"), ("detrend", int, 0), ("mle", str, None), ("cond", int, 20), ("covariates", names, []), ("error", str, None),
            ("nx", int, 100), ("ny", int, 100), ("nz", int, 10), ("resolution", float, None), ("method", str, "ordinary"), ("degree", int, 1), ("mean", float, 0.0), ("block", numbers(float), None), ("discretization", numbers(int), [4, 4, 4]),
            ("max-neighbors", int, None if command in ("sgs", "tgs", "sis") else 32), ("radius", float, None), ("min-neighbors", int, 1), ("octant", int, None), ("search-azimuth", float, None), ("search-ratio", float, 1.0),
            ("secondary", str, "secondary"), ("secondary-file", str, None), ("ridge", float, 0.0), ("markov", str, "mm1"), ("secondary-model", str, None), ("folds", int, None), ("blocks", numbers(int), None), ("seed", int, 42),
            ("realizations", int, 10), ("nodmax", int, None), ("multigrid", int, 0), ("decluster", float, None), ("lower", str, None), ("upper", str, None), ("cutoffs", numbers(float), None), ("quantiles", numbers(float), [0.25, 0.5, 0.75]),
            ("cell", float, None), ("idw-power", float, 2.0), ("knn-k", int, 8), ("what", str, "ok"), ("raster", str, None), ("raster-layer", str, None),
        ):
            c.add_argument(f"--{flag}", type=kind, default=default)
        for flag in ("reml", "anisotropic", "lognormal", "vecchia", "maximum"):
            c.add_argument(f"--{flag}", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("fieldkrig").getOrCreate()
    try:
        COMMANDS[a.command](spark, a)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
