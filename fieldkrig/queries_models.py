"""Registered queries of the operators that fit, simulate or solve larger systems.

SQL has no compact form for most of them; tests hold them against brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .functions.models import Structure, single
from .operators import cokriging, fit, indicator, interpolation, kriging, simulate, transform, validate, variogram, vecchia
from .queries import CUTS, EXPO, FIELD, LAGS, NEAR, REACH, _targets, field, pts3, query, rounded
from .sources.points import Grid

GRID = Grid.from_bbox((-0.4, -0.4), (0.4, 0.4), (20, 20))
INDICATOR = single("exponential", 0.2, 0.4, 0.02)
LOW, HIGH = transform.Tail("linear", -3.0), transform.Tail("linear", 4.0)


def _fit_rows(s, fits: dict):
    rows = [(k, float(f.model.nugget), float(f.model.structures[0].sill), float(f.model.structures[0].range), float(f.wsse)) for k, f in fits.items()]
    return s.createDataFrame(rows, "name string, nugget double, sill double, range double, wsse double")


def _bins(s, d):
    return fit.usable(variogram.experimental_variogram(field(s, d), LAGS, REACH))


@query("m15_fit_model")
def m15(s, d):
    b = _bins(s, d)
    return _fit_rows(s, {w: fit.fit_model(b, "spherical", w) for w in fit.WEIGHTS})


@query("m16_fit_best")
def m16(s, d):
    return _fit_rows(s, {"best": fit.fit_best(_bins(s, d))})


@query("m17_fit_matern_stable")
def m17(s, d):
    b = _bins(s, d)
    return _fit_rows(s, {"matern": fit.fit_matern(b), "stable": fit.fit_stable(b)})


@query("m18_fit_nested")
def m18(s, d):
    return _fit_rows(s, {"nested": fit.fit_nested(_bins(s, d), ["spherical", "exponential"])})


@query("m19_fit_anisotropic")
def m19f(s, d):
    return _fit_rows(s, {"anisotropic": fit.fit_anisotropic(field(s, d), ("spherical",), 4, LAGS, REACH)})


@query("m20_fit_indicator_models")
def m20f(s, d):
    return _fit_rows(s, {str(k): f for k, f in enumerate(fit.fit_indicator_models(field(s, d), list(CUTS), n_lags=LAGS, max_dist=REACH))})


def _two(s, d):
    f = field(s, d)
    return f.select("id", "x", "y", "value"), f.select("id", "x", "y", F.col("secondary").alias("value"))


LMC = cokriging.Lmc(np.array([[0.1, 0.05], [0.05, 0.12]]), ((Structure("exponential", 1.0, 0.4), np.array([[0.9, 0.8], [0.8, 0.95]])),))


@query("m22_fit_lmc")
def m22(s, d):
    a, b = _two(s, d)
    lmc = cokriging.fit_lmc_collocated(a, b, LAGS, REACH, ("spherical",))
    rows = [("nugget", i, j, float(lmc.nugget[i][j])) for i in range(2) for j in range(2)] + [("structure", i, j, float(m[i][j])) for _, m in lmc.structures for i in range(2) for j in range(2)]
    return s.createDataFrame(rows, "part string, i int, j int, sill double")


# One primary and one secondary neighbour: weights 1 and 0, so the estimate is the nearest primary value.
@query("k13_cokriging_one_neighbor", f"with {FIELD}, tg as (select id, x+0.013 x, y-0.007 y from fld), nn as (select t.id, b.v, row_number() over (partition by t.id order by (b.x-t.x)**2+(b.y-t.y)**2, b.id) r from tg t, fld b) select id, round(v,6) prediction from nn where r=1")
def k13one(s, d):
    out = cokriging.cokrige(_targets(s, d), list(_two(s, d)), LMC, neighbors=kriging.Neighbors(max=1))
    return rounded(out.select("id", "prediction"), "prediction")


@query("k13_cokriging")
def k13(s, d):
    return cokriging.cokrige(_targets(s, d), list(_two(s, d)), LMC, neighbors=NEAR)


@query("k14_block_cokriging")
def k14(s, d):
    return cokriging.cokrige(GRID.frame(s), list(_two(s, d)), LMC, block=((0.04, 0.04), (3, 3)), key="node", neighbors=kriging.Neighbors(max=8))


def _secondary_targets(s, d):
    return _targets(s, d, "secondary")


@query("k15_collocated_cokriging")
def k15(s, d):
    return cokriging.collocated_cokrige(_secondary_targets(s, d), field(s, d), EXPO, neighbors=NEAR)


@query("k15_collocated_mm2")
def k15b(s, d):
    return cokriging.collocated_cokrige(_secondary_targets(s, d), field(s, d), EXPO, markov="mm2", secondary_model=single("spherical", 0.8, 0.6, 0.2), neighbors=NEAR)


@query("k17_indicator_kriging")
def k17(s, d):
    return indicator.indicator_krige(_targets(s, d), field(s, d), list(CUTS), [INDICATOR], LOW, HIGH, neighbors=NEAR)


@query("k20_soft_indicator_kriging")
def k20(s, d):
    f, names = field(s, d), tuple(f"p{k}" for k in range(len(CUTS)))
    soft = [(1 / (1 + F.exp(3 * (F.col("secondary") - c)))).alias(n) for n, c in zip(names, CUTS)]
    calibration = indicator.calibrate_markov_bayes(f.select("value", *soft), list(CUTS), list(names))
    return indicator.indicator_krige(_targets(s, d, *soft), f, list(CUTS), [INDICATOR], LOW, HIGH, False, NEAR, names, calibration)


@query("c5_loo_cokriging")
def c5a(s, d):
    return cokriging.leave_one_out_cokriging(list(_two(s, d)), LMC, neighbors=kriging.Neighbors(max=8))


@query("c5_loo_collocated")
def c5b(s, d):
    return cokriging.leave_one_out_collocated(field(s, d), EXPO, neighbors=kriging.Neighbors(max=8))


def _loo_ik(s, d):
    f = field(s, d)
    out = indicator.indicator_krige(f, f, list(CUTS), [INDICATOR], LOW, HIGH, neighbors=kriging.Neighbors(max=8), exclude_self=True)
    return out.join(f.select("id", F.col("value").alias("observed")), "id")


@query("c5_loo_indicator")
def c5c(s, d):
    return _loo_ik(s, d).select("id", "observed", "ccdf", "e_type", "cond_var")


@query("c9_accuracy_plot_ccdf")
def c9(s, d):
    return validate.accuracy_plot_ccdf(_loo_ik(s, d), list(CUTS), [0.2, 0.5, 0.8], -3.0, 4.0)


@query("c11_compare_methods")
def c11(s, d):
    f = field(s, d)
    frames = {"ok": kriging.leave_one_out(f, EXPO, neighbors=NEAR), "idw": interpolation.idw_cross_validate(f, 2.0), "knn": interpolation.knn_cross_validate(f, 8), "nn": interpolation.knn_cross_validate(f, 1)}
    out = None
    for name, cv in frames.items():
        row = validate.metrics(cv).select(F.lit(name).alias("method"), "me", "mae", "rmse", "vecv", "e1")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("vecv"))


@query("c12_tune_kriging_neighbors")
def c12c(s, d):
    from .api import tune_kriging_neighbors

    return tune_kriging_neighbors(field(s, d), EXPO, (4, 8, 16))


@query("g1_sgs")
def g1(s, d):
    return simulate.sgs(field(s, d), GRID, EXPO, 8, multigrid=2, lower=LOW, upper=HIGH)


@query("g1_sgs_3d")
def g1b(s, d):
    return simulate.sgs(pts3(s, d), Grid.from_bbox((-0.3,) * 3, (0.3,) * 3, (6, 6, 6)), EXPO, 4)


@query("g4_sis")
def g4(s, d):
    return simulate.sis(field(s, d), GRID, list(CUTS), [INDICATOR], LOW, HIGH, 4, max_neighbors=8)


@query("g5_tgs")
def g5(s, d):
    return simulate.tgs(field(s, d), GRID, EXPO, 10, 4)


@query("v14_realization_qc")
def v14(s, d):
    sims = simulate.sgs(field(s, d), GRID, EXPO, 4).withColumnRenamed("node", "id")
    return variogram.realization_qc(sims, EXPO, LAGS, REACH)


def _arrays(s, d):
    p = kriging.collect_points(field(s, d).select("id", "x", "y", "value"))
    return p["xyz"], p["value"]


@query("x2_vecchia_plan")
def x2(s, d):
    x, _ = _arrays(s, d)
    return vecchia.plan_frame(s, x, 10)


@query("x3_vecchia_loglik")
def x3(s, d):
    x, z = _arrays(s, d)
    return vecchia.loglik_frame(s, x, z, EXPO, vecchia.make_plan(x, 10, spark=s))


@query("x4_vecchia_grouped")
def x4(s, d):
    x, z = _arrays(s, d)
    plan = vecchia.make_plan(x, 10, spark=s)
    return s.createDataFrame([(float(vecchia.loglik_grouped(x, z, EXPO, plan, vecchia.blocks(plan), spark=s)),)], "loglik double")


def _estimate(s, **e):
    rows = [(k, float(v.model.nugget), float(v.model.structures[0].sill), float(v.model.structures[0].range), float(v.loglik)) for k, v in e.items()]
    return s.createDataFrame(rows, "name string, nugget double, sill double, range double, loglik double")


@query("x6_vecchia_mle")
def x6(s, d):
    x, z = _arrays(s, d)
    return _estimate(s, exponential=vecchia.mle(x, z, "exponential", 10, spark=s))


@query("x8_vecchia_reml")
def x8(s, d):
    x, z = _arrays(s, d)
    return _estimate(s, reml=vecchia.reml(x, z, "exponential", 1, 8, spark=s))


@query("x10_vecchia_param_se")
def x10(s, d):
    x, z = _arrays(s, d)
    se = vecchia.param_se(x, z, EXPO, 10, spark=s)
    return s.createDataFrame([(n, None if np.isnan(v) else float(v)) for n, v in zip(("nugget", "sill", "range"), se)], "param string, se double")


@query("x11_vecchia_predict")
def x11(s, d):
    x, z = _arrays(s, d)
    t = np.array([(0.05 * i - 0.4, 0.03 * i - 0.3) for i in range(20)])
    m, v = vecchia.predict(x, z, t, EXPO, 20)
    return s.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(m, v))], "id long, prediction double, variance double")


@query("f5_usable_bins")
def f5(s, d):
    h, g, n = _bins(s, d)
    return s.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(h, g, n)], "h double, gamma double, n_pairs long")


