"""Golden values and invariants of the spatial engine."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from fieldkrig import errors, queries_models
from fieldkrig.functions import rng, special
from fieldkrig.functions.models import BEST, Anisotropy, Structure, VariogramModel, parse_kind, parse_kinds, single
from fieldkrig.operators import cokriging, fit, indicator, kriging, simulate, transform, vecchia
from fieldkrig.queries import QUERIES
from fieldkrig.sources import gpkg
from fieldkrig.sources.points import Grid, points, read_csv, validate_points

SF = "/root/testdata/sf0.001"
FIVE = np.array([(0, 0), (10, 0), (0, 10), (10, 10), (5, 5)], float), np.array([1.0, 2.0, 1.5, 2.5, 1.8])


def test_power_ordinary_kriging():
    k = kriging.Kriging(*FIVE, np.arange(5), single("power:1.2", 2.0, 1.0), neighbors=kriging.Neighbors())
    v, s, _ = k.predict(np.array([(3, 4), (7, 8), (5, 5)], float))
    assert np.allclose(v, [1.5252052569, 2.1366210000, 1.8], atol=1e-6)
    assert np.allclose(s[:2], [6.4437897810, 7.7780140000], atol=1e-5) and s[2] < 1e-6


def test_rotation():
    m = VariogramModel(0.0, (Structure("spherical", 1.0, 100.0, None, Anisotropy(30, 0.5, 0.3, 20, 40)),))
    d = np.array([(1, 0, 0), (0, 1, 0), (0, 0, 1), (0.577350269190,) * 3, (0.666666666667, -0.666666666667, 0.333333333333), (-0.534522483825, 0.267261241912, 0.801783725737)])
    assert np.allclose(m.gamma_np(20 * d), [0.605458280770632, 0.577390658041395, 0.732990706603906, 0.432164835884142, 0.810043758779196, 0.575462768274161], atol=1e-9)


def test_families():
    h = np.array([1, 10, 30, 50, 80, 100, 150, 200, 300, 500.0])
    want = {
        "circular": [0.01273218, 0.12711143, 0.37616234, 0.60899778, 0.89591196, 1, 1, 1, 1, 1],
        "hole": [1.666658e-05, 1.665834e-03, 1.493264e-02, 4.114892e-02, 1.033049e-01, 1.585290e-01, 3.350033e-01, 5.453513e-01, 9.529600e-01, 1.191785],
        "wave": [0.0001644853, 0.0163683569, 0.1416063087, 0.3633802276, 0.7661276791, 1, 1.2122065908, 1, 1, 1],
        "stable:1.5": [0.0009995002, 0.0311280057, 0.1515267892, 0.2978114987, 0.5110728376, 0.6321205588, 0.8407240915, 0.9408942534, 0.9944621693, 0.9999860543],
    }
    for kind, g in want.items():
        assert np.allclose(single(kind, 1.0, 100.0).gamma_h(h), g, atol=1e-6)
    for a, b in (("matern:1.5", "matern32"), ("matern:2.5", "matern52"), ("matern:0.5", "exponential")):
        scale = 100.0 if b != "exponential" else 100.0
        assert np.allclose(single(a, 1.0, scale).gamma_h(h), single(b, 1.0, scale).gamma_h(h), atol=1e-9)


def test_special_functions():
    for nu, x, want in ((0.5, 1, 0.461068504447895), (1.5, 1, 0.922137008895789), (2.5, 2, 0.3897977588962), (0.3, 5, 0.00372166932887342), (4, 10, 3.7861437160892e-5)):
        assert abs(special.bessel_k(nu, x)[0] / want - 1) < 1e-8
    assert abs(special.gamma_function(4.5) - 11.6317283965674) < 1e-9
    p = np.linspace(0.001, 0.999, 99)
    assert np.abs(special.norm_cdf(special.inv_norm_cdf(p)) - p).max() < 1e-6


def test_model_text():
    assert parse_kind("mat:1.2") == ("matern", 1.2) and parse_kinds("best") == [(k, None) for k in BEST]
    with pytest.raises(errors.InvalidParameter):
        parse_kind("nonsense")
    m = VariogramModel(0.1, (Structure("matern", 1.0, 5.0, 1.2), Structure("spherical", 0.5, 9.0, None, Anisotropy(30, 0.4))))
    assert VariogramModel.from_json(m.to_json()) == m
    for bad in ((-1, 1, 1), (0, -1, 1), (0, 1, 0), (0, 0, 1)):
        with pytest.raises(errors.InvalidParameter):
            VariogramModel(bad[0], (Structure("spherical", bad[1], bad[2]),))


def test_rng_is_reproducible():
    a, b = rng.Rng(7), rng.Rng(7)
    assert [a.next() for _ in range(5)] == [b.next() for _ in range(5)]
    u = [a.uniform() for _ in range(2000)]
    z = [a.normal() for _ in range(2000)]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(z)) < 0.1 and abs(np.std(z) - 1) < 0.1
    assert sorted(np.bincount(rng.fold_of(23, 5, 1)).tolist()) == [4, 4, 5, 5, 5]


@pytest.fixture(scope="module")
def scatter():
    g = np.random.default_rng(11)
    x = g.random((60, 2))
    return x, np.sin(5 * x[:, 0]) + np.cos(4 * x[:, 1]) + 0.1 * g.standard_normal(60)


EXPO = single("exponential", 0.9, 0.4, 0.1)


def test_kriging_against_dense_system(scatter):
    x, z = scatter
    t = np.random.default_rng(3).random((7, 2))
    for method, extra in (("ordinary", 1), ("universal", 3)):
        k = kriging.Kriging(x, z, np.arange(60), EXPO, method, neighbors=kriging.Neighbors())
        v, s, _ = k.predict(t)
        f = k.basis(x)
        a = np.block([[EXPO.cov_np(x[:, None] - x[None]), f], [f.T, np.zeros((extra, extra))]])
        for i in range(7):
            b = np.r_[EXPO.cov_np(t[i] - x), k.basis(t[i : i + 1])[0]]
            w = np.linalg.solve(a, b)
            assert abs(v[i] - w[:60] @ z) < 1e-10 and abs(s[i] - (1.0 - w @ b)) < 1e-10
    exact, var, _ = kriging.Kriging(x, z, np.arange(60), single("exponential", 1, 0.4), neighbors=kriging.Neighbors(max=16)).predict(x)
    assert np.allclose(exact, z) and var.max() < 1e-9


def test_kriging_failures(scatter):
    x, z = scatter
    k = kriging.Kriging(x, z, np.arange(60), EXPO, neighbors=kriging.Neighbors(max=8, radius=0.1, min=3))
    v, _, _ = k.predict(np.array([(9.0, 9.0)]))
    assert np.isnan(v[0])
    with pytest.raises(errors.NoNeighbors):
        k.predict(np.array([(9.0, 9.0)]), strict=True)
    with pytest.raises(errors.DuplicatePoints):
        kriging.Kriging(np.zeros((2, 2)), [1, 2], [0, 1], EXPO)
    with pytest.raises(errors.InvalidParameter):
        kriging.Kriging(np.zeros((1, 3)), [1], [0], single("circular", 1, 1))


def test_block_kriging_is_mean_of_points(scatter):
    x, z = scatter
    k = kriging.Kriging(x, z, np.arange(60), EXPO, neighbors=kriging.Neighbors())
    off = kriging.block_offsets((0.1, 0.1), (3, 3))
    block, _, _ = k.predict(np.array([(0.5, 0.5)]), block=off)
    assert abs(block[0] - k.predict(np.array([0.5, 0.5]) + off)[0].mean()) < 1e-10


def test_octants_and_ties(scatter):
    x, _ = scatter
    index = kriging.Neighbors().index(x, np.arange(60))
    t = np.array([(0.5, 0.5)])
    d = ((x - t) ** 2).sum(axis=1)
    assert index.query(t, 5)[0].tolist() == np.argsort(d, kind="stable")[:5].tolist()
    near = index.query(t, 8, per_sector=2)[0]
    sector = (x[near] >= t[0]) @ np.array([1, 2])
    assert np.bincount(sector, minlength=4).max() <= 2


def test_fits_recover_parameters():
    h = np.linspace(0.05, 1.0, 12)
    for kind in ("spherical", "exponential", "gaussian", "matern32"):
        m = single(kind, 0.8, 0.3, 0.1)
        f = fit.fit_model((h, m.gamma_h(h), np.full(12, 50.0)), kind).model
        assert abs(f.nugget - 0.1) < 1e-5 and abs(f.structures[0].sill - 0.8) < 1e-5 and abs(f.structures[0].range - 0.3) < 1e-5
    best = fit.fit_best((h, single("spherical", 0.8, 0.5, 0.1).gamma_h(h), np.full(12, 50.0)))
    assert best.model.structures[0].kind == "spherical"
    with pytest.raises(errors.InsufficientData):
        fit.fit_model((h[:3], h[:3], h[:3]), "spherical")


def test_cokriging_reduces_to_ordinary(scatter):
    x, z = scatter
    t = np.random.default_rng(5).random((6, 2))
    lmc = cokriging.Lmc(np.diag([0.1, 0.1]), ((Structure("exponential", 1.0, 0.4), np.diag([0.9, 0.9])),))
    data = {"xyz": x, "value": z, "id": np.arange(60)}
    v, s = cokriging.CoKriging([data, data], lmc).predict(t)
    a, b, _ = kriging.Kriging(x, z, np.arange(60), EXPO, neighbors=kriging.Neighbors(max=16)).predict(t)
    assert np.allclose(v, a) and np.allclose(s, b)
    with pytest.raises(errors.InvalidParameter):
        cokriging.Lmc(np.array([[1.0, 2.0], [2.0, 1.0]]), ())


def test_order_relations():
    f = np.random.default_rng(1).normal(0.5, 0.6, (200, 5))
    c = indicator.corrected(f)
    assert (np.diff(c, axis=1) >= -1e-12).all() and c.min() >= 0 and c.max() <= 1


def test_normal_scores_and_tails():
    z = np.array([3.0, 1.0, 2.0, 2.0, 9.0])
    s = transform.NormalScore(z, None, transform.Tail("linear", 0.0), transform.Tail("power", 20.0, 2.0))
    assert np.allclose(s.back(s.forward(z)), z)
    out = s.back(np.array([-5.0, 5.0]))
    assert 0 <= out[0] < 1 and 9 < out[1] <= 20
    one = transform.Tail("power", 20.0, 1.0)
    assert np.allclose(transform.upper_tail(np.array([0.95]), 9.0, 0.9, one), transform.upper_tail(np.array([0.95]), 9.0, 0.9, transform.Tail("linear", 20.0)))
    u = (np.arange(200_000) + 0.5) / 200_000
    for tail in (transform.Tail("linear", 20.0), transform.Tail("power", 20.0, 2.0), transform.Tail("hyperbolic", None, 3.0)):
        v = transform.upper_tail(0.8 + 0.2 * u, 9.0, 0.8, tail)
        m1, m2 = transform.tail_moments(9.0, 0.8, tail, True)
        assert abs(0.2 * v.mean() / m1 - 1) < 1e-2 and abs(0.2 * (v * v).mean() / m2 - 1) < 0.1


def test_vecchia_is_exact_with_all_neighbors(scatter):
    x, z = scatter
    c, r = EXPO.cov_np(x[:, None] - x[None]), z - z.mean()
    exact = -0.5 * (60 * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + r @ np.linalg.solve(c, r))
    plan = vecchia.make_plan(x, 59)
    assert abs(vecchia.loglik(x, z, EXPO, plan) - exact) < 1e-8
    assert abs(vecchia.loglik_grouped(x, z, EXPO, plan, vecchia.blocks(plan)) - exact) < 1e-6
    t = np.random.default_rng(8).random((8, 2))
    m, v = vecchia.predict(x, z, t, EXPO, 100)
    a, b, _ = kriging.Kriging(x, z, np.arange(60), EXPO, "simple", z.mean(), neighbors=kriging.Neighbors()).predict(t)
    assert np.allclose(m, a) and np.allclose(v, b)
    one = np.ones((60, 1))
    inv = np.linalg.inv(c)
    det = (one.T @ inv @ one)[0, 0]
    quad = z @ inv @ z - (one.T @ inv @ z)[0] ** 2 / det
    want = -0.5 * (59 * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + math.log(det) + quad)
    assert abs(vecchia.reml_loglik(x, z, one, EXPO, plan) - want) < 1e-8


def test_vecchia_gradient(scatter):
    x, z = scatter
    plan, theta, e = vecchia.make_plan(x, 10), np.array([0.1, 0.9, 0.4]), 1e-5
    for kind in vecchia.GRADIENTS:
        f = lambda t, kind=kind: vecchia.loglik(x, z, VariogramModel(t[0], (Structure(kind, t[1], t[2]),)), plan)
        want = [(f(theta + e * d) - f(theta - e * d)) / (2 * e) for d in np.eye(3)]
        assert np.allclose(vecchia.loglik_gradient(x, z, kind, theta, plan), want, rtol=1e-4, atol=1e-4)


def test_maxmin_orders_agree(scatter):
    x, _ = scatter
    order = vecchia.maxmin_order(x)
    assert sorted(order.tolist()) == list(range(60))
    for i in range(1, 10):
        d = ((x[:, None] - x[order[:i]][None]) ** 2).sum(-1).min(axis=1)
        assert d[order[i]] == d.max()


def test_buckets_find_the_nearest():
    g = np.random.default_rng(2)
    p = g.random((900, 2))
    b = simulate.Buckets(p.min(axis=0), p.max(axis=0), 900)
    for q in p:
        b.add(q, 0.0)
    for t in g.random((20, 2)):
        got, _ = b.nearest(t, 12, None)
        assert got.tolist() == np.argsort(((p - t) ** 2).sum(axis=1), kind="stable")[:12].tolist()


def test_simulation(spark, scatter):
    x, z = scatter
    data = spark.createDataFrame([(i, float(a), float(b), float(v), int(v > 0)) for i, ((a, b), v) in enumerate(zip(x, z))], "id long, x double, y double, value double, category int")
    grid = Grid.from_bbox((0, 0), (1, 1), (8, 8))
    run = lambda: {(r["realization"], r["node"]): r["value"] for r in simulate.sgs(data, grid, EXPO, 3, multigrid=2).collect()}
    a = run()
    assert a == run() and len(a) == 192 and min(a.values()) >= z.min() - 1e-9 and max(a.values()) <= z.max() + 1e-9
    assert {r["value"] for r in simulate.tgs(data, grid, EXPO, 2, 2).collect()} <= {0, 1}
    with pytest.raises(errors.InvalidParameter):
        simulate.sgs(data, grid, single("power:1", 1, 1))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,v,c\n1,2,3,4\n5,6,bad,7\n8,9,,1\n2,2,2,2\n")
    df, skipped = read_csv(spark, str(tmp_path / "a.csv"), "x", "y", "v")
    assert skipped == 2 and sorted(r["value"] for r in df.collect()) == [2.0, 3.0]
    assert validate_points(df, unique=True) == 2
    with pytest.raises(errors.InvalidParameter, match="there are: x, y, v, c"):
        points(spark.read.csv(str(tmp_path / "a.csv"), header=True), "x", "nope")


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (3.5, -4.0, None)], "x double, y double, v double")
    assert gpkg.write_points(df, path, "pts", 25832) == 2
    assert gpkg.list_layers(path) == [("pts", 25832)]
    back, skipped = gpkg.read_points(spark, path, None, "v")
    assert skipped == 1 and [tuple(r)[1:] for r in back.collect()] == [(1.0, 2.0, 5.0)]
    grid = Grid.from_bbox((0, 0), (4, 3), (4, 3))
    cells = grid.frame(spark).selectExpr("ix", "iy", "case when node = 5 then null else node * 1.5 end as value")
    gpkg.write_raster(cells, grid, path, "ras")
    out, g = gpkg.read_raster(spark, path, "ras")
    got = {(r["ix"], r["iy"]): r["value"] for r in out.collect()}
    assert g == grid and got[1, 1] is None and all(abs(got[i % 4, i // 4] - 1.5 * i) < 1e-3 for i in range(12) if i != 5)
    for junk in (b"", b"GP", b"GP\0\1" + b"\0" * 40, b"x" * 30):
        gpkg.decode_point(junk)
    for junk in (b"", gpkg.PNG_HEAD, gpkg.encode_png(np.zeros((2, 2)))[:-30]):
        with pytest.raises(errors.InvalidParameter):
            gpkg.decode_png(junk)


def test_bucketed_pairs_equal_all_pairs(spark):
    from fieldkrig.plans.pairs import pair_join
    from fieldkrig.queries import pts3

    df = pts3(spark, SF).filter("id < 150")
    near = {(r["a_id"], r["b_id"]) for r in pair_join(df, 0.4).collect()}
    every = {(r["a_id"], r["b_id"]) for r in pair_join(df, None).filter("d <= 0.4").collect()}
    assert near == every and near


def test_stream(spark, tmp_path):
    from fieldkrig.operators.variogram import experimental_variogram
    from fieldkrig.queries import field
    from fieldkrig.streaming.lags import VariogramStream

    df = field(spark, SF).select("id", "x", "y", "value").filter("id < 200")
    sink = VariogramStream(spark, str(tmp_path), 8, 0.3)
    for b in (0, 1, 1, 2):
        sink(df.filter(f"id % 3 = {b}"), b)
    got = {r["lag"]: (r["n_pairs"], round(r["gamma"], 9)) for r in sink.variogram().collect()}
    assert got == {r["lag"]: (r["n_pairs"], round(r["gamma"], 9)) for r in experimental_variogram(df, 8, 0.3).collect()}


ORACLES = ("v1_matheron", "v5_dowd", "v11_variogram_map", "j2_knn_join_rings", "t8_decluster_weights", "k1_ordinary_kriging", "c6_metrics")


@pytest.mark.parametrize("name", ORACLES)
def test_oracles(spark, name):
    from fieldkrig.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_vecchia_queries_take_the_whole_table(spark, tmp_path):
    n = 330
    e = np.random.default_rng(4).uniform(-0.5, 0.5, (n, 4))
    spark.createDataFrame([(i, [float(v) for v in (*e[i], 0, 0, 0)], 0) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, z = queries_models._arrays(spark, str(tmp_path))
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    model, plan = queries_models.EXPO, vecchia.make_plan(x, 10)
    assert len(x) == n and sorted(r[1] for r in run("x2_vecchia_plan")) == list(range(n))
    assert abs(run("x3_vecchia_loglik")[0][0] - vecchia.loglik(x, z, model, plan)) < 1e-8
    assert abs(run("x4_vecchia_grouped")[0][0] - vecchia.loglik_grouped(x, z, model, plan, vecchia.blocks(plan))) < 1e-8
    for name, best in (("x6_vecchia_mle", vecchia.mle(x, z, "exponential", 10)), ("x8_vecchia_reml", vecchia.reml(x, z, "exponential", 1, 8))):
        assert abs(run(name)[0][4] - best.loglik) < 1e-8
    se = [v for _, v in run("x10_vecchia_param_se")]
    assert np.allclose(np.array(se, float), vecchia.param_se(x, z, model, 10), equal_nan=True)
    t = np.array([(0.05 * i - 0.4, 0.03 * i - 0.3) for i in range(20)])
    assert np.allclose([r[1:] for r in run("x11_vecchia_predict")], np.stack(vecchia.predict(x, z, t, model, 20), axis=1))


def test_shuffled_fold_drops_no_point(spark, monkeypatch):
    monkeypatch.setattr(kriging, "MAX_BROADCAST", 12)
    make = lambda n: spark.range(n).selectExpr("id", "id * 1.0D as x", "0.0D as y", "1.0D as value")
    assert kriging.shuffled_fold(make(12), 3).count() == 12
    assert kriging.shuffled_fold(make(13), 3).count() == 13


@pytest.mark.parametrize("name", ["k3_universal_kriging", "k4_external_drift", "k5_power_model", "k10_octant_ellipsoid", "k11_global_neighborhood", "k13_cokriging", "k15_collocated_cokriging", "k15_collocated_mm2", "k17_indicator_kriging", "k20_soft_indicator_kriging", "k21_regression_kriging"])
def test_queries_without_sql_take_all_targets(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_quasi_newton_on_hard_functions():
    from fieldkrig.functions import optim

    rosenbrock = lambda x: 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2
    slope = lambda x: np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])
    for start in ((-1.2, 1.0), (3.0, -2.0), (0.0, 0.0)):
        x, v = optim.bfgs(rosenbrock, slope, np.array(start))
        assert np.allclose(x, 1, atol=1e-5) and v < 1e-10
        x, v = optim.nelder_mead(rosenbrock, np.array(start))
        assert np.allclose(x, 1, atol=1e-4) and v < 1e-8
    quadratic = np.diag([1.0, 50.0, 1e4])
    x, _ = optim.bfgs(lambda x: 0.5 * x @ quadratic @ x, lambda x: quadratic @ x, np.ones(3))
    assert np.abs(x).max() < 1e-6
    x, v = optim.bfgs(lambda x: np.inf if x[0] < 0 else x[0] - np.log(x[0] + 1e-300), lambda x: np.array([1 - 1 / x[0]]), np.array([5.0]))
    assert abs(x[0] - 1) < 1e-5
    assert not np.isfinite(optim.bfgs(lambda x: np.inf, lambda x: x, np.ones(2))[1])


def test_quasi_newton_on_a_likelihood(scatter):
    """As good as the simplex search, from the same starts."""
    from fieldkrig.functions.optim import nelder_mead_multistart

    x, z = scatter
    best = vecchia.mle(x, z, "exponential", 10)
    plan = vecchia.make_plan(x, 10)
    starts, extent = vecchia._vecchia_starts(x, z)
    _, value = nelder_mead_multistart(lambda t: -vecchia.loglik(x, z, vecchia._unpack(t, "exponential"), plan) + vecchia._penalty(t, extent), starts)
    assert best.loglik >= -value - 1e-4


@pytest.mark.parametrize("dim", [2, 3])
def test_neighbor_index_equals_brute_force(dim):
    g = np.random.default_rng(dim)
    p = np.concatenate([g.random((400, dim)), 0.5 + 0.001 * g.random((200, dim)), np.round(g.random((200, dim)), 1)])
    ids = g.permutation(len(p)) * 3
    t = np.concatenate([g.random((60, dim)) * 1.4 - 0.2, p[:40], np.full((3, dim), 9.0)])
    index = kriging.Neighbors().index(p, ids)
    own = np.concatenate([np.full(60, -1), ids[:40], np.full(3, -1)])
    part, target_part = ids % 4, np.arange(len(t)) % 4
    for k, radius, quota, exclude, groups in [(5, None, None, None, None), (32, None, None, own, None), (8, 0.05, None, None, None), (None, 0.1, None, None, None), (12, 0.4, 2, None, None), (6, None, 1, own, None), (7, None, None, None, (part, target_part)), (900, None, None, None, None)]:
        got = index.query(t, k, radius, quota, exclude, groups)
        for i in range(len(t)):
            d2 = ((p - t[i]) ** 2).sum(axis=1)
            ok = np.ones(len(p), bool) if radius is None else d2 <= radius * radius
            if exclude is not None:
                ok &= ids != exclude[i]
            if groups is not None:
                ok &= part != target_part[i]
            near = np.flatnonzero(ok)
            near = near[np.lexsort((ids[near], d2[near]))]
            if quota:
                seen, few = {}, []
                for j in near:
                    s = tuple(p[j] >= t[i])
                    seen[s] = seen.get(s, 0) + 1
                    few += [j] * (seen[s] <= quota)
                near = np.array(few, int)
            assert got[i].tolist() == near[:k].tolist()
    assert kriging.Neighbors(ellipsoid=Anisotropy(30, 0.5, 0.4)).index(p, ids).query(t, 3)[0].size == 3


def test_kriging_beyond_the_broadcast_bound(spark, monkeypatch):
    from fieldkrig.queries import field

    f = field(spark, SF).select("id", "x", "y", "value")
    t = f.limit(40).select("id", (f["x"] + 0.013).alias("x"), "y")
    run = lambda **o: {r["id"]: r[3:] for r in kriging.krige(t, f, EXPO, neighbors=kriging.Neighbors(max=9, radius=0.3), **o).collect()}
    want = run(), run(method="simple", mean=0.2, block=((0.02, 0.02), (2, 2)))
    monkeypatch.setattr(kriging, "MAX_BROADCAST", 50)
    got = run(), run(method="simple", mean=0.2, block=((0.02, 0.02), (2, 2)))
    for a, b in zip(got, want):
        assert a.keys() == b.keys()
        for i in a:
            assert np.allclose(np.array(a[i], float), np.array(b[i], float), equal_nan=True)


class Linear:
    """A user's own covariance: triangular, with a nugget."""

    nugget, has_power = 0.1, False

    def valid_dim(self, dim):
        return dim == 2

    def total_sill(self):
        return 1.0

    def gamma_np(self, dh):
        h = np.sqrt((np.asarray(dh, float) ** 2).sum(axis=-1))
        return np.where(h > 0, 0.1 + 0.9 * np.minimum(h / 50, 1), 0.0)

    def cov_np(self, dh):
        return 1.0 - self.gamma_np(dh)


def test_custom_covariance(spark, scatter):
    from fieldkrig.functions.models import Covariance

    x, z = scatter
    assert isinstance(Linear(), Covariance) and isinstance(EXPO, Covariance) and not isinstance(object(), Covariance)
    a, b, _ = kriging.Kriging(x, z, np.arange(60), Linear(), neighbors=kriging.Neighbors()).predict(x[:3] + 0.01)
    c = Linear().cov_np(x[:, None] - x[None])
    m = np.block([[c, np.ones((60, 1))], [np.ones((1, 60)), np.zeros((1, 1))]])
    rhs = np.r_[Linear().cov_np(x[0] + 0.01 - x), 1]
    w = np.linalg.solve(m, rhs)
    assert abs(a[0] - w[:60] @ z) < 1e-10 and abs(b[0] - (1 - w @ rhs)) < 1e-10
    data = spark.createDataFrame([(i, float(p[0]), float(p[1]), float(v)) for i, (p, v) in enumerate(zip(x, z))], "id long, x double, y double, value double")
    assert kriging.krige(data, data, Linear()).count() == 60
    assert simulate.sgs(data, Grid.from_bbox((0, 0), (1, 1), (3, 3)), Linear(), 1).count() == 9


def test_collocated_and_soft_edges(spark, scatter):
    """Without neighbours the secondary or soft datum gives a regression; wrong forms are refused."""
    x, z = scatter
    data = {"xyz": x, "value": z, "id": np.arange(60)}
    stats = {"rho": 0.6, "mean": 1.0, "std": 2.0, "mean2": 3.0, "std2": 4.0}
    far = np.array([[50.0, 50.0]])
    v, s = cokriging.Collocated(data, EXPO, **stats, neighbors=kriging.Neighbors(max=5, radius=0.1)).predict(far, np.array([7.0]))
    assert np.allclose(v, 1 + 2 * 0.6 * (7 - 3) / 4) and np.allclose(s, 4 * (1 - 0.36))
    for bad in ({"markov": "mm2"}, {"secondary_model": EXPO}, {"rho": 2.0}):
        with pytest.raises(errors.InvalidParameter):
            cokriging.Collocated(data, EXPO, **(stats | bad))
    same = [cokriging.Collocated(data, EXPO, **stats, **o).predict(x[:4] + 0.02, z[:4]) for o in ({}, {"markov": "mm2", "secondary_model": EXPO})]
    assert np.allclose(same[0], same[1])
    soft = indicator.SoftCalibration(0.5, 0.2, 0.4)
    f = indicator.IndicatorKriging(data, [0.3], [single("exponential", 0.2, 0.4)], False, kriging.Neighbors(max=5, radius=0.1), [soft]).predict(far, soft=np.array([[0.6]]))
    share = (z <= 0.3).mean()
    assert np.allclose(f, np.clip(share + 0.5 * np.sqrt(0.2) / 0.2 * (0.6 - 0.4), 0, 1), atol=1e-6)
    with pytest.raises(errors.InvalidParameter):
        indicator.IndicatorKriging(data, [0.3], [EXPO], True, calibration=[soft])


def test_lmc_fit_recovers_and_keeps_own_lags():
    """Curves with other lags, an empty bin in one of them: the sills of a known model come back."""
    truth = [np.array([[0.2, 0.1], [0.1, 0.3]]), np.array([[0.8, -0.3], [-0.3, 0.6]])]
    template = single("spherical", 1.0, 0.5, 0.1)
    g = lambda h, i, j: truth[0][i, j] + truth[1][i, j] * single("spherical", 1.0, 0.5).gamma_h(h)
    lags = [np.linspace(0.05, 0.9, 12), np.linspace(0.03, 0.8, 9), np.delete(np.linspace(0.05, 0.9, 12), 3)]
    curves = [(h, g(h, i, j), np.full(len(h), 40.0 + 3 * i)) for h, (i, j) in zip(lags, ((0, 0), (1, 1), (0, 1)))]
    lmc = cokriging.fit_lmc(*curves, template)
    assert np.allclose(lmc.nugget, truth[0], atol=1e-4) and np.allclose(lmc.structures[0][1], truth[1], atol=1e-4)
    with pytest.raises(errors.InvalidParameter):
        cokriging.fit_lmc(*curves, VariogramModel(0.1, (Structure("spherical", 1, 1, None, Anisotropy(10, 0.5)),)))
    with pytest.raises(errors.InsufficientData):
        cokriging.fit_lmc(curves[0], curves[1], tuple(c[:2] for c in curves[2]), template)


def test_standard_errors_of_any_kind(scatter):
    """Kinds without a gradient take the likelihood's own differences; both ways agree, and a nugget of 0 leaves the others."""
    x, z = scatter
    model = single("exponential", 0.9, 0.4, 0.1)
    a = vecchia.param_se(x, z, model, 10)
    plan, theta = vecchia.make_plan(x, 10), np.array([0.1, 0.9, 0.4])
    step = np.maximum(1e-3 * theta, 1e-5)
    kinds = vecchia.GRADIENTS
    try:
        vecchia.GRADIENTS = ()
        numeric = vecchia._hessian(x, z, "exponential", None, theta, step, [0, 1, 2], plan)
    finally:
        vecchia.GRADIENTS = kinds
    exact = vecchia._hessian(x, z, "exponential", None, theta, step, [0, 1, 2], plan)
    assert np.allclose(numeric, exact, rtol=1e-3, atol=1e-3 * np.abs(exact).max())
    assert a.shape == (3,)
    stable = vecchia.param_se(x, z, single("stable:1.0", 0.9, 0.4, 0.1), 10)
    assert np.allclose(stable, a, rtol=1e-2, equal_nan=True)
    bound = vecchia.param_se(x, z, single("exponential", 0.9, 0.4, 0.0), 10)
    assert np.isnan(bound[0])
    with pytest.raises(errors.InvalidParameter):
        vecchia.param_se(x, z, single("power:1", 1, 1))


def test_plan_blocks_agree(scatter):
    x, _ = scatter
    a, b = vecchia.make_plan(x, 7), vecchia.make_plan(x, 7, block=9)
    assert all((p == q).all() for p, q in zip(a.nbrs, b.nbrs))
    for i, own in enumerate(a.nbrs):
        d = ((x[a.order[:i]] - x[a.order[i]]) ** 2).sum(axis=1)
        assert own.tolist() == sorted(np.argsort(d, kind="stable")[:7].tolist())
    with pytest.raises(errors.InvalidParameter):
        vecchia.make_plan(x, 7, order=np.zeros(60, int))


def test_totals_in_order_use_no_single_task(spark):
    from fieldkrig.queries import lattice

    df = lattice(spark, SF).unionByName(lattice(spark, SF).selectExpr("id + 1000000 id", "x", "y", "value"))
    plan = transform.normal_scores(df)._jdf.queryExecution().executedPlan().toString()
    ranked = [r["value"] for r in df.select("value").orderBy("value").collect()]
    assert transform.quantile_cutoffs(df, [0.0, 0.3, 0.999, 1.0]) == [ranked[min(int(q * len(ranked)), len(ranked) - 1)] for q in (0.0, 0.3, 0.999, 1.0)]
    knots = {r["value"]: r["score"] for r in transform.normal_scores(df).collect()}
    want = transform.NormalScore(ranked)
    assert np.allclose([knots[v] for v in want.z.tolist()], want.y, atol=1e-9)
    assert "_range" in plan
    with pytest.raises(errors.InsufficientData):
        transform.quantile_cutoffs(df.limit(0), [0.5])


def test_scores_forth_and_back(spark):
    """The plan forms against the numpy form: between knots, on them, outside, nulls, with tails."""
    values = [(float(v),) for v in (1, 2, 2, 3, 5, 8, 13)]
    knots = transform.normal_scores(spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id long, value double"))
    numpy_form = transform.NormalScore([v for v, in values], None, transform.Tail("linear", 0.0), transform.Tail("hyperbolic", None, 1.5))
    rows = [0.5, 1.0, 1.5, 2.0, 4.0, 13.0, 99.0]
    out = {r["v"]: r["score"] for r in transform.forward_scores(spark.createDataFrame([(v,) for v in [*rows, None]], "v double"), knots, "v").collect()}
    assert np.allclose([out[v] for v in rows], numpy_form.forward(np.array(rows))) and out[None] is None
    scores = [-4.0, -1.0, 0.0, 0.3, 1.2, 3.0]
    back = {r["score"]: r["value"] for r in transform.back_scores(spark.createDataFrame([(v,) for v in scores], "score double"), knots, transform.Tail("linear", 0.0), transform.Tail("hyperbolic", None, 1.5)).collect()}
    assert np.allclose([back[v] for v in scores], numpy_form.back(np.array(scores)), atol=1e-6)


def test_crowded_cells_are_salted(spark):
    from fieldkrig.plans.pairs import cross_pairs

    g = np.random.default_rng(4)
    rows = lambda n: [(i, float(a), float(b)) for i, (a, b) in enumerate(g.random((n, 2)) * 0.2)]
    left, right = rows(60), rows(50)
    make = lambda r: spark.createDataFrame(r, "id long, x double, y double")
    got = {(r["a_id"], r["b_id"]) for r in cross_pairs(make(left), make(right), 0.1).collect()}
    assert got == {(a[0], b[0]) for a in left for b in right if math.dist(a[1:], b[1:]) <= 0.1}


def test_realizations_reproduce_statistics(spark):
    """Unconditional look: the mean over many realizations far from data is that of the data, and the spread is the sill's."""
    data = spark.createDataFrame([(i, 100.0 + i, 100.0, float(v)) for i, v in enumerate(np.random.default_rng(1).standard_normal(300))], "id long, x double, y double, value double")
    sims = simulate.sgs(data, Grid.from_bbox((0, 0), (4, 4), (4, 4)), single("spherical", 1.0, 3.0), 60, seed=5).toPandas()
    near = sims.pivot(index="realization", columns="node", values="value").to_numpy()
    assert abs(near.mean()) < 0.25 and abs(near.std() - 1) < 0.2
    r = np.corrcoef(near[:, 0], near[:, 1])[0, 1], np.corrcoef(near[:, 0], near[:, 15])[0, 1]
    assert 0.2 < r[0] < 0.8 and abs(r[1]) < 0.35
    cuts = [-0.5, 0.5]
    out = simulate.sis(data, Grid.from_bbox((0, 0), (4, 4), (4, 4)), cuts, [single("spherical", 0.2, 1.0)], transform.Tail("linear", -4.0), transform.Tail("linear", 4.0), 40).toPandas()["value"].to_numpy()
    share = [(np.array([r["value"] for r in data.collect()]) <= c).mean() for c in cuts]
    assert np.allclose([(out <= c).mean() for c in cuts], share, atol=0.1)


def test_realizations_side_by_side(scatter):
    """The same values as one by one, with ties, data on nodes, levels and a radius."""
    x, z = scatter
    x, z = np.round(x[:40], 1), z[:40]
    _, one = np.unique(x, axis=0, return_index=True)
    x, z = x[one], z[one]
    grid = Grid.from_bbox((-0.05, -0.05), (1.05, 1.05), (11, 11))
    nodes = simulate._nodes(grid, 2)
    for radius, levels in ((None, None), (0.15, simulate.grid_levels(grid, 2))):
        for data in ((x, z), (x[:0], z[:0])):
            a = np.array([simulate.gaussian_path(rng.Rng(s), nodes, *data, EXPO, 8, None, radius, levels) for s in (1, 2, 3)])
            b = simulate.gaussian_paths([rng.Rng(s) for s in (1, 2, 3)], nodes, *data, EXPO, 8, radius, levels)
            assert np.allclose(a, b, atol=1e-6)
