"""Findings of the third round: likelihoods, pair sums, counts and global systems by jobs."""

import numpy as np
import pytest

from fieldkrig.functions.models import Structure, VariogramModel
from fieldkrig.operators import vecchia
from fieldkrig.queries import EXPO


@pytest.fixture
def cloud():
    g = np.random.default_rng(3)
    x = g.normal(size=(700, 2)) * 0.2
    return x, np.sin(8 * x[:, 0]) + np.cos(6 * x[:, 1]) + 0.1 * g.normal(size=700), g.normal(size=700)


def _by_distances_to_all(x):
    order = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    d = ((x - x[order[0]]) ** 2).sum(axis=1)
    left = np.ones(len(x), bool)
    left[order] = False
    while left.any():
        i = int(np.argmax(np.where(left, d, -1)))
        order.append(i)
        left[i] = False
        d = np.minimum(d, ((x - x[i]) ** 2).sum(axis=1))
    return order


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_maxmin_order_looks_at_near_cells_only(dim):
    g = np.random.default_rng(dim)
    x = g.normal(size=(400, dim))
    x = np.concatenate([x, 1e-3 * x[:200] + 5, x[:3], np.full((1, dim), 300.0)])
    assert vecchia.maxmin_order(x).tolist() == _by_distances_to_all(x)


def test_restricted_gradient(cloud):
    x, z, c = cloud
    plan = vecchia.make_plan(x, 8)
    terms = vecchia.Terms(x, np.column_stack([z, np.ones(len(z)), c]), plan)
    f, gradient = vecchia._reml_of(terms, "exponential", None, True)
    at, e = np.array([0.3, -0.2, -0.9]), 1e-5
    want = [(f(at + e * d) - f(at - e * d)) / (2 * e) for d in np.eye(3)]
    assert np.allclose(gradient(at), want, rtol=1e-4, atol=1e-4)
    plain, _ = vecchia._reml_of(terms, "exponential", None, False)
    assert abs(plain(at) - f(at)) < 1e-8


def test_restricted_likelihood_by_gradient_is_as_good_as_by_simplex(cloud, monkeypatch):
    x, z, _ = cloud
    best = vecchia.reml(x, z, "exponential", 1, 8)
    monkeypatch.setattr(vecchia, "GRADIENTS", ())
    assert best.loglik >= vecchia.reml(x, z, "exponential", 1, 8).loglik - 1e-4


def test_terms_by_jobs_equal_terms_here(spark, cloud, monkeypatch):
    x, z, c = cloud
    here = vecchia.make_plan(x, 8)
    zf = np.column_stack([z, np.ones(len(z)), c])
    model = VariogramModel(0.1, (Structure("exponential", 0.9, 0.4),))
    want = vecchia.Terms(x, zf, here).slopes(model)
    grouped = vecchia.loglik_grouped(x, z, EXPO, here, vecchia.blocks(here))
    one = vecchia.reml(x, z, "exponential", m=8, covariates=c)
    se = vecchia.param_se(x, z, model, 8)
    monkeypatch.setattr(vecchia, "LOCAL", 10)
    plan = vecchia.make_plan(x, 8, block=16, spark=spark)
    assert (plan.near == here.near).all()
    rows = vecchia.plan_frame(spark, x, 8).orderBy("pos").collect()
    assert [r["nbrs"] for r in rows] == [n.tolist() for n in here.nbrs] and [r["id"] for r in rows] == here.order.tolist()
    for a, b in zip(vecchia.Terms(x, zf, plan, spark).slopes(model), want):
        assert np.allclose(a, b, rtol=1e-10, atol=1e-8)
    assert abs(vecchia.loglik_grouped(x, z, EXPO, plan, vecchia.blocks(plan), spark=spark) - grouped) < 1e-7
    many = vecchia.reml(x, z, "exponential", m=8, covariates=c, spark=spark)
    assert abs(many.loglik - one.loglik) < 1e-5
    assert np.allclose(vecchia.param_se(x, z, model, 8, spark), se, rtol=1e-4, equal_nan=True)


# Pair sums


def _points(spark, x, v, w):
    rows = [(i, *map(float, p), float(a), float(b)) for i, (p, a, b) in enumerate(zip(x, v, w))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in "xyz"[: x.shape[1]]) + ", value double, secondary double").repartition(3)


def _lagged(x, reach, n):
    i, j = np.triu_indices(len(x), 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
    ok = (d > 0) & (d <= reach)
    return i[ok], j[ok], d[ok], np.minimum(np.ceil(d[ok] / (reach / n)) - 1, n - 1).astype(int)


@pytest.mark.parametrize("values", ["smooth", "two", "far"])
@pytest.mark.parametrize("sampled", [3000, 40])
def test_medians_wherever_they_lie(spark, monkeypatch, cloud, values, sampled):
    """Ranges from a few pairs, right ones and wrong ones, lead to the exact medians, also between two values that lie far apart."""
    from fieldkrig.operators import variogram
    from fieldkrig.plans import blocks

    monkeypatch.setattr(blocks, "SAMPLED", sampled)
    monkeypatch.setattr(blocks, "ENOUGH", 5)
    monkeypatch.setattr(blocks, "ASIDE", 0.001)  # most ranges miss
    monkeypatch.setattr(blocks, "LAST", 50)
    x, z, c = (y[:300] for y in cloud)
    v = {"smooth": z, "two": (z > z.mean()).astype(float), "far": np.exp(8 * c)}[values]
    i, j, _, lag = _lagged(x, 0.4, 6)
    want = [np.median(np.abs(v[i] - v[j])[lag == k]) ** 2 / (2 * variogram.DOWD**2) for k in range(6)]
    got = {r["lag"]: r["gamma"] for r in variogram.experimental_variogram(_points(spark, x, v, c), 6, 0.4, "dowd").collect()}
    assert np.allclose([got[k] for k in range(6)], want, rtol=1e-12, atol=0)


def test_one_pass_serves_cutoffs_and_two_variables(spark, cloud, monkeypatch):
    from fieldkrig.operators import cokriging, variogram

    x, z, c = (y[:300] for y in cloud)
    df = _points(spark, x, z, c)
    each = variogram.grouped_variograms(variogram.indicators(df, [0.2, 1.0]), "cutoff", 6, 0.4)
    once = variogram.indicator_variograms(df, [0.2, 1.0], 6, 0.4)
    a, b = (sorted((r["cutoff"], r["lag"], r["n_pairs"], round(r["h"], 9), round(r["gamma"], 9)) for r in d.collect()) for d in (each, once))
    assert a == b and len(a) == 12
    calls = []
    sums = variogram.sum_pairs
    monkeypatch.setattr(variogram, "sum_pairs", lambda *k, **o: calls.append(1) or sums(*k, **o))
    cokriging.fit_lmc_collocated(df.select("id", "x", "y", "value"), df.select("id", "x", "y", df["secondary"].alias("value")), 6, 0.4, ("spherical",))
    assert len(calls) == 1
    i, j, _, lag = _lagged(x, 0.4, 6)
    for r in variogram.collocated_variograms(df, 6, 0.4).collect():
        own = lag == r["lag"]
        assert r["n_pairs"] == own.sum() and np.isclose(r["gamma_ab"], (0.5 * (z[i] - z[j]) * (c[i] - c[j]))[own].mean())


def test_pairs_are_dealt_to_as_many_tasks_as_set(spark, cloud):
    """Blocks have few bytes for their work, so their size must not merge tasks; and no pair of blocks carries its arrays through a shuffle."""
    from fieldkrig.operators import variogram

    x, z, c = cloud
    out = variogram.experimental_variogram(_points(spark, np.tile(x, (12, 1)) + np.repeat(np.arange(12.0), len(x))[:, None], np.tile(z, 12), np.tile(c, 12)), 6, 0.4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("BroadcastHashJoin") >= 2
