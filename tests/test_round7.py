"""Findings of the fifth round: variances from all data, whatever their number."""

import numpy as np
import pytest

from fieldkrig.functions import farfield
from fieldkrig.operators import globalkriging, kriging
from fieldkrig.queries import EXPO


def some(spark, n, seed=8):
    """Data dense in the middle, outliers, and a small crowd apart."""
    g = np.random.default_rng(seed)
    x = np.concatenate([g.normal(size=(n - 60, 2)) * 0.12, 0.9 + 0.01 * g.normal(size=(52, 2)), g.normal(size=(8, 2))])
    z = np.sin(8 * x[:, 0]) + 0.1 * g.normal(size=n)
    rows = [(i, *map(float, r), float(v), float(c), 0.05) for i, (r, v, c) in enumerate(zip(x, z, g.normal(size=n)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, value double, c1 double, e double").repartition(3)
    return df, df.filter(f"id % 5 = 0 or id >= {n - 60}").selectExpr("id", "x + 0.013 x", "y - 0.007 y", "c1")


@pytest.mark.parametrize("options", [{}, {"method": "simple", "mean": 0.7}, {"method": "drift", "covariates": ("c1",)}, {"error": "e"}, {"block": ((0.05, 0.05), (2, 2))}])
def test_variances_do_not_hang_on_the_number_of_data(spark, monkeypatch, options):
    df, targets = some(spark, 700)
    few = {r["id"]: r for r in kriging.krige(targets, df, EXPO, neighbors=kriging.Neighbors(), **options).collect()}
    for name, value in (("FIRST", 30), ("LARGEST", 60), ("COARSE", 20), ("GROUP", 32), ("SHARES", 1)):
        monkeypatch.setattr(globalkriging, name, value)
    monkeypatch.setattr(farfield, "FEWEST", 100)
    monkeypatch.setattr(kriging, "MAX_GLOBAL", 100)
    many = kriging.krige(targets, df, EXPO, neighbors=kriging.Neighbors(), **options).collect()
    assert len(many) == len(few) == 188
    for r in many:
        for c in ("prediction", "variance", "lagrange"):
            a, b = r[c], few[r["id"]][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 2e-7), (c, a, b)


def test_what_far_data_add_is_found(spark):
    """Energies of residuals are what variances of some data are too large by, far fields or not."""
    df, targets = some(spark, 600)
    x, t = (np.array([(r["x"], r["y"]) for r in d.orderBy("id").collect()]) for d in (df, targets))
    x = x[np.random.default_rng(3).permutation(600)]
    both = np.concatenate([x, t])
    for rough in (None, farfield.FarField(x, EXPO, both.min(axis=0), float(np.ptp(both, axis=0).max()) * 1.001, 4, 10, None)):
        system = globalkriging.System(x, EXPO, None, None, rough)
        if rough is not None:
            rough.over = [{}, {}] + [{o: farfield._over(EXPO, 10, rough.side / (1 << k), o) for o in farfield.OVER} for k in range(2, 5)]
        system.near, system.weights, system.spread = system.conditionals(0, 600)
        k = np.concatenate([system.covariances(x, x, None)])
        at = system.around(t, 100)
        assert len(at) < 600
        c = system.covariances(t, x, None).T
        w = np.linalg.solve(k[np.ix_(at, at)], c[at])
        short = (c * np.linalg.solve(k, c)).sum(axis=0) - (c[at] * w).sum(axis=0)
        signs = np.random.default_rng(1).choice([-1.0, 1.0], (len(t), globalkriging.SIGNS))
        left = system.residual(t, signs, at, w @ signs, None, True)
        assert np.abs(left - (c @ signs - k[:, at] @ w @ signs)).max() < 1e-5
        each = system.energy(system.residual(t, np.eye(len(t)), at, w, None))
        assert short.max() > 1e-4 and np.abs(each - short).max() < short.max()
        assert 0.3 < system.left(t, at, w, None) / short.sum() < 3


def test_a_variance_that_is_not_asked_for_is_null_at_any_size(spark, monkeypatch):
    df, targets = some(spark, 200)
    for most in (5000, 100):
        monkeypatch.setattr(kriging, "MAX_GLOBAL", most)
        assert kriging.krige(targets, df, EXPO, neighbors=kriging.Neighbors(), variance=False).filter("variance is not null or prediction is null").isEmpty()
