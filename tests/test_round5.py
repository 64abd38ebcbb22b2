"""Findings of the fourth round: products by far fields, sums over pairs by cells."""

import numpy as np
import pytest

from fieldkrig.functions import farfield
from fieldkrig.functions.models import Anisotropy, Structure, VariogramModel, single
from fieldkrig.queries import EXPO


@pytest.mark.parametrize("model", [EXPO, single("gaussian", 0.9, 0.4, 0.1), VariogramModel(0.1, (Structure("matern32", 0.9, 0.4, None, Anisotropy(30.0, 0.8)),))])
def test_products_by_far_fields(model, monkeypatch):
    monkeypatch.setattr(farfield, "FEWEST", 100)
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(size=(2500, 2)) * 0.12, 3 + 0.01 * g.normal(size=(300, 2)), [[-4.0, 9.0]]])
    t = np.concatenate([x[::40] + [0.013, -0.007], x[:5], [[12.0, -3.0]]])
    both = np.concatenate([x, t])
    far = farfield.chosen(x, model, both.min(axis=0), both.max(axis=0))
    v = np.column_stack([g.normal(size=len(x)), np.ones(len(x))])
    own = v[far.order]
    assert np.allclose(far.at(t, far.up(own), own), model.cov_np(t[:, None] - x[None]) @ v, rtol=0, atol=1e-8)


def test_covariances_that_end_have_no_far_field(monkeypatch):
    monkeypatch.setattr(farfield, "FEWEST", 100)
    x = np.random.default_rng(4).normal(size=(2500, 2)) * 0.12
    assert farfield.chosen(x, single("spherical", 0.9, 0.1, 0.1), x.min(axis=0), x.max(axis=0)) is None


def test_a_global_neighbourhood_meets_few_pairs(spark, monkeypatch):
    """With far fields the products never take all pairs of data (nor of targets and data)."""
    from fieldkrig.operators import globalkriging

    g = np.random.default_rng(8)
    x = g.normal(size=(1500, 2)) * 0.12
    z = np.sin(8 * x[:, 0]) + 0.1 * g.normal(size=1500)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, z))], "id long, x double, y double, value double")
    monkeypatch.setattr(globalkriging, "COLUMNS", None)
    monkeypatch.setattr(farfield, "FEWEST", 100)
    got = globalkriging.krige_global(df.filter("id < 50").selectExpr("id", "x + 0.013 x", "y - 0.007 y"), df, EXPO).collect()
    u, a = np.linalg.solve(EXPO.cov_np(x[:, None] - x[None]), np.column_stack([z, np.ones(1500)])).T
    beta = u.sum() / a.sum()
    want = beta + EXPO.cov_np(x[:50, None] + [0.013, -0.007] - x[None]) @ (u - beta * a)
    assert len(got) == 50 and all(abs(r["prediction"] - want[r["id"]]) < 1e-7 for r in got)


def test_sums_by_cells_meet_few_pairs(spark, monkeypatch):
    """Counts as of all pairs, of which most are not met; equal places, outliers and lags' edges too."""
    from fieldkrig.operators import variogram
    from fieldkrig.plans import cellsums

    g = np.random.default_rng(6)
    x = np.concatenate([g.normal(size=(2400, 2)) * 0.12, np.round(g.normal(size=(590, 2)) * 0.1, 2), g.normal(size=(10, 2)) * 0.6])
    z, c = np.sin(8 * x[:, 0]) + 0.1 * g.normal(size=3000), 5 + g.normal(size=3000)
    df = spark.createDataFrame([(i, *map(float, r), float(v), float(w)) for i, (r, v, w) in enumerate(zip(x, z, c))], "id long, x double, y double, value double, secondary double").repartition(3)
    forms = {
        "plain": lambda: variogram.experimental_variogram(df, 10, 0.3),
        "cutoffs": lambda: variogram.indicator_variograms(df, [-0.2, 0.4], 10, 0.3),
        "two": lambda: variogram.collocated_variograms(df, 10, 0.3),
        "groups": lambda: variogram.grouped_variograms(df.selectExpr("*", "cast(id % 2 as int) r"), "r", 10, 0.3),
    }
    rows = lambda f: sorted(tuple(r) for r in f().collect())
    want = {k: rows(f) for k, f in forms.items()}
    monkeypatch.setattr(cellsums, "FEWEST", 100)
    monkeypatch.setattr(variogram, "sum_pairs", None)
    for k, f in forms.items():
        got = rows(f)
        assert len(got) == len(want[k]) and all(type(a) is type(b) and (a == b if isinstance(a, int) else abs(a - b) < 1e-10) for r, w in zip(got, want[k]) for a, b in zip(r, w)), k
    cells = cellsums.Cells(x, np.column_stack([z]), [(0, 0)], 0.3, 10, 0.3 / 300)
    met = sum(cells.near(a, a + 300)[:, 0].sum() for a in range(0, 3000, 300))
    far = sum(cells.far(t)[:, 0].sum() for t in cells.tiles()) / 2
    assert met + far == sum(r[-1] for r in want["plain"]) and met < far / 5
