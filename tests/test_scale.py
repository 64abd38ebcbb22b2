"""Plans for data of any number hold against the plans for few, and against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldkrig.functions.models import Anisotropy, Structure, VariogramModel
from fieldkrig.operators import cokriging, indicator, kriging, transform, variogram
from fieldkrig.operators.transform import Tail
from fieldkrig.plans import blocks, pairs, tiles

MODEL = VariogramModel(0.1, (Structure("exponential", 1.0, 0.4),))


def clustered(n: int, seed: int = 1, dim: int = 2):
    """Half of the points in a tight cluster, some far outliers."""
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, 1, (n, dim))
    xyz[: n // 2] = 0.3 + 0.004 * rng.standard_normal((n // 2, dim))
    xyz[-3:] += 50
    return xyz, np.sin(5 * xyz[:, 0]) + xyz[:, 1] + 0.05 * rng.standard_normal(n)


def frame(spark, xyz, values, parts: int = 3):
    names = ["x", "y", "z"][: xyz.shape[1]]
    rows = [(i, *map(float, p), float(v), float(v * 0.5 + p[0]), float(np.sin(900 * p[0]) + 1.1)) for i, (p, v) in enumerate(zip(xyz, values))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names) + ", value double, secondary double, c1 double").repartition(parts)


@pytest.fixture()
def small(monkeypatch):
    """Leaves and bounds so small that a few hundred points take the way of many."""
    monkeypatch.setattr(tiles, "LEAF", 8)
    monkeypatch.setattr(tiles, "TILE", 2)
    monkeypatch.setattr(tiles, "TILE_TARGETS", 40)
    return lambda: monkeypatch.setattr(kriging, "MAX_BROADCAST", 100)


def same(a, b, key="id", digits=7):
    a, b = ({r[key]: r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys() and len(a)
    for i, r in a.items():
        for c in r.__fields__:
            x, y = r[c], b[i][c]
            x, y = (v if isinstance(v, list) else [v] for v in (x, y))
            assert all((p is None) == (q is None) and (p is None or math.isclose(p, q, rel_tol=10**-digits, abs_tol=10**-digits)) for p, q in zip(x, y)), (i, c, x, y)


@pytest.mark.parametrize("dim", [2, 3])
@pytest.mark.parametrize("how", [{"k": 5}, {"k": 4, "radius": 0.02}, {"k": 6, "per_sector": 2}, {"k": 3, "exclude_self": True}, {"k": 5, "per_sector": 1, "radius": 0.3, "exclude_self": True}])
def test_neighbors_by_tiles(spark, small, how, dim):
    df = frame(spark, *clustered(300, dim=dim))
    matrix = Anisotropy(30.0, 0.4).matrix(dim)
    for m in (None, matrix):
        few, many = (sorted(map(tuple, pairs.knn_join(df, df, matrix=m, broadcast_points=b, **how).collect())) for b in (1000, 10))
        assert few == many and len(few)


def test_neighbors_of_any_number(spark, small):
    df = frame(spark, *clustered(200))
    assert pairs.knn_join(df, df, 250, broadcast_points=10).count() == 200 * 200
    assert pairs.knn_join(df.limit(0), df, 2, broadcast_points=10).count() == 0


NEAR = kriging.Neighbors(max=8, radius=0.5)


def ways(spark):
    df, targets = frame(spark, *clustered(240)), frame(spark, clustered(150, 2)[0] * 1.01, np.zeros(150))
    octants = kriging.Neighbors(max=6, radius=0.5, per_octant=2, ellipsoid=Anisotropy(30.0, 0.5))
    lmc = cokriging.Lmc(np.array([[0.1, 0.0], [0.0, 0.1]]), ((Structure("exponential", 1.0, 0.4), np.array([[1.0, 0.4], [0.4, 1.0]])),))
    other = df.filter("id % 3 > 0").selectExpr("id", "x + 0.001 x", "y", "secondary value")
    tails = (Tail("linear", -5.0), Tail("linear", 9.0))
    return {
        "ordinary": lambda: kriging.krige(targets, df, MODEL, neighbors=NEAR),
        "simple": lambda: kriging.krige(targets, df, MODEL, method="simple", mean=1.0, neighbors=NEAR),
        "universal": lambda: kriging.krige(targets, df, MODEL, method="universal", degree=1, neighbors=NEAR),
        "drift": lambda: kriging.krige(targets, df, MODEL, covariates=("c1",), method="drift", neighbors=NEAR),
        "errors": lambda: kriging.krige(targets, df.withColumn("e", df.c1 * 0 + 0.2), MODEL, error="e", neighbors=NEAR),
        "octants": lambda: kriging.krige(targets, df, MODEL, neighbors=octants),
        "blocks": lambda: kriging.krige(targets, df, MODEL, block=((0.05, 0.05), (2, 2)), neighbors=NEAR),
        "cokriging": lambda: cokriging.cokrige(targets, [df, other], lmc, neighbors=NEAR),
        "collocated": lambda: cokriging.collocated_cokrige(targets, df, MODEL, neighbors=NEAR),
        "indicator": lambda: indicator.indicator_krige(targets, df, [0.5, 1.2], [MODEL], *tails, neighbors=NEAR),
        "left out": lambda: kriging.leave_one_out(df, MODEL, neighbors=kriging.Neighbors(max=6)),
        "left out, co-kriging": lambda: cokriging.leave_one_out_cokriging([df, other], lmc, neighbors=kriging.Neighbors(max=6)),
        "blocks left out": lambda: kriging.leave_one_out(kriging.block_fold(df, (3, 3)), MODEL, fold="fold", neighbors=kriging.Neighbors(max=6)),
        "folds": lambda: kriging.leave_one_out(kriging.shuffled_fold(df, 4), MODEL, fold="fold", neighbors=kriging.Neighbors(max=6)),
    }


@pytest.mark.parametrize("way", ["ordinary", "simple", "universal", "drift", "errors", "octants", "blocks", "cokriging", "collocated", "indicator", "left out", "left out, co-kriging", "blocks left out", "folds"])
def test_kernels_by_tiles(spark, small, way):
    make = ways(spark)[way]
    few = make()
    few = spark.createDataFrame(few.collect(), few.schema)
    small()
    same(few, make())


def test_folds_are_even(spark):
    df = spark.range(1003).selectExpr("id * 7 id")
    sizes = {r["fold"]: r["count"] for r in kriging.shuffled_fold(df, 10, 5).groupBy("fold").count().collect()}
    assert sorted(sizes) == list(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 1003
    a, b = ([r["fold"] for r in kriging.shuffled_fold(df, 10, s).orderBy("id").collect()] for s in (5, 6))
    assert a != b and a == [r["fold"] for r in kriging.shuffled_fold(df.repartition(7), 10, 5).orderBy("id").collect()]


# Pairs by blocks


def lags(xyz, f, n_lags, reach):
    i, j = np.triu_indices(len(xyz), 1)
    d = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(axis=1))
    ok = (d > 0) & (d <= reach)
    lag = np.minimum(np.ceil(d[ok] / (reach / n_lags)) - 1, n_lags - 1).astype(int)
    return {k: f(i[ok][lag == k], j[ok][lag == k]) for k in np.unique(lag)}


@pytest.mark.parametrize("block, crowded", [(1024, 100_000), (7, 20)])
def test_variograms_by_blocks(spark, monkeypatch, block, crowded):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "CROWDED", crowded)
    xyz, v = clustered(200)
    xyz[5] = xyz[6]
    v = np.round(v, 1)  # ties
    df = frame(spark, xyz, v)
    for name, f in (("matheron", lambda i, j: np.mean(0.5 * (v[i] - v[j]) ** 2)), ("dowd", lambda i, j: np.median(np.abs(v[i] - v[j])) ** 2 / (2 * variogram.DOWD**2))):
        want = lags(xyz, f, 6, 0.4)
        got = {r["lag"]: (r["gamma"], r["n_pairs"]) for r in variogram.experimental_variogram(df, 6, 0.4, name).collect() if r["n_pairs"]}
        assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in want)
        assert {k: n for k, (_, n) in got.items()} == lags(xyz, lambda i, j: len(i), 6, 0.4)


def test_medians_hold_no_values(spark):
    xyz, v = clustered(150)
    plan = variogram.experimental_variogram(frame(spark, xyz, v), 5, 0.4, "dowd")._jdf.queryExecution().toString().lower()
    assert "median" not in plan and "percentile" not in plan


def test_sums_do_not_depend_on_the_order(spark):
    xyz, v = clustered(300)
    a, b = (sorted(map(tuple, variogram.experimental_variogram(frame(spark, xyz, v, p), 6, 0.4).collect())) for p in (1, 5))
    assert a == b


# Ties


@pytest.mark.parametrize("weighted", [False, True])
def test_scores_of_hot_ties(spark, weighted):
    """Half of the values are equal: scores, places and quantiles as in plain order, and no range with twice the mean."""
    rng = np.random.default_rng(4)
    n = 4000
    v = np.maximum(rng.standard_normal(n), 0.0)
    w = rng.uniform(0.5, 2.0, n) if weighted else np.ones(n)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w))], "id long, value double, w double").repartition(4)
    order = np.lexsort((np.arange(n), v))
    p = np.empty(n)
    p[order] = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
    got = {r["value"]: r["score"] for r in transform.normal_scores(df, "w" if weighted else None).collect()}
    from fieldkrig.functions.special import inv_norm_cdf

    s = inv_norm_cdf(p)
    zero = v == 0
    assert len(got) == len(np.unique(v)) and math.isclose(got[0.0], (s[zero] * w[zero]).sum() / w[zero].sum(), rel_tol=1e-6)
    assert transform.quantile_cutoffs(df, [0.1, 0.5, 0.75]) == [float(np.sort(v)[int(q * n)]) for q in (0.1, 0.5, 0.75)]
    knots = transform.normal_scores(df)
    scored = {r["id"]: r["score"] for r in transform.forward_scores(df, knots).collect()}
    table = {r["value"]: r["score"] for r in knots.collect()}
    assert len(scored) == n and all(math.isclose(scored[i], table[x], rel_tol=1e-12) for i, x in enumerate(v))
    ranges = [r["count"] for r in df.withColumn("r", transform._range_of(df, "id")).groupBy("r").count().collect()]
    assert max(ranges) <= 2 * n / len(ranges)


# A global neighbourhood


@pytest.mark.parametrize("options", [{}, {"method": "simple", "mean": 0.7}, {"method": "universal", "degree": 1}, {"method": "drift", "covariates": ("c1",)}, {"error": "e"}, {"block": ((0.05, 0.05), (2, 2))}])
def test_all_data_as_neighbours(spark, monkeypatch, options):
    """Conjugate gradients give what the dense system gives, variances too."""
    from fieldkrig.operators import globalkriging

    xyz, v = clustered(300)
    df, targets = frame(spark, xyz, v).selectExpr("*", "0.1 + c1 * 0 e"), frame(spark, xyz[:40] * 1.02, v[:40])
    few = kriging.krige(targets, df, MODEL, neighbors=kriging.Neighbors(), **options)
    few = spark.createDataFrame(few.collect(), few.schema)
    monkeypatch.setattr(kriging, "MAX_GLOBAL", 100)
    with_variance = kriging.krige(targets, df, MODEL, neighbors=kriging.Neighbors(), variance=True, **options)
    same(few, with_variance, digits=6)
    same(few.drop("variance"), kriging.krige(targets, df, MODEL, neighbors=kriging.Neighbors(), **options).drop("variance"), digits=6)
    assert globalkriging.RESIDUAL <= 1e-8


# Predecessors


@pytest.mark.parametrize("first", [1024, 16])
def test_predecessors(spark, small, monkeypatch, first):
    from fieldkrig.plans import predecessors

    monkeypatch.setattr(predecessors, "FIRST", first)
    xyz, _ = clustered(230)
    xyz[40], xyz[41] = xyz[7], xyz[7]  # equal distances
    order = np.random.default_rng(2).permutation(230)
    p = xyz[order]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "pos long, x double, y double").repartition(3)
    got = {}
    for r in predecessors.predecessor_join(df, 4, 230).collect():
        got.setdefault(r["pos"], {})[r["rank"]] = r["neighbor"]
    for i in range(230):
        d = ((p[:i] - p[i]) ** 2).sum(axis=1)
        assert [got.get(i, {}).get(k) for k in range(1, min(4, i) + 1)] == np.lexsort((np.arange(i), d))[:4].tolist(), i


# Trends, tuning, streams


def test_trend_of_near_dependent_terms(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    x, y = 1e6 + rng.uniform(0, 1000, 500), 1e6 + rng.uniform(0, 1000, 500)
    v = 3 + 1e-3 * (x - 1e6) - 2e-6 * (y - 1e6) ** 2
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, y, v))], "id long, x double, y double, value double").repartition(5)
    terms = transform.polynomial_terms(df, 2)
    got = df.select(((transform.trend_col(transform.ols(df, terms), terms) - F.col("value")) ** 2).alias("e")).agg(F.max("e")).first()[0]
    assert got < 1e-16
    raw = [F.col("x"), F.col("x") + 1e-3 * F.col("y")]  # nearly one column
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(500), x, x + 1e-3 * y]) / [1, 1e6, 1e6], v, rcond=None)
    assert np.allclose(transform.ols(df, raw), want / [1, 1e6, 1e6], rtol=1e-6)
    with pytest.raises(Exception, match="dependent"):
        transform.ols(df, [F.col("x"), F.col("x") * 2])


@pytest.mark.parametrize("options", [{}, {"method": "simple", "mean": 0.4}])
def test_growing_neighbourhoods(spark, small, options):
    """One factor gives what a system for each number of neighbours gives, by either way."""
    df, sizes = frame(spark, *clustered(150)), (1, 2, 5, 16)
    few = kriging.leave_one_out_sizes(df, MODEL, sizes, **options)
    for k in sizes:
        same(kriging.leave_one_out(df, MODEL, neighbors=kriging.Neighbors(max=k), **options), few.filter(f"size = {k}").drop("size"))
    small()
    same(few.filter("size = 5"), kriging.leave_one_out_sizes(df, MODEL, sizes, **options).filter("size = 5"))


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from fieldkrig.streaming.lags import VariogramStream

    df = frame(spark, *clustered(90)).select("id", "x", "y", "value")
    for b in range(3):
        VariogramStream(spark, str(tmp_path), 5, 0.4)(df.filter(f"id % 3 = {b}"), b)  # a new object for each batch
    VariogramStream(spark, str(tmp_path), 5, 0.4)(df.filter("id % 3 = 2"), 2)  # delivered again
    got = {r["lag"]: (r["n_pairs"], r["gamma"]) for r in VariogramStream(spark, str(tmp_path), 5, 0.4).variogram().collect()}
    want = {r["lag"]: (r["n_pairs"], r["gamma"]) for r in variogram.experimental_variogram(df, 5, 0.4).collect() if r["n_pairs"]}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9) for k in want)
    assert VariogramStream(spark, str(tmp_path / "none"), 5, 0.4).variogram().count() == 0


@pytest.mark.parametrize("nu", [0.3, 0.5, 1.2, 2.5, 7.0])
def test_matern_columns(spark, nu):
    from pyspark.sql import functions as F

    from fieldkrig.functions.models import unit_gamma, unit_gamma_col

    h = [0.0, 1e-13, 1e-9, 1e-4, *np.linspace(0.01, 3, 60).tolist(), 30.0, 1e4]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in h], "h double").coalesce(1).select(unit_gamma_col("matern", nu, F.col("h"), 0.3)).collect()]
    assert np.allclose(got, unit_gamma("matern", nu, np.array(h), 0.3), atol=1e-9)
