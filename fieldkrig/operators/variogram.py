"""Experimental variograms: sums over pairs by lag, from cells where sums of products do (plans/cellsums.py), else from pairs of blocks; pairs become rows in the cloud only."""

from __future__ import annotations

import functools
import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..errors import InvalidParameter
from ..plans.blocks import Pairs, blocks, middle_values, pair_rows, sum_pairs
from ..plans.cellsums import product_sums
from ..sources.points import coords, diagonal

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOWD = 0.674489750196082
#: Groups that are taken one by one at most.
GROUPS = 8
ESTIMATORS = ("matheron", "cressie", "dowd", "madogram")


def default_max_dist(df: DataFrame) -> float:
    """A third of the bounding box's diagonal."""
    return diagonal(df) / 3


def lag_of(d: Column, max_dist: float, n_lags: int) -> Column:
    """Bins are closed on the right."""
    return F.least(F.ceil(d / F.lit(max_dist / n_lags)) - 1, F.lit(n_lags - 1)).cast("int")


def direction(names: list[str], azimuth: float, tolerance: float, dip: float = 0.0) -> Column:
    """True for pairs within the cone, whichever end comes first."""
    if not 0 < tolerance <= 90:
        raise InvalidParameter("the tolerance must lie in (0, 90] degrees")
    az, dp = math.radians(azimuth), math.radians(dip)
    unit = [math.cos(dp) * math.sin(az), math.cos(dp) * math.cos(az), math.sin(dp)]
    dot = sum(((F.col(f"b_{c}") - F.col(f"a_{c}")) * u for c, u in zip(names[1:], unit[1:])), (F.col(f"b_{names[0]}") - F.col(f"a_{names[0]}")) * unit[0])
    return F.abs(dot) >= F.col("d") * math.cos(math.radians(tolerance))


def cone_np(pairs: Pairs, azimuth: float, tolerance: float, dip: float = 0.0) -> np.ndarray:
    """direction() over arrays."""
    if not 0 < tolerance <= 90:
        raise InvalidParameter("the tolerance must lie in (0, 90] degrees")
    az, dp = math.radians(azimuth), math.radians(dip)
    unit = [math.cos(dp) * math.sin(az), math.cos(dp) * math.cos(az), math.sin(dp)]
    return np.abs(sum(x * u for x, u in zip(pairs.diff, unit))) >= pairs.d * math.cos(math.radians(tolerance))


def term_np(estimator: str, dz: np.ndarray) -> np.ndarray:
    """What an estimator averages over a lag's pairs."""
    if estimator == "matheron":
        return 0.5 * dz * dz
    return np.sqrt(np.abs(dz)) if estimator == "cressie" else np.abs(dz)


def gamma_of(estimator: str, mean: Column, n: Column) -> Column:
    """The estimate from the mean of its terms."""
    if estimator == "matheron":
        return mean
    if estimator == "cressie":
        return F.pow(mean, F.lit(4.0)) / (2 * (0.457 + 0.494 / n))
    return 0.5 * mean


def _lags(df: DataFrame, max_dist: float, kernel, columns: tuple[str, ...] = ("value",), within: tuple[str, ...] = ()) -> DataFrame:
    """within, bin, h, mean, n_pairs of kernel(pairs): bins and their terms, given with the distances' sums."""
    packed, _ = blocks(df, max_dist, columns, within)
    found = sum_pairs(packed, columns, kernel, 2, within)
    return found.select(*within, "bin", (F.col("sums")[0] / F.col("n")).alias("h"), (F.col("sums")[1] / F.col("n")).alias("mean"), F.col("n").alias("n_pairs"))


def _filled(binned: DataFrame, n_lags: int, max_dist: float) -> DataFrame:
    """All lags; empty ones have the bin's middle, a null gamma and no pairs."""
    lags = binned.sparkSession.range(n_lags).select(F.col("id").cast("int").alias("lag"))
    middle = (F.col("lag") + 0.5) * (max_dist / n_lags)
    return lags.join(binned, "lag", "left").select("lag", F.coalesce("h", middle).alias("h"), "gamma", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))


def experimental_variogram(df: DataFrame, n_lags: int = 15, max_dist: float | None = None, estimator: str = "matheron", azimuth: float | None = None, tolerance: float = 22.5, dip: float = 0.0) -> DataFrame:
    """lag, h, gamma, n_pairs.  Dowd's medians are exact: found by counting within ranges that shrink, a lag's pairs are never held."""
    max_dist = max_dist or default_max_dist(df)
    if n_lags < 1 or max_dist <= 0:
        raise InvalidParameter("lags and the largest distance must be positive")
    if estimator not in ESTIMATORS:
        raise InvalidParameter(f"unknown estimator {estimator!r}; known: {', '.join(ESTIMATORS)}")
    if azimuth is not None and not 0 < tolerance <= 90:
        raise InvalidParameter("the tolerance must lie in (0, 90] degrees")

    def increments(pairs):
        lag, dz = pairs.lag(max_dist, n_lags), pairs.b["value"] - pairs.a["value"]
        return lag if azimuth is None else np.where(cone_np(pairs, azimuth, tolerance, dip), lag, 0), dz

    def kernel(pairs):
        lag, dz = increments(pairs)
        yield lag, 1, n_lags, 0, [pairs.d, term_np(estimator, dz)]

    found = product_sums(df, max_dist, n_lags, ("value",), [(0, 0)]) if estimator == "matheron" and azimuth is None else None
    if found is None:
        packed, _ = blocks(df, max_dist, ("value",))
        found = sum_pairs(packed, ("value",), kernel, 2)
    binned = found.select(F.col("bin").cast("int").alias("lag"), (F.col("sums")[0] / F.col("n")).alias("h"), gamma_of(estimator, F.col("sums")[1] / F.col("n"), F.col("n")).alias("gamma"), F.col("n").alias("n_pairs"))
    if estimator == "dowd":
        medians = middle_values(packed, ("value",), increments, n_lags)
        rows = [(k, m * m / (2 * DOWD * DOWD)) for k, m in medians.items()]  # one a lag
        binned = binned.drop("gamma").join(df.sparkSession.createDataFrame(rows, "lag int, gamma double"), "lag", "left")
    return _filled(binned, n_lags, max_dist)


def coincident_pairs(df: DataFrame) -> DataFrame:
    """One row: how many pairs share their coordinates (counted by group, without a join)."""
    return df.groupBy(*coords(df)).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0)).cast("long").alias("coincident_pairs"))


def directional_variograms(df: DataFrame, azimuths: list[float], tolerance: float, n_lags: int, max_dist: float) -> DataFrame:
    """azimuth, lag, h, gamma, n_pairs of non-empty bins; one pass over the pairs serves all directions."""

    def kernel(pairs):
        dz = pairs.b["value"] - pairs.a["value"]
        lag, term = pairs.lag(max_dist, n_lags), 0.5 * dz * dz
        for k, azimuth in enumerate(azimuths):
            yield np.where(cone_np(pairs, azimuth, tolerance), lag, 0), 1, n_lags, k * n_lags, [pairs.d, term]

    angle = F.element_at(F.array(*[F.lit(float(a)) for a in azimuths]), (F.floor(F.col("bin") / n_lags) + 1).cast("int"))
    return _lags(df, max_dist, kernel).select(angle.alias("azimuth"), (F.col("bin") % n_lags).cast("int").alias("lag"), "h", F.col("mean").alias("gamma"), "n_pairs")


def grouped_variograms(df: DataFrame, group: str, n_lags: int, max_dist: float) -> DataFrame:
    """group, lag, h, gamma, n_pairs of non-empty bins: realizations or cutoffs in one job."""

    def kernel(pairs):
        dz = pairs.b["value"] - pairs.a["value"]
        yield pairs.lag(max_dist, n_lags), 1, n_lags, 0, [pairs.d, 0.5 * dz * dz]

    some = [r[0] for r in df.select(group).distinct().limit(GROUPS + 1).collect()]
    if len(some) <= GROUPS:  # groups by themselves, where each has points enough
        found = []
        for g in (g for g in some if g is not None):
            own = product_sums(df.filter(F.col(group) == F.lit(g)), max_dist, n_lags, ("value",), [(0, 0)])
            if own is None:
                break
            found.append(own.select(F.lit(g).cast(df.schema[group].dataType).alias(group), F.col("bin").cast("int").alias("lag"), (F.col("sums")[0] / F.col("n")).alias("h"), (F.col("sums")[1] / F.col("n")).alias("gamma"), F.col("n").alias("n_pairs")))
        else:
            if found:
                return functools.reduce(DataFrame.unionAll, found)
    return _lags(df, max_dist, kernel, within=(group,)).select(group, F.col("bin").cast("int").alias("lag"), "h", F.col("mean").alias("gamma"), "n_pairs")


def indicator_variograms(df: DataFrame, cutoffs: list[float], n_lags: int, max_dist: float) -> DataFrame:
    """cutoff, lag, h, gamma, n_pairs of non-empty bins: grouped_variograms of indicators(), from one pass over the pairs, as all cutoffs have the same points."""

    def kernel(pairs):
        terms = []
        for c in cutoffs:
            a, b = (np.where(np.isnan(v), np.nan, v <= c) for v in (pairs.a["value"], pairs.b["value"]))
            terms.append(0.5 * (b - a) ** 2)
        yield pairs.lag(max_dist, n_lags), 1, n_lags, 0, [pairs.d, *terms]

    coded = df.select("id", *coords(df), *[F.when(~F.isnan("value"), (F.col("value") <= F.lit(float(c))).cast("double")).alias(f"_i{k}") for k, c in enumerate(cutoffs)])
    found = product_sums(coded, max_dist, n_lags, tuple(f"_i{k}" for k in range(len(cutoffs))), [(k, k) for k in range(len(cutoffs))])
    if found is None:
        packed, _ = blocks(df, max_dist, ("value",))
        found = sum_pairs(packed, ("value",), kernel, 1 + len(cutoffs))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cutoff"), (F.col("sums")[k + 1] / F.col("n")).alias("gamma")) for k in range(len(cutoffs))]))
    rows = found.select("bin", "n", (F.col("sums")[0] / F.col("n")).alias("h"), each.alias("_c"))
    return rows.select("_c.cutoff", F.col("bin").cast("int").alias("lag"), "h", "_c.gamma", F.col("n").alias("n_pairs"))


def indicators(df: DataFrame, cutoffs: list[float]) -> DataFrame:
    """cutoff (its number) and value = 1 where the value is at most the cutoff, else 0."""
    coded = F.explode(F.array(*[F.struct(F.lit(k).alias("cutoff"), (F.col("value") <= F.lit(float(c))).cast("double").alias("value")) for k, c in enumerate(cutoffs)]))
    kept = [c for c in df.columns if c != "value"]
    return df.select(*kept, coded.alias("_i")).select(*kept, "_i.cutoff", "_i.value")


def variogram_cloud(df: DataFrame, max_dist: float) -> DataFrame:
    """i, j, h, gamma: a row for each pair i < j of ids (integers) with 0 < h <= max_dist; gamma is NULL where a value is."""
    kind = df.schema["id"].dataType
    if not isinstance(kind, IntegralType):
        raise InvalidParameter("ids must be integers")
    # Blocks hold doubles: a 64-bit id goes as two halves.
    columns = ("_high", "_low", "value", "_known")
    finite = [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in coords(df)]
    known = df.filter(functools.reduce(lambda p, q: p & q, finite, F.col("id").isNotNull()))
    halves = known.withColumns({"_high": F.shiftright(F.col("id").cast("long"), 32).cast("double"), "_low": F.col("id").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), "value": F.col("value").cast("double"), "_known": F.col("value").isNotNull().cast("double")})

    def kernel(pairs):
        at, to = np.nonzero((pairs.d > 0) & (pairs.d <= max_dist))
        a, b = {c: v[:, 0] for c, v in pairs.a.items()}, {c: v[0] for c, v in pairs.b.items()}
        p, q = ((s["_high"].astype(np.int64) << 32 | s["_low"].astype(np.int64))[k] for s, k in ((a, at), (b, to)))
        dz, known = b["value"][to] - a["value"][at], (b["_known"] > 0)[to] & (a["_known"] > 0)[at]
        found = [pairs.d[at, to], np.minimum(p, q), np.maximum(p, q), 0.5 * dz * dz, known]
        once = p != q
        return found if once.all() else [c[once] for c in found]

    packed, _ = blocks(halves, max_dist, columns)
    rows = pair_rows(packed, columns, kernel, "h double, i long, j long, gamma double, known boolean")
    return rows.select(F.col("i").cast(kind), F.col("j").cast(kind), "h", F.when(F.col("known"), F.col("gamma")).alias("gamma"))


def correlogram(variogram: DataFrame, variance: float) -> DataFrame:
    return variogram.withColumn("rho", 1 - F.col("gamma") / F.lit(float(variance)))


def cross_variogram(df: DataFrame, n_lags: int, max_dist: float, a: str = "value", b: str = "secondary") -> DataFrame:
    """Half the mean product of both increments; both variables at each point of df."""

    def kernel(pairs):
        yield pairs.lag(max_dist, n_lags), 1, n_lags, 0, [pairs.d, 0.5 * (pairs.a[a] - pairs.b[a]) * (pairs.a[b] - pairs.b[b])]

    binned = _lags(df, max_dist, kernel, tuple(dict.fromkeys((a, b)))).select(F.col("bin").cast("int").alias("lag"), "h", F.col("mean").alias("gamma"), "n_pairs")
    return _filled(binned, n_lags, max_dist)


def collocated_variograms(df: DataFrame, n_lags: int, max_dist: float, a: str = "value", b: str = "secondary") -> DataFrame:
    """lag, h, gamma_a, gamma_b, gamma_ab, n_pairs of non-empty bins: both variables' variograms and their cross variogram from one pass over the pairs."""

    def kernel(pairs):
        da, db = pairs.b[a] - pairs.a[a], pairs.b[b] - pairs.a[b]
        yield pairs.lag(max_dist, n_lags), 1, n_lags, 0, [pairs.d, 0.5 * da * da, 0.5 * db * db, 0.5 * da * db]

    found = product_sums(df, max_dist, n_lags, (a, b), [(0, 0), (1, 1), (0, 1)])
    if found is None:
        packed, _ = blocks(df, max_dist, (a, b))
        found = sum_pairs(packed, (a, b), kernel, 4)
    return found.select(F.col("bin").cast("int").alias("lag"), *[(F.col("sums")[i] / F.col("n")).alias(c) for i, c in enumerate(("h", "gamma_a", "gamma_b", "gamma_ab"))], F.col("n").alias("n_pairs"))


def collocate(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Points that both have, by equal coordinates; of several secondary values the one of the largest id."""
    names = coords(primary)
    last = secondary.groupBy(*names).agg(F.max_by("value", "id").alias("secondary"))
    return primary.join(last, names)


def check_collocated(a: DataFrame, b: DataFrame) -> bool:
    """True if both have the same ids at the same coordinates."""
    names = coords(a)
    other = b.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    met = a.join(other, "id", "full")
    same = F.lit(True)
    for c in names:
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return met.filter(~same).isEmpty()


def default_lag_width(df: DataFrame, n_lags: int) -> float:
    return diagonal(df) / 2 / n_lags


def variogram_map(df: DataFrame, n_lags: int, lag_width: float | None = None) -> DataFrame:
    """ix, iy (from -n_lags to n_lags), hx, hy, gamma, n_pairs; every pair counts for both signs of its lag."""
    w = lag_width or default_lag_width(df, n_lags)
    reach = (n_lags + 0.5) * w * math.sqrt(2)
    k = 2 * n_lags + 1

    def whole(x):  # to the nearest, halves away from 0
        rest = np.abs(x)
        return (np.sign(x) * (np.trunc(rest) + (rest - np.trunc(rest) >= 0.5))).astype(np.int64)

    def kernel(pairs):
        dz = pairs.b["value"] - pairs.a["value"]
        ix, iy = whole(pairs.diff[0] / w), whole(pairs.diff[1] / w)
        hit = (np.abs(ix) <= n_lags) & (np.abs(iy) <= n_lags) & (pairs.d <= reach)
        for sign in (1, -1):
            yield np.where(hit, (sign * ix + n_lags) * k + sign * iy + n_lags + 1, 0), 1, k * k, 0, [0.5 * dz * dz]

    packed, _ = blocks(df, reach, ("value",))
    sums = sum_pairs(packed, ("value",), kernel, 1)
    cells = sums.select((F.floor(F.col("bin") / k) - n_lags).cast("int").alias("ix"), (F.col("bin") % k - n_lags).cast("int").alias("iy"), (F.col("sums")[0] / F.col("n")).alias("gamma"), F.col("n").alias("n_pairs"))
    every = df.sparkSession.range(k * k).select((F.col("id") % k - n_lags).cast("int").alias("ix"), (F.floor(F.col("id") / k) - n_lags).cast("int").alias("iy"))
    return every.join(cells, ["ix", "iy"], "left").select("ix", "iy", (F.col("ix") * w).alias("hx"), (F.col("iy") * w).alias("hy"), "gamma", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))


def realization_qc(sims: DataFrame, model, n_lags: int, max_dist: float) -> DataFrame:
    """Per lag: mean and sample deviation of the realizations' variograms, and the model.  sims: realization, id, x, y, value."""
    each = grouped_variograms(sims, "realization", n_lags, max_dist)
    out = each.groupBy("lag").agg(F.avg("h").alias("h"), F.avg("gamma").alias("mean_gamma"), F.stddev_samp("gamma").alias("std_gamma"), F.count(F.lit(1)).alias("n_realizations"))
    return out.withColumn("model_gamma", model.gamma_col(F.col("h")))


def max_relative_deviation(qc: DataFrame) -> float | None:
    return qc.agg(F.max(F.abs(F.col("mean_gamma") - F.col("model_gamma")) / F.col("model_gamma"))).first()[0]
