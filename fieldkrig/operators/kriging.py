"""Kriging in its single-variable forms: one kernel, batched over targets.

The conditioning set is broadcast behind a check of its size, targets stream
through ``mapInPandas`` in Arrow batches, and systems of equal size are solved as one
stack.  No shuffle is needed.  Beyond that size the same kernel runs over tiles of targets with the
data around them (plans/tiles.py); all data together (a global neighbourhood) go by blocks (operators/globalkriging.py).
A target whose system fails gives NULL.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicatePoints, InsufficientData, InvalidParameter, NoNeighbors
from ..functions.models import Anisotropy, VariogramModel
from ..functions.permute import permuted_col
from ..plans.lineage import fits, share, shared
from ..plans.places import with_place
from ..plans.pairs import NeighborIndex
from ..plans.tiles import Reach, tile_map
from ..sources.points import bbox, coords, duplicates

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Conditioning points that may be broadcast, and those that a global neighbourhood may have.
MAX_BROADCAST, MAX_GLOBAL = 2_000_000, 5_000


@dataclass(frozen=True)
class Neighbors:
    """max: nearest points used (None: all); per_octant: quota of each sector; min: fewer give NULL; ellipsoid: search in its frame; broadcast: data that may be broadcast (None: MAX_BROADCAST)."""

    max: int | None = None
    radius: float | None = None
    min: int = 1
    per_octant: int | None = None
    ellipsoid: Anisotropy | None = None
    broadcast: int | None = None

    @property
    def bound(self) -> int:
        return MAX_BROADCAST if self.broadcast is None else self.broadcast

    def index(self, xyz: np.ndarray, ids: np.ndarray) -> NeighborIndex:
        return NeighborIndex(xyz, ids, self.matrix(xyz.shape[1]))

    def matrix(self, dim: int) -> np.ndarray | None:
        return None if self.ellipsoid is None else self.ellipsoid.matrix(dim)

    @property
    def everything(self) -> bool:
        return self.max is None and self.radius is None and self.per_octant is None


def solve_stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; a singular one gives NaN."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        out = np.full(b.shape, np.nan)
        for i in range(len(a)):
            try:
                out[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                pass
        return out


def block_offsets(size: tuple[float, ...], n: tuple[int, ...]) -> np.ndarray:
    axes = [((np.arange(k) + 0.5) / k - 0.5) * s for s, k in zip(size, n)]
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=-1)


class Kriging:
    """Method: ``ordinary``, ``simple`` (mean), ``universal`` (degree 1 or 2) or ``drift`` (covariates)."""

    def __init__(self, xyz, values, ids, model: VariogramModel, method: str = "ordinary", mean: float = 0.0, degree: int = 1, covariates=None, errors=None, neighbors: Neighbors = Neighbors(max=32), frame: dict | None = None):
        """frame: what is scaled by all data (of which these are some): low and high coordinates, mean and deviation of covariates."""
        self.xyz, self.values, self.ids = np.asarray(xyz, float), np.asarray(values, float), np.asarray(ids)
        n, dim = self.xyz.shape
        self.model, self.method, self.mean, self.degree, self.neighbors = model, method, mean, degree, neighbors
        if method not in ("ordinary", "simple", "universal", "drift"):
            raise InvalidParameter(f"unknown method {method!r}")
        if not n:
            raise InsufficientData("there are no conditioning points")
        if not model.valid_dim(dim):
            raise InvalidParameter("the circular model is not valid in three dimensions")
        if model.has_power and (method == "simple" or errors is not None):
            raise InvalidParameter("a power model needs an unbiasedness condition and takes no measurement error")
        if len(np.unique(self.xyz + 0.0, axis=0)) < n:
            raise DuplicatePoints("two conditioning points have the same coordinates")
        self.errors = None if errors is None else np.asarray(errors, float)
        low, high = (self.xyz.min(axis=0), self.xyz.max(axis=0)) if frame is None else (frame["low"], frame["high"])
        self.center, self.scale = (low + high) / 2, max((high - low).max() / 2, 1e-300)
        self.covariates = None
        if method == "drift":
            c = np.asarray(covariates, float).reshape(n, -1)
            self.c_mean, self.c_std = (c.mean(axis=0), c.std(axis=0)) if frame is None else (frame["mean"], frame["std"])
            if (self.c_std <= 0).any():
                raise InvalidParameter("a covariate is constant")
            self.covariates = (c - self.c_mean) / self.c_std
        self.everything = neighbors.everything
        self.index = neighbors.index(self.xyz, self.ids)

    def basis(self, xyz: np.ndarray, covariates=None) -> np.ndarray:
        """Drift functions (last axis); simple kriging has none."""
        shape = xyz.shape[:-1]
        if self.method == "simple":
            return np.zeros((*shape, 0))
        terms = [np.ones(shape)]
        if self.method == "universal":
            u = (xyz - self.center) / self.scale
            terms += [u[..., i] for i in range(u.shape[-1])]
            if self.degree >= 2:
                terms += [u[..., i] * u[..., j] for i in range(u.shape[-1]) for j in range(i, u.shape[-1])]
        if self.method == "drift":
            terms += [covariates[..., i] for i in range(covariates.shape[-1])]
        return np.stack(terms, axis=-1)

    def _kernel(self, dh: np.ndarray) -> np.ndarray:
        return -self.model.gamma_np(dh) if self.model.has_power else self.model.cov_np(dh)

    def predict(self, targets, covariates=None, exclude=None, groups=None, block: np.ndarray | None = None, strict: bool = False, lists: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """value, variance, Lagrange multiplier of each target; NaN on failure (raised if strict).  lists: neighbours of each target that are known already."""
        targets = np.asarray(targets, float)
        m = len(targets)
        value, variance, lagrange = (np.full(m, np.nan) for _ in range(3))
        if block is not None and (self.method not in ("simple", "ordinary") or self.model.has_power):
            raise InvalidParameter("block kriging takes simple or ordinary kriging and a bounded model")
        if self.method == "drift":
            covariates = (np.asarray(covariates, float).reshape(m, -1) - self.c_mean) / self.c_std
        if lists is not None:
            pass
        elif self.everything and exclude is None and groups is None:
            lists = [np.arange(len(self.xyz))] * m
        else:
            lists = self.index.query(targets, self.neighbors.max, self.neighbors.radius, self.neighbors.per_octant, exclude, groups)
        sizes = np.array([len(x) for x in lists])
        terms = self.basis(self.xyz[:1], None if self.covariates is None else self.covariates[:1]).shape[-1]
        for k in np.unique(sizes):
            at = np.flatnonzero(sizes == k)
            if k < max(1, self.neighbors.min):
                if strict:
                    raise NoNeighbors(f"{k} neighbours, {self.neighbors.min} needed")
                continue
            if k < terms:
                if strict:
                    raise InsufficientData(f"{k} neighbours for {terms} drift terms")
                continue
            step = max(1, 2_000_000 // ((k + terms) ** 2))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                value[some], variance[some], lagrange[some] = self._solve(targets[some], None if covariates is None else covariates[some], np.stack([lists[i] for i in some]), block, terms)
        return value, variance, lagrange

    def predict_sizes(self, targets, sizes: list[int], exclude=None) -> tuple[np.ndarray, np.ndarray]:
        """(values, variances), a column for each number of nearest neighbours; NaN where a target has too few of them for its minimum.

        One search at the largest number and one Cholesky factor: the factor of the first j neighbours is its
        leading block, so running sums over the solutions give the estimate of every number on the way.  Simple or ordinary kriging of a bounded model.
        """
        if self.method not in ("simple", "ordinary") or self.model.has_power:
            raise InvalidParameter("growing neighbourhoods take simple or ordinary kriging and a bounded model")
        targets, near = np.asarray(targets, float), self.neighbors
        lists = self.index.query(targets, max(sizes), near.radius, near.per_octant, exclude)
        value, variance = (np.full((len(targets), len(sizes)), np.nan) for _ in range(2))
        counts = np.array([len(x) for x in lists])
        for k in np.unique(counts):
            if k < max(1, near.min):
                continue
            at = np.flatnonzero(counts == k)
            for lo in range(0, len(at), max(1, 2_000_000 // (k * k))):
                some = at[lo : lo + max(1, 2_000_000 // (k * k))]
                q = np.stack([lists[i] for i in some])
                xyz = self.xyz[q]
                a = self._kernel(xyz[:, :, None, :] - xyz[:, None, :, :])
                if self.errors is not None:
                    a[:, np.arange(k), np.arange(k)] += self.errors[q]
                z = self.values[q] - (self.mean if self.method == "simple" else 0.0)
                right = np.stack([self._kernel(targets[some][:, None, :] - xyz), np.ones(q.shape), z], axis=-1)
                c, one, u = np.moveaxis(np.linalg.solve(np.linalg.cholesky(a), right), -1, 0)
                cu, cc = np.cumsum(c * u, axis=1), np.cumsum(c * c, axis=1)
                if self.method == "simple":
                    v, s = self.mean + cu, self.model.total_sill() - cc
                else:
                    co, oo, ou = np.cumsum(c * one, axis=1), np.cumsum(one * one, axis=1), np.cumsum(one * u, axis=1)
                    v, s = cu + ou / oo * (1 - co), self.model.total_sill() - cc + (1 - co) ** 2 / oo
                for j, size in enumerate(sizes):
                    if min(size, k) >= max(1, near.min):
                        value[some, j], variance[some, j] = v[:, min(size, k) - 1], np.maximum(s[:, min(size, k) - 1], 0.0)
        return value, variance

    def _solve(self, targets, covariates, near, block, terms):
        m, k = near.shape
        xyz = self.xyz[near]
        shared = self.everything and m > 1 and (near == near[:1]).all()
        own = xyz[:1] if shared else xyz
        rows = len(own)
        a = np.zeros((rows, k + terms, k + terms))
        a[:, :k, :k] = self._kernel(own[:, :, None, :] - own[:, None, :, :])
        if self.errors is not None:
            a[:, np.arange(k), np.arange(k)] += self.errors[near[:rows]]
        f = self.basis(own, None if self.covariates is None else self.covariates[near[:rows]])
        a[:, :k, k:], a[:, k:, :k] = f, f.transpose(0, 2, 1)
        b = np.zeros((m, k + terms))
        if block is None:
            b[:, :k] = self._kernel(targets[:, None, :] - xyz)
        else:
            b[:, :k] = self._kernel(targets[:, None, None, :] + block[None, None, :, :] - xyz[:, :, None, :]).mean(axis=2)
        b[:, k:] = self.basis(targets, covariates)
        if shared:  # one factorisation for all targets
            try:
                w = np.linalg.solve(a[0], b.T).T
            except np.linalg.LinAlgError:
                w = np.full(b.shape, np.nan)
        else:
            w = solve_stack(a, b[..., None])[..., 0]
        z = self.values[near]
        value = (w[:, :k] * z).sum(axis=1)
        if self.method == "simple":
            value = self.mean + (w[:, :k] * (z - self.mean)).sum(axis=1)
        spread = (w * b).sum(axis=1)
        if self.model.has_power:
            variance = -spread
        elif block is None:
            variance = self.model.total_sill() - spread
        else:  # covariance within the block; equal points of the discretisation don't take the nugget
            dh = block[:, None, :] - block[None, :, :]
            within = self.model.cov_np(dh)
            within[(dh == 0).all(axis=-1)] -= self.model.nugget
            variance = within.mean() - spread
        return value, np.maximum(variance, 0.0), w[:, k] if terms else np.full(m, np.nan)


def collect_points(data: DataFrame, extras: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """The conditioning set as arrays in id order, behind a check of its size."""
    names = coords(data)
    held = data.select("id", *names, *(["value"] if "value" in data.columns else []), *extras).limit(MAX_BROADCAST + 1).toPandas()
    if len(held) > MAX_BROADCAST:
        raise InvalidParameter(f"more than {MAX_BROADCAST} conditioning points; krige by region")
    held = held.sort_values("id", kind="stable")
    return {"xyz": held[names].to_numpy(float), "id": held["id"].to_numpy(), **{c: held[c].to_numpy(float) for c in held.columns if c not in ("id", *names)}}


def build(data: DataFrame, model: VariogramModel, covariates: tuple[str, ...] = (), error: str | None = None, **options) -> Kriging:
    p = collect_points(data, tuple(dict.fromkeys((*covariates, *([error] if error else [])))))
    if "neighbors" in options and options["neighbors"].everything and len(p["id"]) > MAX_GLOBAL:
        raise InvalidParameter(f"a global neighbourhood takes at most {MAX_GLOBAL} points here")
    return _engine(p, model, covariates, error, **options)


def _engine(p: dict, model: VariogramModel, covariates: tuple[str, ...], error: str | None, **options) -> Kriging:
    return Kriging(p["xyz"], p["value"], p["id"], model, covariates=np.stack([p[c] for c in covariates], axis=-1) if covariates else None, errors=p[error] if error else None, **options)


def frame_of(data: DataFrame, covariates: tuple[str, ...]) -> dict:
    """What an engine that holds some of the data must know of all."""
    if not duplicates(data).isEmpty():
        raise DuplicatePoints("two conditioning points have the same coordinates")
    box, names = bbox(data), coords(data)
    out = {"low": np.array([box[f"min_{c}"] for c in names]), "high": np.array([box[f"max_{c}"] for c in names])}
    if covariates:
        row = data.agg(*[f(c).alias(f"{n}_{c}") for c in covariates for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        out |= {"mean": np.array([row[f"m_{c}"] for c in covariates]), "std": np.array([row[f"s_{c}"] for c in covariates])}
    return out


def arrays_of(held: pd.DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    held = held.sort_values("id", kind="stable")
    return {"xyz": held[names].to_numpy(float), "id": held["id"].to_numpy(), **{c: held[c].to_numpy() if c == "_fold" else held[c].to_numpy(float) for c in held.columns if c not in ("id", *names)}}


def near_map(targets: DataFrame, data: list[DataFrame], names: list[str], neighbors: Neighbors, make, step, schema: str, spare: int = 0, group: str | None = None) -> DataFrame:
    """step(make([arrays of each data set]), targets) over all targets: with all data broadcast if they fit, else by tiles.

    make's second argument is True where the arrays are some of the data only.  step gets None for an engine where a tile has no data of the first set.
    """
    if all(fits(d, neighbors.bound) for d in data):
        held = share(targets.sparkSession, make([arrays_of(d.toPandas(), names) for d in data], False))
        return targets.mapInPandas(lambda batches: (step(engine, b) for engine in [shared(held)] for b in batches), schema)

    def kernel(own: pd.DataFrame, around: list[pd.DataFrame]) -> pd.DataFrame:
        engine = make([arrays_of(d, names) for d in around], True) if len(around[0]) else None
        return pd.concat([step(engine, own.iloc[lo : lo + 5_000]) for lo in range(0, len(own), 5_000)])

    reach = Reach(neighbors.max, neighbors.radius, neighbors.per_octant, neighbors.matrix(len(names)), spare, group)
    return tile_map(targets, data, names, reach, kernel, schema)


def krige(targets: DataFrame, data: DataFrame, model: VariogramModel, covariates: tuple[str, ...] = (), error: str | None = None, block: tuple[tuple[float, ...], tuple[int, ...]] | None = None, key: str = "id", variance: bool = True, **options) -> DataFrame:
    """key, x, y[, z], prediction, variance (NULL where it isn't asked for), lagrange, whatever the number of data.  options: see Kriging."""
    names = coords(data)
    offsets = None if block is None else block_offsets(*block)
    schema = f"{key} long, {', '.join(f'{c} double' for c in names)}, prediction double, variance double, lagrange double"
    near = options.get("neighbors", Neighbors(max=32))
    if near.everything and not fits(data, MAX_GLOBAL):
        from .globalkriging import krige_global

        return krige_global(targets, data, model, covariates, error, offsets, key, variance, **{k: v for k, v in options.items() if k != "neighbors"})
    known = data.select("id", *names, "value", *dict.fromkeys((*covariates, *([error] if error else []))))
    frame = None if fits(data, near.bound) else frame_of(data, covariates)

    def make(p, some):
        return _engine(p[0], model, covariates, error, frame=frame, **options)

    def step(engine, b):
        v = s = g = np.full(len(b), np.nan)
        if engine is not None:
            v, s, g = engine.predict(b[names].to_numpy(float), b[list(covariates)].to_numpy(float) if covariates else None, block=offsets)
        return pd.DataFrame({key: b[key], **{c: b[c] for c in names}, "prediction": v, "variance": s if variance else np.nan, "lagrange": g})

    return nulls(near_map(targets.select(key, *names, *covariates), [known], names, near, make, step, schema), "prediction", "variance", "lagrange")


def nulls(df: DataFrame, *columns: str) -> DataFrame:
    """NaN to NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def krige_grid(grid, data: DataFrame, model: VariogramModel, **options) -> DataFrame:
    return krige(grid.frame(data.sparkSession), data, model, key="node", **options)


def lognormal_kriging(targets: DataFrame, data: DataFrame, model: VariogramModel, method: str = "ordinary", **options) -> DataFrame:
    """On logarithms; back with half the variance and, in ordinary kriging, less the Lagrange multiplier.  log_variance stays in log space."""
    if model.has_power:
        raise InvalidParameter("lognormal kriging takes a bounded model")
    if not data.filter("value <= 0").isEmpty():
        raise InvalidParameter("values must be positive")
    logs = krige(targets, data.withColumn("value", F.ln("value")), model, method=method, **options)
    shift = F.col("prediction") + F.col("variance") / 2 - (F.col("lagrange") if method == "ordinary" else F.lit(0.0))
    back = F.exp(shift)
    return logs.select("*", F.when(back < float("inf"), back).alias("estimate")).withColumnRenamed("variance", "log_variance")


def regression_kriging(targets: DataFrame, data: DataFrame, model: VariogramModel, trend: str = "trend", **options) -> DataFrame:
    """Ordinary kriging of value - trend; the targets' trend is added back.  Both frames carry the trend column."""
    names = coords(data)
    rest = data.withColumn("value", F.col("value") - F.col(trend))
    out = krige(targets, rest, model, **options).join(targets.select("id", trend), "id")
    return out.select("id", *names, (F.col("prediction") + F.col(trend)).alias("prediction"), "variance")


def leave_one_out(data: DataFrame, model: VariogramModel, covariates: tuple[str, ...] = (), error: str | None = None, fold: str | None = None, **options) -> DataFrame:
    """id, observed, predicted, variance: every point from the others, or from the other folds."""
    return _left_out(data, model, covariates, error, fold, lambda v, s, g: (v, s), **options)


def _left_out(data: DataFrame, model: VariogramModel, covariates, error, fold, back, **options) -> DataFrame:
    names, near = coords(data), options.get("neighbors", Neighbors(max=32))
    if fits(data, 2):
        raise InsufficientData("cross-validation needs three points")
    if near.everything and not fits(data, MAX_GLOBAL):
        raise InvalidParameter(f"cross-validation in a global neighbourhood takes at most {MAX_GLOBAL} points")
    rows = data.select("id", *names, "value", *dict.fromkeys((*covariates, *([error] if error else []))), *([F.col(fold).alias("_fold")] if fold else []))
    frame = None if fits(data, near.bound) else frame_of(data, covariates)

    def make(p, some):
        return _engine(p[0], model, covariates, error, frame=frame, **options), p[0].get("_fold")

    def step(held, b):
        if held is None:
            raise NoNeighbors("no neighbours")
        engine, folds = held
        groups = None if folds is None else (folds, b["_fold"].to_numpy())
        v, s = back(*engine.predict(b[names].to_numpy(float), b[list(covariates)].to_numpy(float) if covariates else None, exclude=None if fold else b["id"].to_numpy(), groups=groups, strict=True))
        return pd.DataFrame({"id": b["id"], "observed": b["value"], "predicted": v, "variance": s})

    return nulls(near_map(rows, [rows], names, near, make, step, "id long, observed double, predicted double, variance double", 0 if fold else 1, "_fold" if fold else None), "predicted", "variance")


def leave_one_out_sizes(data: DataFrame, model: VariogramModel, sizes: tuple[int, ...], **options) -> DataFrame:
    """id, observed, size, predicted, variance: leave_one_out for each number of neighbours, in one job with one search and one factor a point."""
    names, near = coords(data), options.pop("neighbors", Neighbors())
    if fits(data, 2):
        raise InsufficientData("cross-validation needs three points")
    if not sizes or min(sizes) < 1:
        raise InvalidParameter("numbers of neighbours must be positive")
    near = replace(near, max=max(sizes))
    rows = data.select("id", *names, "value")
    frame = None if fits(data, near.bound) else frame_of(data, ())

    def make(p, some):
        return _engine(p[0], model, (), None, frame=frame, neighbors=near, **options)

    def step(engine, b):
        if engine is None:
            raise NoNeighbors("no neighbours")
        v, s = engine.predict_sizes(b[names].to_numpy(float), list(sizes), b["id"].to_numpy())
        n = len(sizes)
        return pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "observed": np.repeat(b["value"].to_numpy(), n), "size": np.tile(np.array(sizes, np.int32), len(b)), "predicted": v.ravel(), "variance": s.ravel()})

    return nulls(near_map(rows, [rows], names, near, make, step, "id long, observed double, size int, predicted double, variance double", 1), "predicted", "variance")


def leave_one_out_lognormal(data: DataFrame, model: VariogramModel, method: str = "ordinary", **options) -> DataFrame:
    """On the original scale; the variance is back-transformed: estimate**2 (exp(log variance) - 1)."""

    def back(v, s, g):
        e = np.exp(v + s / 2 - (g if method == "ordinary" else 0.0))
        return e, e * e * np.expm1(s)

    out = _left_out(data.withColumn("value", F.ln("value")), model, (), None, None, back, method=method, **options)
    return out.drop("observed").join(data.select("id", F.col("value").alias("observed")), "id").select("id", "observed", "predicted", "variance")


def block_fold(data: DataFrame, n: tuple[int, ...]) -> DataFrame:
    """data plus ``fold``: the block of an even division of the bounding box, first axis fastest."""
    b, out, step = bbox(data), F.lit(0), 1
    for c, k in zip(coords(data), n):
        width = max(b[f"max_{c}"] - b[f"min_{c}"], 1e-300) / k
        out = out + F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor((F.col(c) - b[f"min_{c}"]) / width))) * step
        step *= k
    return data.withColumn("fold", out.cast("int"))


def shuffled_fold(data: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """data plus ``fold``: a seeded permutation of the points' places in order of id, then every k-th place; sizes differ by at most one."""
    if k < 2:
        raise InvalidParameter("at least two folds are needed")
    placed, n = with_place(data, "id", "_place")
    return placed.withColumn("fold", (permuted_col(F.col("_place"), n, seed) % k).cast("int")).drop("_place")
