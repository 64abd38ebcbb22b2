"""Several variables: linear model of coregionalization, ordinary and collocated co-kriging."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientData, InvalidParameter
from ..functions.models import Anisotropy, Structure, VariogramModel, unit_gamma
from ..sources.points import coords
from . import fit as fitting
from . import variogram as vg
from .kriging import Neighbors, block_offsets, near_map, nulls, solve_stack

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _psd(m: np.ndarray) -> bool:
    return bool(np.allclose(m, m.T, atol=1e-10) and np.linalg.eigvalsh(m).min() >= -1e-9 * max(1.0, np.abs(m).max()))


def project_psd(m: np.ndarray) -> np.ndarray:
    """The nearest positive semidefinite matrix (negative eigenvalues to 0)."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    return v @ np.diag(np.maximum(w, 0)) @ v.T


@dataclass(frozen=True)
class Lmc:
    """nugget matrix and structures (kind, range, param, anisotropy, sill matrix); all matrices must be positive semidefinite."""

    nugget: np.ndarray
    structures: tuple[tuple[Structure, np.ndarray], ...]

    def __post_init__(self):
        p = len(self.nugget)
        for m in (self.nugget, *(b for _, b in self.structures)):
            if np.shape(m) != (p, p) or not _psd(np.asarray(m)):
                raise InvalidParameter("sill matrices must be symmetric and positive semidefinite, of one size")
        for s, _ in self.structures:
            if s.kind == "power":
                raise InvalidParameter("a coregionalization takes no power model")
            if s.anis and max(s.anis.ratio, s.anis.ratio_z) > 1:
                raise InvalidParameter("anisotropy ratios of a coregionalization are at most 1")

    @property
    def sills(self) -> np.ndarray:
        return np.asarray(self.nugget) + sum(np.asarray(b) for _, b in self.structures)

    def cov(self, dh: np.ndarray, i, j) -> np.ndarray:
        """Covariance of variables i and j at lag vectors (arrays of one shape)."""
        dh = np.asarray(dh, float)
        plain = np.sqrt((dh * dh).sum(axis=-1))
        out = np.where(plain == 0, np.asarray(self.nugget)[i, j], 0.0)
        for s, b in self.structures:
            h = plain if s.anis is None else np.sqrt(((dh @ s.anis.matrix(dh.shape[-1]).T) ** 2).sum(axis=-1))
            out = out + np.asarray(b)[i, j] * (1 - unit_gamma(s.kind, s.param, h, s.range))
        return out

    def direct(self, i: int) -> VariogramModel:
        return VariogramModel(float(self.nugget[i][i]), tuple(Structure(s.kind, float(b[i][i]), s.range, s.param, s.anis) for s, b in self.structures))

    def to_json(self) -> str:
        one = lambda s: json.loads(VariogramModel(0.0, (Structure(s.kind, 1.0, s.range, s.param, s.anis),)).to_json())["structures"][0]
        return json.dumps({"nugget": np.asarray(self.nugget).tolist(), "structures": [{k: v for k, v in one(s).items() if k != "sill"} | {"sills": np.asarray(b).tolist()} for s, b in self.structures]})

    @classmethod
    def from_json(cls, text: str) -> Lmc:
        raw = json.loads(text)
        out = []
        for s in raw["structures"]:
            kind, param = (s["kind"], None) if isinstance(s["kind"], str) else next(iter(s["kind"].items()))
            out.append((Structure(kind, 1.0, float(s["range"]), param, Anisotropy(**s["anis"]) if s.get("anis") else None), np.array(s["sills"], float)))
        return cls(np.array(raw["nugget"], float), tuple(out))


@dataclass(frozen=True)
class _Curve:
    """One experimental curve: values, weights, and the unit structures (nugget first) at its own lags."""

    gamma: np.ndarray
    weight: np.ndarray
    shapes: np.ndarray

    @classmethod
    def of(cls, ev, template: VariogramModel) -> _Curve:
        h, g, n = fitting.usable(ev) if isinstance(ev, DataFrame) else (np.asarray(x, float) for x in ev)
        ok = (n > 0) & (h > 0) & np.isfinite(g)
        h, g, n = h[ok], g[ok], n[ok]
        if len(h) < len(template.structures) + 2:
            raise InsufficientData("a coregionalization needs more bins with pairs than structures")
        return cls(g, n / (h * h), np.stack([np.ones_like(h), *(unit_gamma(s.kind, s.param, h, s.range) for s in template.structures)]))

    def least_squares(self) -> np.ndarray:
        a = (self.shapes * self.weight) @ self.shapes.T
        a[np.diag_indices_from(a)] += 1e-9 * max(a.diagonal().max(), np.finfo(float).tiny)
        return np.linalg.solve(a, self.shapes @ (self.weight * self.gamma))

    def best_sill(self, k: int, sills: np.ndarray) -> float:
        """The sill of structure k given all others."""
        rest = self.gamma - np.delete(sills, k) @ np.delete(self.shapes, k, axis=0)
        own = self.weight * self.shapes[k]
        total = own @ self.shapes[k]
        return float(own @ rest / total) if total > 0 else 0.0

    def loss(self, sills: np.ndarray) -> float:
        left = self.gamma - sills @ self.shapes
        return float(self.weight @ (left * left))


def fit_lmc(direct_a, direct_b, cross, template: VariogramModel, rounds: int = 100) -> Lmc:
    """Sill matrices of two variables for the template's structures (isotropic): each in turn by weighted least squares and projection.

    Every curve keeps its own lags and weights; the cross curve counts twice, as its entry does in the
    matrix.  A round that makes the sum of squares worse is not taken.
    """
    if any(s.anis for s in template.structures):
        raise InvalidParameter("a coregionalization is fitted to isotropic structures")
    curves = {(0, 0): _Curve.of(direct_a, template), (1, 1): _Curve.of(direct_b, template), (0, 1): _Curve.of(cross, template)}

    def joined(entries: dict) -> np.ndarray:
        a, b, c = (entries[e] for e in ((0, 0), (1, 1), (0, 1)))
        return project_psd(np.array([[max(a, 0.0), c], [c, max(b, 0.0)]]))

    alone = {e: c.least_squares() for e, c in curves.items()}
    sills = np.stack([joined({e: v[k] for e, v in alone.items()}) for k in range(1 + len(template.structures))])
    loss = lambda m: sum((2 if e == (0, 1) else 1) * c.loss(m[:, e[0], e[1]]) for e, c in curves.items())
    now = loss(sills)
    for _ in range(rounds):
        trial = sills.copy()
        for k in range(len(trial)):
            trial[k] = joined({e: c.best_sill(k, trial[:, e[0], e[1]]) for e, c in curves.items()})
        then = loss(trial)
        if then > now:
            break
        done, sills, now = now - then <= 1e-12 * max(now, np.finfo(float).tiny), trial, then
        if done:
            break
    return Lmc(sills[0], tuple((Structure(s.kind, 1.0, s.range, s.param), m) for s, m in zip(template.structures, sills[1:])))


def fit_lmc_collocated(primary: DataFrame, secondary: DataFrame, n_lags: int = 15, max_dist: float | None = None, kinds=fitting.BEST) -> Lmc:
    both = vg.collocate(primary, secondary)
    if both.count() < n_lags:
        raise InsufficientData("too few points have both variables")
    max_dist = max_dist or vg.default_max_dist(both)
    held = both.sparkSession.createDataFrame(vg.collocated_variograms(both, n_lags, max_dist).collect(), "lag int, h double, gamma_a double, gamma_b double, gamma_ab double, n_pairs long")  # a row a lag
    a, b, c = (fitting.usable(held.withColumn("gamma", F.col(f"gamma_{k}"))) for k in ("a", "b", "ab"))
    return fit_lmc(a, b, c, fitting.fit_best(a, kinds).model)


class CoKriging:
    """Ordinary co-kriging of variable 0: its weights sum to 1, those of every other variable to 0."""

    def __init__(self, data: list[dict], lmc: Lmc, neighbors: Neighbors = Neighbors(max=16), ridge: float = 0.0):
        if len(data) != len(lmc.nugget):
            raise InvalidParameter("a coregionalization of as many variables as data sets is needed")
        self.data, self.lmc, self.ridge, self.neighbors = data, lmc, ridge, neighbors
        self.indexes = [neighbors.index(d["xyz"], d["id"]) for d in data]

    def predict(self, targets: np.ndarray, exclude=None, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        m = len(targets)
        value, variance = np.full(m, np.nan), np.full(m, np.nan)
        near = [ix.query(targets, self.neighbors.max, self.neighbors.radius, exclude=exclude if v == 0 else None) for v, ix in enumerate(self.indexes)]
        shapes = np.array([[len(x) for x in n] for n in near]).T
        for shape in np.unique(shapes, axis=0):
            if shape[0] < max(1, self.neighbors.min):
                continue
            at = np.flatnonzero((shapes == shape).all(axis=1))
            used = [v for v, k in enumerate(shape) if k]
            var = np.concatenate([np.full(shape[v], v) for v in used])
            k, p = len(var), len(used)
            xyz = np.concatenate([np.stack([self.data[v]["xyz"][near[v][i]] for i in at]) for v in used], axis=1)
            z = np.concatenate([np.stack([self.data[v]["value"][near[v][i]] for i in at]) for v in used], axis=1)
            a, b = np.zeros((len(at), k + p, k + p)), np.zeros((len(at), k + p))
            a[:, :k, :k] = self.lmc.cov(xyz[:, :, None, :] - xyz[:, None, :, :], var[:, None], var[None, :])
            a[:, np.arange(k), np.arange(k)] *= 1 + self.ridge
            for c, v in enumerate(used):
                a[:, :k, k + c] = a[:, k + c, :k] = var == v
            if block is None:
                b[:, :k] = self.lmc.cov(targets[at][:, None, :] - xyz, 0, var[None, :])
            else:
                b[:, :k] = self.lmc.cov(targets[at][:, None, None, :] + block[None, None] - xyz[:, :, None, :], 0, var[None, :, None]).mean(axis=2)
            b[:, k] = 1.0
            w = solve_stack(a, b[..., None])[..., 0]
            value[at] = (w[:, :k] * z).sum(axis=1)
            own = self.lmc.sills[0, 0]
            if block is not None:
                dh = block[:, None] - block[None]
                within = self.lmc.cov(dh, 0, 0)
                within[(dh == 0).all(axis=-1)] -= self.lmc.nugget[0][0]
                own = within.mean()
            variance[at] = np.maximum(own - (w * b).sum(axis=1), 0)
        return value, variance


def _cokriged(targets: DataFrame, variables: list[DataFrame], lmc: Lmc, step, schema: str, spare: int = 0, **options) -> DataFrame:
    names = coords(variables[0])
    known = [v.select("id", *names, "value") for v in variables]
    return near_map(targets, known, names, options.get("neighbors", Neighbors(max=16)), lambda p, some: CoKriging(p, lmc, **options), step, schema, spare)


def cokrige(targets: DataFrame, variables: list[DataFrame], lmc: Lmc, block=None, key: str = "id", **options) -> DataFrame:
    names = coords(variables[0])
    offsets = None if block is None else block_offsets(*block)

    def step(engine, b):
        v = s = np.full(len(b), np.nan)
        if engine is not None:
            v, s = engine.predict(b[names].to_numpy(float), block=offsets)
        return pd.DataFrame({key: b[key], **{c: b[c] for c in names}, "prediction": v, "variance": s})

    return nulls(_cokriged(targets.select(key, *names), variables, lmc, step, f"{key} long, {', '.join(f'{c} double' for c in names)}, prediction double, variance double", **options), "prediction", "variance")


def leave_one_out_cokriging(variables: list[DataFrame], lmc: Lmc, **options) -> DataFrame:
    names = coords(variables[0])

    def step(engine, b):
        v = s = np.full(len(b), np.nan)
        if engine is not None:
            v, s = engine.predict(b[names].to_numpy(float), exclude=b["id"].to_numpy())
        return pd.DataFrame({"id": b["id"], "observed": b["value"], "predicted": v, "variance": s})

    return nulls(_cokriged(variables[0].select("id", *names, "value"), variables, lmc, step, "id long, observed double, predicted double, variance double", 1, **options), "predicted", "variance")


class Collocated:
    """Simple collocated co-kriging on standardised residuals.

    The primary has the correlogram of ``model``.  Across variables it is rho times that of ``model`` (mm1), or
    of ``secondary_model`` (mm2: the secondary, known everywhere, is what is modelled).
    """

    def __init__(self, data: dict, model: VariogramModel, rho: float, mean: float, std: float, mean2: float, std2: float, markov: str = "mm1", secondary_model: VariogramModel | None = None, neighbors: Neighbors = Neighbors(max=16), ridge: float = 0.0):
        if not -1 <= rho <= 1 or std <= 0 or std2 <= 0 or markov not in ("mm1", "mm2"):
            raise InvalidParameter("rho must lie in [-1, 1], deviations must be positive, markov mm1 or mm2")
        if (markov == "mm2") != (secondary_model is not None):
            raise InvalidParameter("mm2, and no other form, takes a model of the secondary")
        if any(m.has_power for m in (model, secondary_model) if m is not None):
            raise InvalidParameter("collocated co-kriging takes bounded models")
        self.data, self.model, self.across, self.rho, self.stats, self.ridge, self.neighbors = data, model, secondary_model or model, rho, (mean, std, mean2, std2), ridge, neighbors
        self.index = neighbors.index(data["xyz"], data["id"])

    def correlogram(self, dh):
        """Of the primary, and across."""
        return self.model.cov_np(dh) / self.model.total_sill(), self.rho * self.across.cov_np(dh) / self.across.total_sill()

    def predict(self, targets: np.ndarray, secondary: np.ndarray, exclude=None) -> tuple[np.ndarray, np.ndarray]:
        mean, std, mean2, std2 = self.stats
        m = len(targets)
        value, variance = np.full(m, np.nan), np.full(m, np.nan)
        near = self.index.query(targets, self.neighbors.max, self.neighbors.radius, exclude=exclude)
        sizes = np.array([len(x) for x in near])
        for k in np.unique(sizes):
            if 0 < k < self.neighbors.min:  # without neighbours the secondary alone gives a regression
                continue
            at = np.flatnonzero(sizes == k)
            rows = np.stack([near[i] for i in at]).astype(int)
            xyz, u = self.data["xyz"][rows], (self.data["value"][rows] - mean) / std
            a, b = np.ones((len(at), k + 1, k + 1)), np.zeros((len(at), k + 1))
            a[:, :k, :k] = self.correlogram(xyz[:, :, None, :] - xyz[:, None, :, :])[0]
            direct, cross = self.correlogram(targets[at][:, None, :] - xyz)
            a[:, :k, k] = a[:, k, :k] = cross
            a[:, np.arange(k + 1), np.arange(k + 1)] += self.ridge / np.r_[np.full(k, std * std), std2 * std2]
            b[:, :k], b[:, k] = direct, self.rho
            w = solve_stack(a, b[..., None])[..., 0]
            value[at] = mean + std * ((w[:, :k] * u).sum(axis=1) + w[:, k] * (secondary[at] - mean2) / std2)
            variance[at] = np.maximum(std * std * (1 - (w * b).sum(axis=1)), 0)
        return value, variance


def collocated_cokrige(targets: DataFrame, data: DataFrame, model: VariogramModel, secondary: str = "secondary", exclude_self: bool = False, **options) -> DataFrame:
    """id, prediction, variance; targets carry the secondary.  Statistics left out are estimated from data (value, secondary)."""
    from .transform import collocated_stats

    names = coords(data)
    if "rho" not in options:
        row = collocated_stats(data.withColumn("secondary", F.col(secondary))).first()
        means = data.agg(F.avg("value"), F.avg(secondary)).first()
        options = {"rho": row["rho"], "std": row["std_primary"], "std2": row["std_secondary"], "mean": means[0], "mean2": means[1]} | options
    near = options.get("neighbors", Neighbors(max=16))

    def step(engine, b):
        v = s = np.full(len(b), np.nan)
        if engine is not None:
            v, s = engine.predict(b[names].to_numpy(float), b[secondary].to_numpy(float), b["id"].to_numpy() if exclude_self else None)
        return pd.DataFrame({"id": b["id"], "prediction": v, "variance": s})

    known = data.select("id", *names, "value")
    out = near_map(targets.select("id", *names, secondary), [known], names, near, lambda p, some: Collocated(p[0], model, **options), step, "id long, prediction double, variance double", int(exclude_self))
    return nulls(out, "prediction", "variance")


def leave_one_out_collocated(data: DataFrame, model: VariogramModel, **options) -> DataFrame:
    out = collocated_cokrige(data, data, model, exclude_self=True, **options)
    return data.select("id", F.col("value").alias("observed")).join(out.withColumnRenamed("prediction", "predicted"), "id")
