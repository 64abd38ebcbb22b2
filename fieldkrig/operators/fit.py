"""Model fitting on the driver: a variogram has a few lags, whatever the number of points."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientData, InvalidParameter
from ..functions.models import BEST, Anisotropy, Structure, VariogramModel, parse_kind, unit_gamma
from ..functions.optim import nelder_mead_multistart
from . import transform
from . import variogram as vg

WEIGHTS = ("n/h2", "n", "n/gamma2", "ols")


@dataclass(frozen=True)
class Fit:
    model: VariogramModel
    wsse: float


def usable(ev: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, gamma, n_pairs of the bins that can be fitted, in order of h."""
    rows = ev.filter("n_pairs > 0 and h > 0 and gamma is not null").filter(~F.isnan("gamma")).select("h", "gamma", "n_pairs").collect()
    h, g, n = (np.array(c, float) for c in zip(*sorted(rows))) if rows else (np.zeros(0),) * 3
    return h, g, n


def _bins(ev) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, g, n = usable(ev) if isinstance(ev, DataFrame) else (np.asarray(x, float) for x in ev)
    if len(h) < 4:
        raise InsufficientData("a fit needs four bins with pairs")
    return h, g, n


def _weights(scheme: str, h, n, gamma_model):
    if scheme == "n/h2":
        return n / (h * h)
    if scheme == "n":
        return n
    if scheme == "ols":
        return np.ones_like(h)
    if scheme == "n/gamma2":
        return n / np.maximum(gamma_model, 1e-12) ** 2
    raise InvalidParameter(f"unknown weights {scheme!r}; known: {', '.join(WEIGHTS)}")


def _starts(h, g, extra: list[list[float]] | None = None):
    """nugget = x0**2, sill = exp(x1), range = exp(x2); ranges 0.3, 1 and 3 times a third of the reach."""
    sill, reach = max(g.max(), 1e-12), h.max() / 3
    return [np.array([math.sqrt(0.1 * sill), math.log(0.9 * sill), math.log(f * reach), *e]) for f in (0.3, 1, 3) for e in (extra or [[]])]


def fit_model(ev, kind: str, weights: str = "n/h2") -> Fit:
    """Weighted least squares of a nugget and one structure; kind may carry a fixed parameter."""
    h, g, n = _bins(ev)
    name, param = parse_kind(kind)

    def loss(x):
        if abs(x[1]) > 60 or abs(x[2]) > 60:
            return math.inf
        m = x[0] ** 2 + math.exp(x[1]) * unit_gamma(name, param, h, math.exp(x[2]))
        return float((_weights(weights, h, n, m) * (g - m) ** 2).sum())

    x, value = nelder_mead_multistart(loss, _starts(h, g))
    return Fit(VariogramModel(x[0] ** 2, (Structure(name, math.exp(x[1]), math.exp(x[2]), param),)), value)


def fit_best(ev, kinds=BEST, weights: str = "n/h2") -> Fit:
    bins = _bins(ev)
    return min((fit_model(bins, k, weights) for k in kinds), key=lambda f: f.wsse)


def _fit_param(ev, name: str, low: float, high: float, starts) -> Fit:
    h, g, n = _bins(ev)
    inside = lambda t: low + (high - low) / (1 + math.exp(-max(-50.0, min(50.0, t))))

    def loss(x):
        if abs(x[1]) > 60 or abs(x[2]) > 60:
            return math.inf
        m = x[0] ** 2 + math.exp(x[1]) * unit_gamma(name, inside(x[3]), h, math.exp(x[2]))
        return float((n / (h * h) * (g - m) ** 2).sum())

    logit = [[math.log((s - low) / (high - s))] for s in starts]
    x, value = nelder_mead_multistart(loss, _starts(h, g, logit))
    return Fit(VariogramModel(x[0] ** 2, (Structure(name, math.exp(x[1]), math.exp(x[2]), inside(x[3])),)), value)


def fit_matern(ev) -> Fit:
    """Smoothness fitted along, in (0.1, 5)."""
    return _fit_param(ev, "matern", 0.1, 5.0, (0.5, 1.5))


def fit_stable(ev) -> Fit:
    return _fit_param(ev, "stable", 0.05, 2.0, (0.8, 1.5))


def fit_nested(ev, kinds: list[str]) -> Fit:
    """A nugget and one structure per kind, ranges started from short to long."""
    h, g, n = _bins(ev)
    parsed = [parse_kind(k) for k in kinds]
    k = len(parsed)
    if not k:
        raise InvalidParameter("at least one structure is needed")

    def parts(x):
        return [(name, math.exp(x[1 + 2 * i]), math.exp(x[2 + 2 * i]), param) for i, (name, param) in enumerate(parsed)]

    def loss(x):
        if np.abs(x[1:]).max() > 60:
            return math.inf
        m = x[0] ** 2 + sum(s * unit_gamma(name, p, h, a) for name, s, a, p in parts(x))
        return float((n / (h * h) * (g - m) ** 2).sum())

    sill = max(g.max(), 1e-12)
    starts = [np.array([math.sqrt(0.1 * sill), *(v for i in range(k) for v in (math.log(0.9 * sill / k), math.log(f * h.max() * (i + 1) / (3 * k))))]) for f in (0.3, 1, 3)]
    x, value = nelder_mead_multistart(loss, starts, max_iter=1000 * k)
    return Fit(VariogramModel(x[0] ** 2, tuple(Structure(name, s, a, p) for name, s, a, p in parts(x))), value)


def fit_anisotropic(df: DataFrame, kinds=BEST, n_dirs: int = 4, n_lags: int = 10, max_dist: float | None = None) -> Fit:
    """Geometric anisotropy in the plane: all directions in one job, then azimuth and ratio fitted with the model.  ratio = (1 + tanh x) / 2."""
    if n_dirs < 2:
        raise InvalidParameter("at least two directions are needed")
    max_dist = max_dist or vg.default_max_dist(df)
    azimuths = [180.0 * i / n_dirs for i in range(n_dirs)]
    rows = vg.directional_variograms(df, azimuths, 90.0 / n_dirs, n_lags, max_dist).filter("h > 0").orderBy("azimuth", "lag").collect()
    if len(rows) < 6:
        raise InsufficientData("too few bins with pairs in the directions")
    az, h, g, n = (np.array([r[c] for r in rows], float) for c in ("azimuth", "h", "gamma", "n_pairs"))
    lag = np.stack([h * np.sin(np.radians(az)), h * np.cos(np.radians(az))], axis=-1)
    best = None
    for kind in kinds:
        name, param = parse_kind(kind)

        def model(x):
            return VariogramModel(x[0] ** 2, (Structure(name, math.exp(x[1]), math.exp(x[2]), param, Anisotropy(math.degrees(x[3]) % 180, max(0.5 * (1 + math.tanh(x[4])), 1e-3))),))

        def loss(x):
            if abs(x[1]) > 60 or abs(x[2]) > 60:
                return math.inf
            return float((n / (h * h) * (g - model(x).gamma_np(lag)) ** 2).sum())

        starts = [np.array([*s, math.radians(a), 0.5]) for s in _starts(h, g)[1:2] for a in azimuths]
        x, value = nelder_mead_multistart(loss, starts, max_iter=1500)
        if best is None or value < best.wsse:
            best = Fit(model(x), value)
    return best


def fit_indicator_models(df: DataFrame, cutoffs: list[float], kinds=("spherical", "exponential"), n_lags: int = 15, max_dist: float | None = None) -> list[Fit]:
    """A model for each cutoff; the indicator variograms of all come from one job."""
    max_dist = max_dist or vg.default_max_dist(df)
    rows = vg.indicator_variograms(df, cutoffs, n_lags, max_dist).collect()
    out = []
    for k in range(len(cutoffs)):
        own = sorted((r["h"], r["gamma"], r["n_pairs"]) for r in rows if r["cutoff"] == k and r["h"] > 0)
        out.append(fit_best(tuple(np.array(c, float) for c in zip(*own)) if own else ([], [], []), kinds))
    return out


def fit_median_indicator_model(df: DataFrame, kinds=("spherical", "exponential"), n_lags: int = 15, max_dist: float | None = None) -> Fit:
    n = df.filter("value is not null").count()
    low, high = transform.quantile_cutoffs(df, [((n - 1) // 2 + 0.5) / n, (n // 2 + 0.5) / n]) if n else (0.0, 0.0)
    median = (low + high) / 2
    return fit_indicator_models(df, [median], kinds, n_lags, max_dist)[0]
