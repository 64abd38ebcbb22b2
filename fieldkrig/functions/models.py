"""Covariance models in two back ends: Columns for plans, numpy for kernels."""

from __future__ import annotations

import sys
import json
import math
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from .special import bessel_k

from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_NU = 15.0
#: Short names, and the bounded families that a search over the best family tries.
NAMES = {"sph": "spherical", "exp": "exponential", "gau": "gaussian", "m32": "matern32", "m52": "matern52", "cir": "circular", "circ": "circular", "hol": "hole", "wav": "wave", "ste": "stable", "pow": "power", "mat": "matern"}
KINDS = ("spherical", "exponential", "gaussian", "matern32", "matern52", "circular", "stable", "hole", "wave", "power", "matern")
BEST = ("spherical", "exponential", "gaussian", "matern32", "matern52", "circular")
PARAMETRIC = {"matern": (0.0, MAX_NU), "stable": (0.0, 2.0), "power": (0.0, 2.0)}


def parse_kind(text: str) -> tuple[str, float | None]:
    """``spherical``, ``sph``, ``matern:1.2`` ... to (kind, parameter)."""
    name, _, value = text.strip().lower().partition(":")
    name = NAMES.get(name, name)
    if name not in KINDS:
        raise InvalidParameter(f"unknown model kind {text!r}; known: {', '.join(KINDS)}")
    if name not in PARAMETRIC:
        if value:
            raise InvalidParameter(f"{name} takes no parameter")
        return name, None
    try:
        return name, float(value) if value else {"matern": 1.5, "stable": 1.0, "power": 1.0}[name]
    except ValueError:
        raise InvalidParameter(f"bad parameter in {text!r}") from None


def parse_kinds(text: str) -> list[tuple[str, float | None]]:
    return [(k, None) for k in BEST] if text.strip().lower() in ("best", "all") else [parse_kind(t) for t in text.split(",") if t.strip()]


@dataclass(frozen=True)
class Anisotropy:
    """azimuth clockwise from north, dip and rake in degrees; ratios of the minor axes to the major one."""

    azimuth: float
    ratio: float
    ratio_z: float = 1.0
    dip: float = 0.0
    rake: float = 0.0

    def matrix(self, dim: int) -> np.ndarray:
        """Rows map a lag vector to (major, minor[, vertical]) coordinates, the latter divided by their ratios."""
        az = math.radians(self.azimuth)
        if dim == 2:
            return np.array([[math.sin(az), math.cos(az)], [math.cos(az) / self.ratio, -math.sin(az) / self.ratio]])
        dip, rake = math.radians(self.dip), -math.radians(self.rake)
        along = np.array([math.sin(az) * math.cos(dip), math.cos(az) * math.cos(dip), math.sin(dip)])
        flat = np.array([math.cos(az), -math.sin(az), 0.0])
        up = np.cross(flat, along)
        across = math.cos(rake) * flat + math.sin(rake) * up
        normal = -math.sin(rake) * flat + math.cos(rake) * up
        return np.array([along, across / self.ratio, normal / self.ratio_z])


def unit_gamma(kind: str, param: float | None, h: np.ndarray, a: float) -> np.ndarray:
    """Semivariogram of unit sill at distances h > 0 (0 at 0)."""
    d = np.asarray(h, float) / a
    if kind == "spherical":
        out = np.where(d < 1, 1.5 * d - 0.5 * d**3, 1.0)
    elif kind == "exponential":
        out = -np.expm1(-d)
    elif kind == "gaussian":
        out = -np.expm1(-d * d)
    elif kind == "matern32":
        s = math.sqrt(3) * d
        out = 1 - (1 + s) * np.exp(-s)
    elif kind == "matern52":
        s = math.sqrt(5) * d
        out = 1 - (1 + s + s * s / 3) * np.exp(-s)
    elif kind == "matern":
        s = math.sqrt(2 * param) * d
        rho = np.ones_like(s)
        far = s > 1e-10
        rho[far] = 2 ** (1 - param) / math.gamma(param) * s[far] ** param * bessel_k(param, s[far])
        out = 1 - np.clip(rho, 0, 1)
    elif kind == "circular":
        c = np.minimum(d, 1)
        out = np.where(d < 1, 1 - 2 / math.pi * (np.arccos(c) - c * np.sqrt(1 - c * c)), 1.0)
    elif kind == "stable":
        out = -np.expm1(-(d**param))
    elif kind in ("hole", "wave"):
        out = 1 - np.sinc(d / math.pi if kind == "hole" else d)
    elif kind == "power":
        out = np.asarray(h, float) ** param
    else:
        raise InvalidParameter(kind)
    return np.where(np.asarray(h) > 0, out, 0.0)


#: Panels of the Matérn table at first, degree of their polynomials, and the error that it may have.
PANELS, DEGREE, MATERN_ERROR = 128, 8, 1e-10
#: Below this multiple of the scale the correlation counts as 1.
NEAREST = 1e-10


#: Tables made so far, by smoothness (a plain dict, which goes to tasks by value).
_TABLES: dict[float, tuple[float, float, np.ndarray]] = {}


def matern_table(nu: float) -> tuple[float, float, np.ndarray]:
    """(first ln s, panel width, coefficients): 1 - correlation as polynomials in ln s, s = sqrt(2 nu) h / range.

    Between NEAREST and where the correlation is below 1e-17.  Panels are halved until the error, against
    the Bessel function's integral between the nodes, is below MATERN_ERROR.
    """
    if nu in _TABLES:
        return _TABLES[nu]
    low, high = math.log(NEAREST), math.log(60 + 12 * nu)
    exact = lambda u: unit_gamma("matern", nu, np.exp(u), math.sqrt(2 * nu))
    nodes = np.cos((np.arange(DEGREE) + 0.5) * math.pi / DEGREE)
    inverse = np.linalg.inv(np.vander(nodes, DEGREE, increasing=True))
    panels = PANELS
    while True:
        width = (high - low) / panels
        middle = low + (np.arange(panels) + 0.5) * width
        table = exact((middle[:, None] + nodes * width / 2).ravel()).reshape(panels, DEGREE) @ inverse.T
        at = np.linspace(-0.97, 0.99, 7)
        off = np.abs(np.vander(at, DEGREE, increasing=True) @ table.T - exact((middle[:, None] + at * width / 2).ravel()).reshape(panels, -1).T).max()
        if off < MATERN_ERROR or panels >= 16 * PANELS:
            _TABLES[nu] = low, width, table
            return _TABLES[nu]
        panels *= 2


def matern_col(nu: float, d: Column) -> Column:
    """Semivariogram of unit sill for any smoothness, d = h / range: the table's panel is looked up and its polynomial evaluated, all in the plan."""
    low, width, table = matern_table(float(nu))
    x = (F.ln(d * math.sqrt(2 * nu)) - low) / width
    k = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(len(table) - 1)).cast("int")
    t = 2 * (x - k) - 1
    out = None
    for column in table.T[::-1]:
        own = F.get(F.array(*[F.lit(float(c)) for c in column]), k)
        out = own if out is None else out * t + own
    return F.when(x < 0, 0.0).when(x > len(table), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)))


def unit_gamma_col(kind: str, param: float | None, h: Column, a: float) -> Column:
    d = h / F.lit(float(a))
    if kind == "spherical":
        out = F.when(d < 1, 1.5 * d - 0.5 * d * d * d).otherwise(F.lit(1.0))
    elif kind == "exponential":
        out = 1 - F.exp(-d)
    elif kind == "gaussian":
        out = 1 - F.exp(-d * d)
    elif kind == "matern32":
        s = d * math.sqrt(3)
        out = 1 - (1 + s) * F.exp(-s)
    elif kind == "matern52":
        s = d * math.sqrt(5)
        out = 1 - (1 + s + s * s / 3) * F.exp(-s)
    elif kind == "circular":
        c = F.least(d, F.lit(1.0))
        out = F.when(d < 1, 1 - 2 / math.pi * (F.acos(c) - c * F.sqrt(1 - c * c))).otherwise(F.lit(1.0))
    elif kind == "stable":
        out = 1 - F.exp(-F.pow(d, F.lit(float(param))))
    elif kind in ("hole", "wave"):
        s = d if kind == "hole" else d * math.pi
        out = 1 - F.sin(s) / s
    elif kind == "power":
        out = F.pow(h, F.lit(float(param)))
    elif kind == "matern":
        out = matern_col(param, d)
    else:
        raise InvalidParameter(kind)
    return F.when(h > 0, out).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Structure:
    kind: str
    sill: float
    range: float
    param: float | None = None
    anis: Anisotropy | None = None


@runtime_checkable
class Covariance(Protocol):
    """What kriging, simulation and likelihoods ask of a model; any object with these parts may stand for a VariogramModel."""

    nugget: float

    @property
    def has_power(self) -> bool: ...

    def valid_dim(self, dim: int) -> bool: ...

    def total_sill(self) -> float: ...

    def gamma_np(self, dh: np.ndarray) -> np.ndarray:
        """Semivariance of lag vectors (last axis: coordinates)."""

    def cov_np(self, dh: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class VariogramModel:
    """A nugget and nested structures; the built-in Covariance."""

    nugget: float
    structures: tuple[Structure, ...] = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "structures", tuple(self.structures))
        if not (math.isfinite(self.nugget) and self.nugget >= 0):
            raise InvalidParameter("nugget must be finite and not negative")
        for s in self.structures:
            if s.kind not in KINDS:
                raise InvalidParameter(f"unknown kind {s.kind}")
            if not (math.isfinite(s.sill) and s.sill >= 0 and math.isfinite(s.range) and s.range > 0):
                raise InvalidParameter("sills must be finite and not negative, ranges positive")
            if s.kind in PARAMETRIC:
                low, high = PARAMETRIC[s.kind]
                if s.param is None or not low < s.param <= high or (s.kind == "power" and s.param >= 2):
                    raise InvalidParameter(f"{s.kind} needs a parameter in ({low}, {high}]")
            if s.anis and not (s.anis.ratio > 0 and s.anis.ratio_z > 0):
                raise InvalidParameter("anisotropy ratios must be positive")
        if self.total_sill() <= 0:
            raise InvalidParameter("the total sill must be positive")

    @property
    def has_power(self) -> bool:
        return any(s.kind == "power" for s in self.structures)

    def valid_dim(self, dim: int) -> bool:
        return dim <= 2 or all(s.kind != "circular" for s in self.structures)

    def total_sill(self) -> float:
        return self.nugget + sum(s.sill for s in self.structures)

    def gamma_np(self, dh: np.ndarray) -> np.ndarray:
        """Semivariance of lag vectors (last axis: coordinates)."""
        dh = np.asarray(dh, float)
        plain = np.sqrt((dh * dh).sum(axis=-1))
        out = np.where(plain > 0, self.nugget, 0.0)
        for s in self.structures:
            h = plain if s.anis is None else np.sqrt(((dh @ s.anis.matrix(dh.shape[-1]).T) ** 2).sum(axis=-1))
            out = out + s.sill * unit_gamma(s.kind, s.param, h, s.range)
        return out

    def gamma_h(self, h: np.ndarray) -> np.ndarray:
        """Semivariance along the major axis (isotropic models: any axis)."""
        h = np.asarray(h, float)
        return np.where(h > 0, self.nugget, 0.0) + sum(s.sill * unit_gamma(s.kind, s.param, h, s.range) for s in self.structures)

    def cov_np(self, dh: np.ndarray) -> np.ndarray:
        return self.total_sill() - self.gamma_np(dh)

    def gamma_col(self, *dh: Column) -> Column:
        """Semivariance as a Column of lag coordinates; one argument is a distance."""
        plain = dh[0] if len(dh) == 1 else F.sqrt(sum((c * c for c in dh[1:]), dh[0] * dh[0]))
        out = F.when(plain > 0, F.lit(float(self.nugget))).otherwise(F.lit(0.0))
        for s in self.structures:
            h = plain
            if s.anis is not None and len(dh) > 1:
                turned = [sum((F.lit(float(m)) * c for m, c in zip(row[1:], dh[1:])), F.lit(float(row[0])) * dh[0]) for row in s.anis.matrix(len(dh))]
                h = F.sqrt(sum((c * c for c in turned[1:]), turned[0] * turned[0]))
            out = out + F.lit(float(s.sill)) * unit_gamma_col(s.kind, s.param, h, s.range)
        return out

    def cov_col(self, *dh: Column) -> Column:
        return F.lit(self.total_sill()) - self.gamma_col(*dh)

    def to_json(self) -> str:
        def structure(s: Structure) -> dict:
            out: dict = {"kind": s.kind if s.param is None else {s.kind: s.param}, "sill": s.sill, "range": s.range}
            if s.anis:
                out["anis"] = {k: v for k, v in vars(s.anis).items() if k in ("azimuth", "ratio") or v != Anisotropy.__dataclass_fields__[k].default}
            return out

        return json.dumps({"nugget": self.nugget, "structures": [structure(s) for s in self.structures]})

    @classmethod
    def from_json(cls, text: str) -> VariogramModel:
        raw = json.loads(text)
        structures = []
        for s in raw.get("structures", []):
            kind, param = (s["kind"], None) if isinstance(s["kind"], str) else next(iter(s["kind"].items()))
            structures.append(Structure(kind.lower(), float(s["sill"]), float(s["range"]), param, Anisotropy(**s["anis"]) if s.get("anis") else None))
        return cls(float(raw["nugget"]), tuple(structures))


def single(kind: str, sill: float, range_: float, nugget: float = 0.0, anis: Anisotropy | None = None) -> VariogramModel:
    """A model of one structure; kind may carry a parameter (``matern:1.2``)."""
    name, param = parse_kind(kind)
    return VariogramModel(nugget, (Structure(name, sill, range_, param, anis),))
