"""Indicator kriging: conditional distributions at cutoffs, their moments, soft data."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.models import VariogramModel
from ..sources.points import coords
from .kriging import Neighbors, near_map, solve_stack
from .transform import Tail, tail_moments

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def check(share: list[float], cutoffs: list[float], models: list[VariogramModel], lower: Tail, upper: Tail) -> None:
    if any(b <= a for a, b in zip(cutoffs, cutoffs[1:])) or not cutoffs:
        raise InvalidParameter("cutoffs must rise strictly")
    if len(models) not in (1, len(cutoffs)):
        raise InvalidParameter("one model, or one for each cutoff, is needed")
    if any(m.has_power for m in models):
        raise InvalidParameter("indicators take bounded models")
    if min(share) <= 0 or max(share) >= 1:
        raise InvalidParameter("every cutoff must have data on both sides")
    if lower.kind in ("none", "hyperbolic") or upper.kind == "none":
        raise InvalidParameter("distributions need tails: linear or power below; linear, power or hyperbolic above")
    if lower.bound is None or lower.bound > cutoffs[0] or (upper.kind != "hyperbolic" and (upper.bound is None or upper.bound < cutoffs[-1])):
        raise InvalidParameter("the tails' bounds must enclose the cutoffs")


def corrected(f: np.ndarray) -> np.ndarray:
    """Order relations: clamp, then the mean of the upward and the downward correction."""
    f = np.clip(f, 0, 1)
    return (np.maximum.accumulate(f, axis=-1) + np.minimum.accumulate(f[..., ::-1], axis=-1)[..., ::-1]) / 2


@dataclass(frozen=True)
class SoftCalibration:
    """How a soft probability goes with the indicator of a cutoff: correlation, and the soft data's own deviation and mean."""

    rho: float
    std: float
    mean: float

    def __post_init__(self):
        if not -1 <= self.rho <= 1 or not (math.isfinite(self.std) and self.std > 0) or not math.isfinite(self.mean):
            raise InvalidParameter("a calibration needs rho in [-1, 1], a positive deviation and a mean")


class IndicatorKriging:
    def __init__(self, data: dict, cutoffs, models, ordinary: bool = True, neighbors: Neighbors = Neighbors(max=16), calibration: list[SoftCalibration] | None = None, share: np.ndarray | None = None):
        """share: of all data at most each cutoff, where data are some of them."""
        if calibration is not None and (ordinary or len(calibration) != len(cutoffs)):
            raise InvalidParameter("soft indicators take simple kriging and one calibration for each cutoff")
        self.data, self.cutoffs, self.models, self.ordinary, self.neighbors, self.calibration = data, np.asarray(cutoffs, float), list(models), ordinary, neighbors, calibration
        self.coded = (data["value"][:, None] <= self.cutoffs[None, :]).astype(float)
        self.share = self.coded.mean(axis=0) if share is None else share
        self.index = neighbors.index(data["xyz"], data["id"])

    def _weights(self, model, xyz, target, soft: SoftCalibration | None = None):
        """Of the neighbours, and in the last place of a soft datum at the target.

        The soft datum's covariance with a neighbour is rho std sqrt(c0) times the indicator's correlogram (Markov-Bayes).
        """
        k, c0 = xyz.shape[1], model.total_sill()
        extra = int(self.ordinary or soft is not None)
        a, b = np.zeros((len(xyz), k + extra, k + extra)), np.ones((len(xyz), k + extra))
        a[:, :k, :k] = model.cov_np(xyz[:, :, None, :] - xyz[:, None, :, :])
        b[:, :k] = model.cov_np(target[:, None, :] - xyz)
        if soft is not None:
            a[:, :k, k] = a[:, k, :k] = soft.rho * soft.std / math.sqrt(c0) * b[:, :k]
            a[:, k, k], b[:, k] = soft.std**2, soft.rho * soft.std * math.sqrt(c0)
        elif extra:
            a[:, :k, k] = a[:, k, :k] = 1
        held = np.arange(k + (soft is not None))
        a[:, held, held] += 1e-9 * c0
        return solve_stack(a, b[..., None])[:, : k + (soft is not None), 0]

    def predict(self, targets: np.ndarray, exclude=None, soft: np.ndarray | None = None) -> np.ndarray:
        """The ccdf at the cutoffs, NaN where it fails.  soft: a probability for each target and cutoff."""
        out = np.full((len(targets), len(self.cutoffs)), np.nan)
        near = self.index.query(targets, self.neighbors.max, self.neighbors.radius, exclude=exclude)
        sizes = np.array([len(x) for x in near])
        for k in np.unique(sizes):
            # Without hard neighbours a soft datum alone gives a regression.
            if k < max(1, self.neighbors.min) and (soft is None or k):
                continue
            at = np.flatnonzero(sizes == k)
            rows = np.stack([near[i] for i in at]).astype(int)
            xyz, coded = self.data["xyz"][rows], self.coded[rows]
            w = self._weights(self.models[0], xyz, targets[at]) if len(self.models) == 1 and soft is None else None  # one solution for all cutoffs
            for c in range(len(self.cutoffs)):
                calibration = None if soft is None else self.calibration[c]
                own = w if w is not None else self._weights(self.models[0 if len(self.models) == 1 else c], xyz, targets[at], calibration)
                base = 0.0 if self.ordinary else self.share[c]
                out[at, c] = base + (own[:, :k] * (coded[:, :, c] - base)).sum(axis=1)
                if soft is not None:
                    out[at, c] += own[:, k] * (soft[at, c] - calibration.mean)
        return corrected(out)


def calibrate_markov_bayes(calibration: DataFrame, cutoffs: list[float], soft: list[str]) -> list[SoftCalibration]:
    """For each cutoff from points with a value and soft probabilities, in one aggregation (population deviations)."""
    coded = [(F.col("value") <= float(c)).cast("double") for c in cutoffs]
    row = calibration.agg(*[f.alias(f"{n}{k}") for k, (i, p) in enumerate(zip(coded, soft)) for n, f in (("r", F.corr(i, F.col(p))), ("s", F.stddev_pop(p)), ("m", F.avg(p)))]).first()
    found = [(row[f"r{k}"], row[f"s{k}"], row[f"m{k}"]) for k in range(len(cutoffs))]
    if any(v is None or not math.isfinite(v) for f in found for v in f):
        raise InvalidParameter("every cutoff needs calibration data on both sides, and soft data that vary")
    return [SoftCalibration(*f) for f in found]


def moments_col(ccdf: Column, cutoffs: list[float], lower: Tail, upper: Tail) -> tuple[Column, Column]:
    """E-type mean and conditional variance: linear between cutoffs, tails outside."""
    first = second = F.lit(0.0)
    k = len(cutoffs)
    # Tail moments scale with the tail's mass: their mean and mean square are constants.
    low = [v / 0.5 for v in tail_moments(cutoffs[0], 0.5, lower, False)]
    high = [v / 0.5 for v in tail_moments(cutoffs[-1], 0.5, upper, True)]
    pieces = [(F.get(ccdf, 0), low)]
    for i in range(1, k):
        a, b = cutoffs[i - 1], cutoffs[i]
        pieces.append((F.get(ccdf, i) - F.get(ccdf, i - 1), [(a + b) / 2, (a * a + a * b + b * b) / 3]))
    pieces.append((1 - F.get(ccdf, k - 1), high))
    for mass, (m1, m2) in pieces:
        # A tail may have infinite moments; without mass it adds nothing.
        part = lambda m, mass=mass: mass * float(m) if np.isfinite(m) else F.when(mass > 0, F.lit(float(m))).otherwise(F.lit(0.0))
        first, second = first + part(m1), second + part(m2)
    return first, F.when(first < float("inf"), F.greatest(F.lit(0.0), second - first * first)).otherwise(F.lit(float("inf")))


def indicator_krige(
    targets: DataFrame, data: DataFrame, cutoffs: list[float], models: list[VariogramModel], lower: Tail, upper: Tail, ordinary: bool = True, neighbors: Neighbors = Neighbors(max=16),
    soft: tuple[str, ...] = (), calibration: list[SoftCalibration] | None = None, exclude_self: bool = False, key: str = "id",
) -> DataFrame:
    """key, x, y[, z], ccdf, e_type, cond_var.  soft: columns of targets, one for each cutoff, with probabilities (simple kriging, with a calibration)."""
    names = coords(data)
    row = data.agg(*[F.avg((F.col("value") <= float(c)).cast("double")).alias(f"s{k}") for k, c in enumerate(cutoffs)]).first() if cutoffs else []
    share_ = np.array([np.nan if v is None else v for v in row], float)
    check(list(share_), cutoffs, models, lower, upper)
    if len(soft) != (len(cutoffs) if calibration else 0):
        raise InvalidParameter("soft columns and calibrations go together, one for each cutoff")

    def make(p, some):
        return IndicatorKriging(p[0], cutoffs, models, ordinary, neighbors, calibration, share_)

    def step(engine, b):
        engine = engine or make([{"xyz": np.zeros((0, len(names))), "id": np.zeros(0, int), "value": np.zeros(0)}], True)  # a tile without data
        f = engine.predict(b[names].to_numpy(float), b[key].to_numpy() if exclude_self else None, b[list(soft)].to_numpy(float) if soft else None)
        return pd.DataFrame({key: b[key], **{c: b[c] for c in names}, "ccdf": [None if np.isnan(r).any() else r.tolist() for r in f]})

    out = near_map(targets.select(key, *names, *soft), [data.select("id", *names, "value")], names, neighbors, make, step, f"{key} long, {', '.join(f'{c} double' for c in names)}, ccdf array<double>", int(exclude_self))
    mean, var = moments_col(F.col("ccdf"), cutoffs, lower, upper)
    return out.select("*", mean.alias("e_type"), var.alias("cond_var"))
