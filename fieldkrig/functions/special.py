"""Special functions: numpy forms for kernels, Column forms for plans."""

from __future__ import annotations

import sys
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The polynomial approximation of the normal distribution (absolute error < 7.5e-8)
# and the rational approximation of its inverse (relative error < 1.15e-9).
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
INV_LOW = 0.02425
P_MIN, P_MAX = 1e-300, 1 - 1e-16


def _horner(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_cdf(x):
    """Standard normal distribution function of an array."""
    x = np.asarray(x, float)
    t = 1 / (1 + CDF_P * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * _horner(CDF_B[::-1], t)
    return np.where(x >= 0, 1 - tail, tail)


def inv_norm_cdf(p):
    """Standard normal quantile of an array; p is clamped to [1e-300, 1 - 1e-16]."""
    p = np.clip(np.asarray(p, float), P_MIN, P_MAX)
    low, high = p < INV_LOW, p > 1 - INV_LOW
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.sqrt(-2 * np.log(np.where(low, p, np.where(high, 1 - p, 0.5))))
        tail = _horner(INV_C, q) / _horner((*INV_D, 1.0), q)
        r = p - 0.5
        s = r * r
        middle = r * _horner(INV_A, s) / _horner((*INV_B, 1.0), s)
    return np.where(low, tail, np.where(high, -tail, middle))


def norm_cdf_col(x: Column) -> Column:
    t = 1 / (1 + CDF_P * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * _horner(CDF_B[::-1], t)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def inv_norm_cdf_col(p: Column) -> Column:
    p = F.greatest(F.lit(P_MIN), F.least(F.lit(P_MAX), p))
    tail = lambda v: _horner(INV_C, q(v)) / _horner((*INV_D, 1.0), q(v))
    q = lambda v: F.sqrt(-2 * F.ln(v))
    r = p - 0.5
    s = r * r
    middle = r * _horner(INV_A, s) / _horner((*INV_B, 1.0), s)
    return F.when(p < INV_LOW, tail(p)).when(p > 1 - INV_LOW, -tail(1 - p)).otherwise(middle)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def bessel_k(nu: float, x):
    """Modified Bessel function of the second kind, x > 0: the integral of exp(-x cosh t) cosh(nu t) over t > 0.

    The integrand falls below exp(-60) of its scale past cosh t = 1 + 60 / x; up to
    there Gauss-Legendre panels of equal width are summed.
    """
    x = np.atleast_1d(np.asarray(x, float))
    # exp(-x (cosh t - 1)) cosh(nu t): find an end where both factors together are negligible.
    end = np.arccosh(1 + (60 + 2 * abs(nu) * np.log1p((60 + 20 * abs(nu)) / x)) / x)
    panels = 8
    t = ((np.arange(panels)[:, None] + (1 + _NODES) / 2) / panels).ravel()[None, :] * end[:, None]
    w = np.tile(_WEIGHTS / 2, panels)[None, :] * (end[:, None] / panels)
    value = (w * np.exp(-x[:, None] * (np.cosh(t) - 1) + abs(nu) * t) * (1 + np.exp(-2 * abs(nu) * t)) / 2).sum(axis=1)
    return value * np.exp(-x)


def gamma_function(x: float) -> float:
    return math.gamma(x)


DOWD_SQL = "pow(median(abs(dz)),2)/(2*pow(0.674489750196082,2))"


def _horner_sql(coefficients, x: str) -> str:
    out = f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        out = f"({out}*{x}+({c!r}))"
    return out


def norm_cdf_sql(x: str) -> str:
    """The distribution function as SQL text."""
    t = f"(1/(1+{CDF_P}*abs({x})))"
    tail = f"(exp(-({x})*({x})/2)/sqrt(2*pi())*{t}*{_horner_sql(CDF_B[::-1], t)})"
    return f"(case when {x}>=0 then 1-{tail} else {tail} end)"


def inv_norm_sql(p: str) -> str:
    """The quantile function as SQL text."""
    p = f"greatest(1e-300,least({P_MAX!r},{p}))"
    tail = lambda v: f"({_horner_sql(INV_C, q(v))}/{_horner_sql((*INV_D, 1.0), q(v))})"
    q = lambda v: f"sqrt(-2*ln({v}))"
    r = f"({p}-0.5)"
    s = f"({r}*{r})"
    middle = f"({r}*{_horner_sql(INV_A, s)}/{_horner_sql((*INV_B, 1.0), s)})"
    return f"(case when {p}<{INV_LOW} then {tail(p)} when {p}>{1 - INV_LOW!r} then -{tail(f'(1-{p})')} else {middle} end)"
