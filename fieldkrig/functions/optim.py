"""Small optimisers for the driver: a simplex search and a quasi-Newton method, from one or several starts."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Relative spread of a simplex's values at which it has converged.
SPREAD = 1e-12
#: Constants of the Wolfe conditions (sufficient decrease, curvature), as in textbooks for quasi-Newton steps.
DECREASE, CURVATURE = 1e-4, 0.9


def nelder_mead(f, x0, step: float = 0.25, max_iter: int = 1000) -> tuple[np.ndarray, float]:
    """Simplex search.  The worst vertex moves along the line through the others' centroid: to -1 (reflection), -2 (expansion), -0.5 or 0.5 (contraction); else all shrink by half towards the best."""
    x0 = np.asarray(x0, float)
    vertices = [(f(x), k, x) for k, x in enumerate([x0, *(x0 + step * e for e in np.eye(len(x0)))])]
    for _ in range(max_iter):
        vertices.sort(key=lambda v: v[:2])
        (best, _, low), (worst, k, high) = vertices[0], vertices[-1]
        if abs(worst - best) <= SPREAD * max(abs(best), SPREAD):
            break
        centroid = np.mean([v[2] for v in vertices[:-1]], axis=0)

        def at(t, centroid=centroid, high=high):
            x = centroid + t * (high - centroid)
            return f(x), x

        trial = at(-1.0)
        if trial[0] < best:
            trial = min(trial, at(-2.0), key=lambda v: v[0])
        elif not trial[0] < vertices[-2][0]:
            inside = at(-0.5 if trial[0] < worst else 0.5)
            trial = inside if inside[0] < min(trial[0], worst) else None
        if trial is None:
            vertices[1:] = [(f(x), k, x) for k, x in ((v[1], (v[2] + low) / 2) for v in vertices[1:])]
        else:
            vertices[-1] = (trial[0], k, trial[1])
    value, _, x = min(vertices, key=lambda v: v[:2])
    return x, float(value)


def nelder_mead_multistart(f, starts, step: float = 0.25, max_iter: int = 1000) -> tuple[np.ndarray, float]:
    return _best(nelder_mead(f, s, step, max_iter) for s in starts)


def _best(results):
    return min(results, key=lambda r: r[1] if np.isfinite(r[1]) else np.inf)


def wolfe_step(phi, value: float, slope: float, most: int = 25) -> tuple[float, float, np.ndarray] | None:
    """(t, value, gradient) of a step that meets the strong Wolfe conditions, or the best decrease met; phi(t) gives the value and a function for (slope, gradient).

    Bracketing, then bisection of the bracket, or a parabola's minimum where that lies well inside.
    """
    low, high = (0.0, value, slope), None
    t, found = 1.0, None
    for _ in range(most):
        v, derive = phi(t)
        if not (np.isfinite(v) and v <= value + DECREASE * t * slope) or v >= low[1] and low[0] > 0:
            high, s = (t, v, np.nan), np.nan
        else:
            s, g = derive()
            if found is None or v < found[1]:
                found = (t, v, g)
        if np.isnan(s):
            pass
        elif abs(s) <= -CURVATURE * slope:
            return t, v, g
        elif s * (t - low[0]) >= 0:
            high, low = low, (t, v, s)
        else:
            low = (t, v, s)
        if high is None:
            t *= 2
            continue
        width = high[0] - low[0]
        if abs(width) < 1e-14:
            break
        t = low[0] + width / 2
        # Minimum of the parabola through the lower end's value and slope and the other end's value.
        bend = high[1] - low[1] - low[2] * width
        if np.isfinite(bend) and bend > 0:
            share = -low[2] * width / (2 * bend)
            if 0.1 < share < 0.9:
                t = low[0] + share * width
    return found


def bfgs(f, grad, x0, max_iter: int = 200, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Quasi-Newton minimum: inverse Hessian by the BFGS formula (first scaled to the step met), strong Wolfe steps, until the gradient is small against the value, three steps gain nothing to speak of, or none is found."""
    x, n = np.asarray(x0, float), len(x0)
    value = f(x)
    if not np.isfinite(value):
        return x, float(value)
    g, inverse, idle = np.asarray(grad(x), float), None, 0
    for _ in range(max_iter):
        if np.abs(g).max() <= tolerance * max(1.0, abs(value)) or idle >= 3:
            break
        d = -g / max(1.0, np.linalg.norm(g)) if inverse is None else -(inverse @ g)

        def phi(t, x=x, d=d):
            def derive():
                new = np.asarray(grad(x + t * d), float)
                return new @ d, new

            return f(x + t * d), derive

        step = wolfe_step(phi, value, g @ d) if g @ d < 0 else None
        if step is None:
            if inverse is None:
                break
            inverse = None  # once more along the gradient
            continue
        idle = idle + 1 if value - step[1] <= 1e-11 * max(1.0, abs(value)) else 0
        t, value, new = step
        s, y = t * d, new - g
        x, g = x + s, new
        if s @ y > 0:
            if inverse is None:
                inverse = np.eye(n) * (s @ y) / (y @ y)
            hy, sy = inverse @ y, s @ y
            inverse = inverse + (1 + y @ hy / sy) * np.outer(s, s) / sy - (np.outer(hy, s) + np.outer(s, hy)) / sy
    return x, float(value)


def bfgs_multistart(f, grad, starts, max_iter: int = 200) -> tuple[np.ndarray, float]:
    return _best(bfgs(f, grad, s, max_iter) for s in starts)
