"""Products of covariances with vectors in the plane, in time that grows with the points and not with their pairs.

Points lie in the cells of a quadtree.  Between cells that don't touch, a smooth covariance is a polynomial in the places of
both points: Chebyshev interpolation, of a degree that ``chosen`` tests against the covariance itself on every level.  Values
go up the tree as weights of a cell's nodes, over to the cells whose parents touch, and down to the points; cells that touch
meet point by point (the fast multipole method in its kernel-independent form).  A covariance that is not smooth away from 0, as
one that ends at its range, finds no degree; it is left to products over all pairs.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Degrees that are tried, the error allowed as a share of the sill, levels at most, points that an error is looked for at, points that are worth it.
DEGREES, ALLOWED, DEEPEST, PROBES, FEWEST = (10, 13, 16, 19), 1e-11, 18, 24, 5000
#: Seconds that a pair takes, and a multiplication within a product of matrices: they set the depth, and whether far fields cost less than all pairs.
PAIR, TIMES = 3e-8, 2e-10
#: The cells to which values go over: half of them, as a covariance doesn't know a sign.
OVER = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if max(abs(i), abs(j)) > 1 and (i, j) > (0, 0)]


def _spread(c: np.ndarray) -> np.ndarray:
    out = np.zeros_like(c)
    for b in range(DEEPEST):
        out |= (c >> b & 1) << 2 * b
    return out


def _gathered(c: np.ndarray) -> np.ndarray:
    out = np.zeros_like(c)
    for b in range(DEEPEST):
        out |= (c >> 2 * b & 1) << b
    return out


def code_of(ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    """A cell's number; those of a parent's cells follow each other."""
    return _spread(ix) << 1 | _spread(iy)


def covariance(model, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    if any(s.anis for s in model.structures):
        return model.cov_np(np.stack([dx, dy], axis=-1))
    return model.total_sill() - model.gamma_h(np.sqrt(dx * dx + dy * dy))


def nodes(p: int) -> np.ndarray:
    return np.cos((np.arange(p) + 0.5) * np.pi / p)


def weights(x: np.ndarray, p: int) -> np.ndarray:
    """Each place's (-1 to 1) weights of the nodes."""
    k = np.arange(p)
    scale = np.where(k == 0, 1.0, 2.0) / p
    return (np.cos(k * np.arccos(np.clip(x, -1, 1))[:, None]) * scale) @ np.cos(k[:, None] * (np.arange(p) + 0.5) * np.pi / p)


def _over(model, p: int, width: float, at: tuple[int, int]) -> np.ndarray:
    """Covariances of a cell's nodes (down) with those of the cell at this many cells from it."""
    t = nodes(p) * width / 2
    dx, dy = t[:, None] - t - at[0] * width, t[:, None] - t - at[1] * width
    shape = (p, p, p, p)
    return covariance(model, np.broadcast_to(dx[:, None, :, None], shape), np.broadcast_to(dy[None, :, None, :], shape)).reshape(p * p, p * p)


def _error(model, p: int, width: float, over: dict) -> float:
    g, worst = np.random.default_rng(5), 0.0
    for at, a in over.items():
        t, s = (np.concatenate([g.uniform(-1, 1, (PROBES, 2)), [[-1, -1], [-1, 1], [1, -1], [1, 1]]]) for _ in range(2))
        wt, ws = ((weights(u[:, 0], p)[:, :, None] * weights(u[:, 1], p)[:, None, :]).reshape(len(u), -1) for u in (t, s))
        d = (t[:, None] - s[None]) * width / 2 - np.array(at) * width
        worst = max(worst, float(np.abs(wt @ a @ ws.T - covariance(model, d[..., 0], d[..., 1])).max()))
    return worst


class Level:
    """The cells of some points on a level: their codes, rising, and where their points start."""

    def __init__(self, codes: np.ndarray):
        edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        self.code, self.start = codes[edge], np.append(edge, len(codes))
        self.ix, self.iy = _gathered(self.code >> 1), _gathered(self.code)

    def find(self, ix: np.ndarray, iy: np.ndarray, side: int) -> np.ndarray:
        """Places of cells; -1 where there is none."""
        inside = (ix >= 0) & (iy >= 0) & (ix < side) & (iy < side)
        code = code_of(np.where(inside, ix, 0), np.where(inside, iy, 0))
        at = np.minimum(np.searchsorted(self.code, code), max(len(self.code) - 1, 0))
        return np.where(inside & (self.code[at] == code), at, -1) if len(self.code) else np.full(len(ix), -1)


class FarField:
    """Data in the order of their cells (``order``: places in the caller's), and what goes over between cells."""

    def __init__(self, xyz: np.ndarray, model, low: np.ndarray, side: float, depth: int, p: int, over: list[dict]):
        self.model, self.low, self.side, self.depth, self.p, self.over = model, low, side, depth, p, over
        codes = self.codes(xyz)
        self.order = np.argsort(codes, kind="stable")
        self.xyz, self.code = xyz[self.order], codes[self.order]

    def codes(self, xyz: np.ndarray) -> np.ndarray:
        cells = np.clip(np.floor((xyz - self.low) / (self.side / (1 << self.depth))).astype(np.int64), 0, (1 << self.depth) - 1)
        return code_of(cells[:, 0], cells[:, 1])

    def _weights(self, xyz: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.side / (1 << self.depth)
        u = (xyz - self.low) / width
        return weights(2 * (u[:, 0] - _gathered(codes >> 1)) - 1, self.p), weights(2 * (u[:, 1] - _gathered(codes)) - 1, self.p)

    def _children(self) -> list[np.ndarray]:
        """For each of a parent's cells: its nodes' weights of the parent's nodes."""
        half = [weights((nodes(self.p) + s) / 2, self.p) for s in (-1, 1)]
        return [np.kron(half[q >> 1], half[q & 1]) for q in range(4)]

    def up(self, v: np.ndarray) -> tuple[list[Level], list[np.ndarray]]:
        """Cells and their nodes' weights on every level; v in the order of cells."""
        p, q = self.p, v.shape[1]
        levels = [Level(self.code >> 2 * (self.depth - k)) for k in range(self.depth + 1)]
        wx, wy = self._weights(self.xyz, self.code)
        leaf = levels[-1]
        held = np.empty((len(leaf.code), q, p * p))
        for i, (a, z) in enumerate(zip(leaf.start[:-1], leaf.start[1:])):
            held[i] = ((v[a:z].T[:, :, None] * wx[a:z]).transpose(0, 2, 1) @ wy[a:z]).reshape(q, -1)
        out, children = [held], self._children()
        for k in range(self.depth - 1, 1, -1):
            below, above = levels[k + 1], np.zeros((len(levels[k].code), q, p * p))
            parent = np.searchsorted(levels[k].code, below.code >> 2)
            for c in range(4):
                own = np.flatnonzero(below.code & 3 == c)
                above[parent[own]] += out[0][own] @ children[c]
            out.insert(0, above)
        return levels, [np.zeros(0)] * 2 + out

    def at(self, targets: np.ndarray, risen: tuple[list[Level], list[np.ndarray]], v: np.ndarray) -> np.ndarray:
        """Covariances of targets with all data, times v (in the order of cells; risen: up(v))."""
        levels, held = risen
        p, q, codes = self.p, v.shape[1], self.codes(targets)
        order = np.argsort(codes, kind="stable")
        xyz, codes = targets[order], codes[order]
        children, local, before = self._children(), None, None
        for k in range(2, self.depth + 1):
            own, side = Level(codes >> 2 * (self.depth - k)), 1 << k
            here = np.zeros((len(own.code), q, p * p))
            if local is not None:
                parent = np.searchsorted(before.code, own.code >> 2)
                for c in range(4):
                    some = np.flatnonzero(own.code & 3 == c)
                    here[some] = local[parent[some]] @ children[c].T
            for (i, j), a in self.over[k].items():
                for sign, m in ((1, a.T), (-1, a)):
                    ix, iy = own.ix + sign * i, own.iy + sign * j
                    near = (np.abs((ix >> 1) - (own.ix >> 1)) <= 1) & (np.abs((iy >> 1) - (own.iy >> 1)) <= 1)
                    other = np.where(near, levels[k].find(ix, iy, side), -1)
                    some = np.flatnonzero(other >= 0)
                    if len(some):
                        here[some] += (held[k][other[some]].reshape(-1, p * p) @ m).reshape(len(some), q, -1)
            local, before = here, own
        wx, wy = self._weights(xyz, codes)
        leaf, side = levels[-1], 1 << self.depth
        around = np.stack([leaf.find(before.ix + i, before.iy + j, side) for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=1)
        out = np.empty((len(xyz), q))
        for c, (a, z) in enumerate(zip(before.start[:-1], before.start[1:])):
            out[a:z] = (wx[a:z] @ local[c].reshape(q, p, p) * wy[a:z]).sum(axis=2).T
            met = np.concatenate([np.zeros(0, np.int64), *[np.arange(leaf.start[o], leaf.start[o + 1]) for o in around[c] if o >= 0]])
            step = max(1, (1 << 16) // max(len(met), 1))
            data, values = self.xyz[met], v[met]
            for lo in range(a, z, step):
                t = xyz[lo : min(z, lo + step)]
                out[lo : min(z, lo + step)] += covariance(self.model, t[:, :1] - data[:, 0], t[:, 1:] - data[:, 1]) @ values
        back = np.empty_like(out)
        back[order] = out
        return back


def chosen(xyz: np.ndarray, model, low: np.ndarray, high: np.ndarray, allowed: float | None = None) -> FarField | None:
    """The least degree whose error is allowed (ALLOWED if None) on all levels, over a square that holds all places; None where there is none, or all pairs cost less."""
    if xyz.shape[1] != 2 or len(xyz) < FEWEST:
        return None
    side = float((high - low).max()) * (1 + 1e-9)
    if not np.isfinite(side) or side <= 0:
        return None
    best, depth = np.inf, 2
    for k in range(2, DEEPEST + 1):
        cells = np.clip(np.floor((xyz - low) / (side / (1 << k))).astype(np.int64), 0, (1 << k) - 1)
        n = np.unique(code_of(cells[:, 0], cells[:, 1]), return_counts=True)[1].astype(float)
        cost = PAIR * 9 * (n * n).sum() + 4 / 3 * len(n) * 27 * DEGREES[1] ** 4 * 2 * TIMES
        if cost < best:
            best, depth = cost, k
    if best >= PAIR * len(xyz) ** 2:
        return None
    for p in DEGREES:
        over = [{}, {}]
        for k in range(2, depth + 1):
            width = side / (1 << k)
            over.append({at: _over(model, p, width, at) for at in OVER})
            if _error(model, p, width, over[-1]) > (ALLOWED if allowed is None else allowed) * model.total_sill():
                break
        else:
            return FarField(xyz, model, low, side, depth, p, over)
    return None
