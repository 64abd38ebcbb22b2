"""Kriging from all data at once, beyond what one dense factorisation holds.

Predictions need no system for each target: with K the data's covariances and F their drift, u = K^-1 z and A = K^-1 F give
the drift's coefficients and dual weights, and a target then takes one product with its covariances.  K is never stored.
Conjugate gradients ask for products K v only; a product is a job whose tasks make their rows of it: where a smooth covariance
meets points in the plane by far fields (functions/farfield.py), in time that grows with the points, else from their rows of K block by block.  The
preconditioner is the Vecchia approximation: each point given its nearest among those of all earlier levels of a random order.
Vectors (a value for each datum and right-hand side) are held by the driver, so data are at most ``MOST_DATA``; covariances and systems are the tasks'.

The variance, where it is asked for, needs a system for each target.  Targets that lie together share one of the data around them and of ever fewer data farther
off.  What it leaves over is met with all data: the energy of that residual is just what the variances are too large by.  Where it isn't ``SMALL``, the system grows,
then the few targets that it comes from get one of their own, and at last conjugate gradients over all data take the rest off.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, SingularSystem
from ..functions import farfield
from ..functions.models import VariogramModel
from ..plans.lineage import fits, share, shared
from ..plans.pairs import NeighborIndex
from ..sources.points import coords

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Data at most; points that each is conditioned on; rows and columns of a block of K; residual, and steps at most.
MOST_DATA, GIVEN, ROWS, COLUMNS = 1_000_000, 24, 256, 4096
#: Targets whose covariances are made at once.
LINES = 16
RESIDUAL, STEPS = 1e-10, 500
#: Bits of the cells by which targets are dealt.
BITS = 10
#: Targets that share a system at first, and at last; boxes around them; the datum in whose distance others are measured; data around them at first, and at most; data from each coarser level.
GROUP, FEW, BOXES, COUNTED, FIRST, LARGEST, COARSE = 256, 16, 16, 32, 2000, 4000, 250
#: Error allowed in a group's variances together, as a share of the sill; sums of random sign by which the energy is found; tasks for each core that find variances.
SMALL, SIGNS, SHARES = 3e-7, 8, 16
#: Error allowed in far fields where a residual's energy is found.
ROUGH = 1e-6


class System:
    """The data in a random order, and covariances among them."""

    def __init__(self, xyz: np.ndarray, model: VariogramModel, errors: np.ndarray | None, far: farfield.FarField | None = None, rough: farfield.FarField | None = None):
        """rough: far fields that are good enough to find a residual's energy."""
        self.xyz, self.model, self.errors, self.far, self.rough = xyz, model, errors, far, rough
        self.weights = self.near = self.spread = self.risen = None

    def rows(self) -> np.ndarray:
        """The data to which a product's rows belong: by cells where there are far fields."""
        return np.arange(len(self.xyz)) if self.far is None else self.far.order

    def product(self, lo: int, hi: int, v: np.ndarray) -> np.ndarray:
        """Rows lo to hi (of rows()) of K v."""
        if self.far is not None:
            own, sorted_ = self.far.order[lo:hi], v[self.far.order]
            out = self.far.at(self.far.xyz[lo:hi], self.far.up(sorted_), sorted_)
            return out if self.errors is None else out + self.errors[own, None] * v[own]
        out = np.zeros((hi - lo, v.shape[1]))
        for a in range(lo, hi, ROWS):
            z = min(hi, a + ROWS)
            for c in range(0, len(self.xyz), COLUMNS):
                out[a - lo : z - lo] += self.model.cov_np(self.xyz[a:z, None, :] - self.xyz[None, c : c + COLUMNS, :]) @ v[c : c + COLUMNS]
        return out if self.errors is None else out + self.errors[lo:hi, None] * v[lo:hi]

    def all(self, v: np.ndarray) -> np.ndarray:
        """K v."""
        out = np.empty_like(v)
        out[self.rows()] = self.product(0, len(v), v)
        return out

    def toward(self, targets: np.ndarray, v: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
        """Covariances of targets with the data, times v; by far fields, v must be the same each time."""
        if self.far is not None:
            sorted_ = v[self.far.order]
            if self.risen is None:
                self.risen = self.far.up(sorted_)
            out, known = np.full((len(targets), v.shape[1]), np.nan), np.isfinite(targets).all(axis=1)
            shifts = np.zeros((1, targets.shape[1])) if block is None else block
            out[known] = sum(self.far.at(targets[known] + o, self.risen, sorted_) for o in shifts) / len(shifts)
            return out
        out = np.zeros((len(targets), v.shape[1]))
        for a in range(0, len(targets), ROWS):
            for c in range(0, len(self.xyz), COLUMNS):
                out[a : a + ROWS] += self.covariances(targets[a : a + ROWS], self.xyz[c : c + COLUMNS], block) @ v[c : c + COLUMNS]
        return out

    def covariances(self, targets: np.ndarray, xyz: np.ndarray, block: np.ndarray | None) -> np.ndarray:
        out = np.zeros((len(targets), len(xyz)))
        for o in np.zeros((1, xyz.shape[1])) if block is None else block:
            for lo in range(0, len(out), LINES):
                t = targets[lo : lo + LINES] + o
                out[lo : lo + LINES] += farfield.covariance(self.model, t[:, :1] - xyz[:, 0], t[:, 1:] - xyz[:, 1]) if xyz.shape[1] == 2 else self.model.cov_np(t[:, None, :] - xyz[None])
        return out if block is None else out / len(block)

    def conditionals(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(neighbours, -1 where there are fewer; weights; spread) of the points from lo to hi, given points of the levels before."""
        near, weights = np.full((hi - lo, GIVEN), -1, np.int64), np.zeros((hi - lo, GIVEN))
        noise = np.zeros(len(self.xyz)) if self.errors is None else self.errors
        spread = self.model.total_sill() + noise[lo:hi]
        at = lo
        while at < hi:
            start = 1 << max(int(at).bit_length() - 1, 0) if at else 0  # this level's first point
            end = min(hi, max(2 * start, 1))
            if start:
                found = NeighborIndex(self.xyz[:start], np.arange(start)).query(self.xyz[at:end], min(GIVEN, start))
                q = np.stack(found)
                a = self.model.cov_np(self.xyz[q][:, :, None, :] - self.xyz[q][:, None, :, :])
                a[:, np.arange(q.shape[1]), np.arange(q.shape[1])] += noise[q]
                b = self.model.cov_np(self.xyz[at:end, None, :] - self.xyz[q])
                w = np.linalg.solve(a, b[..., None])[..., 0]
                near[at - lo : end - lo, : q.shape[1]], weights[at - lo : end - lo, : q.shape[1]] = q, w
                spread[at - lo : end - lo] -= (w * b).sum(axis=1)
            at = end
        return near, weights, np.maximum(spread, 1e-12)

    def precondition(self, r: np.ndarray) -> np.ndarray:
        """About K^-1 r."""
        near = np.maximum(self.near, 0)  # weights are 0 where there is none
        out = np.empty_like(r)
        for j in range(r.shape[1]):
            y = (r[:, j] - (self.weights * r[near, j]).sum(axis=1)) / self.spread
            out[:, j] = y - np.bincount(near.ravel(), (self.weights * y[:, None]).ravel(), len(y))
        return out

    def energy(self, r: np.ndarray) -> np.ndarray:
        """About r' K^-1 r of each column."""
        near, out = np.maximum(self.near, 0), np.empty(r.shape[1])
        for j in range(r.shape[1]):
            out[j] = ((r[:, j] - (self.weights * r[near, j]).sum(axis=1)) ** 2 / self.spread).sum()
        return out

    def around(self, targets: np.ndarray, most: int) -> np.ndarray:
        """Places of the data around targets, and of some at each coarser level: the first data are a random part of all.

        What is around is measured in the distance of a target's COUNTED-th nearest datum, as data may be dense here and sparse there.
        """
        n = len(self.xyz)
        if n <= most:
            return np.arange(n)
        near = np.full(n, np.inf)
        for some in groups(targets, -(-len(targets) // BOXES)):
            low, high = targets[some].min(axis=0), targets[some].max(axis=0)
            d2 = sum(np.maximum(np.maximum(low[i] - x, x - high[i]), 0) ** 2 for i, x in enumerate(self.xyz.T))
            np.minimum(near, d2 / max(np.partition(d2, 4 * COUNTED)[4 * COUNTED], 1e-300), out=near)

        def least(size: int, k: int) -> np.ndarray:
            if size <= k:
                return np.arange(size)
            some = np.argpartition(near[:size], 8 * k)[: 8 * k] if size > 8 * k else np.arange(size)
            d2 = sum((t[:, None] - x) ** 2 for t, x in zip(targets.T, self.xyz[some].T))
            at = min(COUNTED, len(some) - 1)
            d2 /= np.maximum(np.partition(d2, at, axis=1)[:, at : at + 1], 1e-300)
            return some[np.argpartition(d2.min(axis=0), k)[:k]]

        found, size = [least(n, most)], n // 4
        while size > COARSE:
            found.append(least(size, COARSE))
            size //= 4
        return np.unique(np.concatenate([*found, np.arange(min(COARSE, n))]))

    def residual(self, targets: np.ndarray, g: np.ndarray, at: np.ndarray, w: np.ndarray, block: np.ndarray | None, rough: bool = False) -> np.ndarray:
        """All data's covariances with targets, times g, less those with the data at these places, times w; rough: by far fields that are good enough for its energy."""
        out = np.empty((len(self.xyz), g.shape[1]))
        if rough and self.rough is not None:
            shifts = np.zeros((1, targets.shape[1])) if block is None else block
            far, v = self.rough, np.concatenate([-w, *[g / len(shifts)] * len(shifts)])
            own = farfield.FarField(np.concatenate([self.xyz[at], *[targets + o for o in shifts]]), far.model, far.low, far.side, max(2, far.depth - 1), far.p, far.over)
            v = v[own.order]
            out[far.order] = own.at(far.xyz, own.up(v), v)
        else:
            for lo in range(0, len(out), ROWS):
                some = self.xyz[lo : lo + ROWS]
                out[lo : lo + ROWS] = self.covariances(targets, some, block).T @ g - self.covariances(some, self.xyz[at], None) @ w
        if self.errors is not None:
            out[at] -= self.errors[at, None] * w
        return out

    def reduction(self, targets: np.ndarray, block: np.ndarray | None, alone: bool = False) -> np.ndarray:
        """c' K^-1 c of targets that lie together, c a target's covariances with all data; alone: they are few, and no system of fewer is tried."""
        enough = SMALL * self.model.total_sill()
        for most in (LARGEST,) if alone else (FIRST, LARGEST):
            at = self.around(targets, most)
            a = self.covariances(self.xyz[at], self.xyz[at], None)
            if self.errors is not None:
                a[np.arange(len(at)), np.arange(len(at))] += self.errors[at]
            c = self.covariances(targets, self.xyz[at], block).T
            try:
                w = np.linalg.solve(a, c)
            except np.linalg.LinAlgError:  # left to the gradients
                w = np.zeros(c.shape)
            out = (w * c).sum(axis=0)
            if len(at) == len(self.xyz) and w.any():
                return out
            if self.left(targets, at, w, block) <= enough:
                return out
        if not alone:  # most of it comes from the few targets that are farthest from data
            d2 = sum((t[:, None] - x) ** 2 for t, x in zip(targets.T, self.xyz[at].T))
            rest = np.argsort(-np.partition(d2, COUNTED, axis=1)[:, COUNTED], kind="stable")
            while len(rest):
                some, rest = rest[:FEW], rest[FEW:]
                out[some] = self.reduction(targets[some], block, True)
                if len(rest) and self.left(targets[rest], at, w[:, rest], block) <= enough:
                    break
            return out
        r = self.residual(targets, np.eye(len(targets)), at, w, block)
        bad = np.flatnonzero(self.energy(r) > enough / FEW)
        if len(bad):
            out[bad] += conjugate_gradients(self.all, self.precondition, r[:, bad], enough / FEW)[1]
        return out

    def left(self, targets: np.ndarray, at: np.ndarray, w: np.ndarray, block: np.ndarray | None) -> float:
        """About the sum of what these targets' reductions lack, w being their weights of the data at these places: the mean energy of sums of random sign."""
        signs = np.random.default_rng(11).choice([-1.0, 1.0], (len(targets), SIGNS))
        return float(self.energy(self.residual(targets, signs, at, w @ signs, block, True)).mean())


def groups(xyz: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of at most so many points that lie together, cut by halves along the longer side."""
    out, left = [], [np.arange(len(xyz))] if len(xyz) else []
    while left:
        some = left.pop()
        if len(some) <= max(most, 1):
            out.append(some)
            continue
        some = some[np.argsort(xyz[some, np.ptp(xyz[some], axis=0).argmax()], kind="stable")]
        left += [some[: len(some) // 2], some[len(some) // 2 :]]
    return out


def conjugate_gradients(product, precondition, b: np.ndarray, enough: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(K^-1 b, b' K^-1 b of each column), column by column side by side, until every residual is RESIDUAL of its column's size, or its energy at most enough."""
    x, r, form = np.zeros_like(b), b.copy(), np.zeros(b.shape[1])
    size = np.maximum(np.linalg.norm(b, axis=0), 1e-300)
    z = precondition(r)
    p, rz = z.copy(), (r * z).sum(axis=0)
    for _ in range(STEPS):
        if ((np.linalg.norm(r, axis=0) <= RESIDUAL * size) | (rz <= enough)).all():
            return x, form
        q = product(p)
        step = rz / np.where((p * q).sum(axis=0) == 0, 1.0, (p * q).sum(axis=0))
        x, r, form = x + step * p, r - step * q, form + step * rz
        z = precondition(r)
        after = (r * z).sum(axis=0)
        p, rz = z + after / np.where(rz == 0, 1.0, rz) * p, after
    raise SingularSystem(f"no solution within {STEPS} steps")


def krige_global(targets: DataFrame, data: DataFrame, model: VariogramModel, covariates: tuple[str, ...] = (), error: str | None = None, block: np.ndarray | None = None, key: str = "id", variance: bool = False, **options) -> DataFrame:
    """key, x, y[, z], prediction, variance, lagrange: as kriging.krige with all data as neighbours."""
    from .kriging import _engine, arrays_of, nulls

    if not fits(data, MOST_DATA):
        raise InvalidParameter(f"a global neighbourhood takes at most {MOST_DATA} points")
    if model.has_power:
        raise InvalidParameter("a power model takes a moving neighbourhood here")
    spark, names = targets.sparkSession, coords(data)
    p = arrays_of(data.select("id", *names, "value", *dict.fromkeys((*covariates, *([error] if error else [])))).toPandas(), names)
    engine = _engine(p, model, covariates, error, **options)  # checks, and the drift's functions
    n, order = len(p["id"]), np.random.default_rng(7).permutation(len(p["id"]))
    box = _box(targets, names, p["xyz"], block)
    far = [farfield.chosen(p["xyz"][order], model, *box, allowed) for allowed in ((None, ROUGH) if variance else (None,))]
    system = System(p["xyz"][order], model, None if engine.errors is None else engine.errors[order], *far)
    f = engine.basis(p["xyz"], engine.covariates)[order]
    z = (p["value"] - (engine.mean if engine.method == "simple" else 0.0))[order]

    tasks = max(1, min(-(-n // ROWS), 4 * spark.sparkContext.defaultParallelism))

    def ranges_of(tasks: int) -> DataFrame:
        edges = np.linspace(0, n, tasks + 1).astype(int)
        rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
        return spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task"), F.element_at(F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for _, a, b in rows]), (F.col("id") + 1).cast("int")).alias("r")).select("task", "r.lo", "r.hi")

    held = share(spark, system)

    def rows_of(task, width: int, ranges: DataFrame) -> np.ndarray:
        """task(system, lo, hi) of all ranges, one below the other."""

        def run(batches):
            own = shared(held)
            for b in batches:
                for lo, hi in zip(b["lo"].tolist(), b["hi"].tolist()):
                    yield pd.DataFrame({"lo": [lo], "rows": [np.ascontiguousarray(task(own, lo, hi), float).tobytes()]})

        found = ranges.mapInPandas(run, "lo long, rows binary").toArrow().to_pylist()  # n x width numbers
        return np.concatenate([np.frombuffer(r["rows"], float).reshape(-1, width) for r in sorted(found, key=lambda r: r["lo"])])

    parts = rows_of(lambda s, lo, hi: np.column_stack(s.conditionals(lo, hi)), 2 * GIVEN + 1, ranges_of(tasks))
    system.near, system.weights, system.spread = parts[:, :GIVEN].astype(np.int32), parts[:, GIVEN : 2 * GIVEN], parts[:, -1]

    # Each task of a product by far fields takes all values up, so there are no more than run at once.
    ranges, place = ranges_of(tasks if system.far is None else min(tasks, spark.sparkContext.defaultParallelism)), system.rows()

    def product(v: np.ndarray) -> np.ndarray:
        vector, out = share(spark, v), np.empty_like(v)
        out[place] = rows_of(lambda s, lo, hi: s.product(lo, hi, shared(vector)), v.shape[1], ranges)
        vector.destroy()
        return out

    solved, _ = conjugate_gradients(product, system.precondition, np.column_stack([z, f]))
    u, a = solved[:, 0], solved[:, 1:]
    if f.shape[1]:
        s = f.T @ a
        beta = np.linalg.solve(s, f.T @ u)
        alpha = u - a @ beta
    else:
        s, beta, alpha = np.zeros((0, 0)), np.zeros(0), u
    if not variance:
        system.near = system.weights = system.spread = None
    whole = share(spark, (system, engine, alpha, a, s, beta))

    def run(batches):
        system, engine, alpha, a, s, beta = shared(whole)
        base = engine.mean if engine.method == "simple" else 0.0
        for b in batches:
            at = b[names].to_numpy(float)
            covs = b[list(covariates)].to_numpy(float) if covariates else None
            if engine.method == "drift":
                covs = (covs - engine.c_mean) / engine.c_std
            ft = engine.basis(at, covs)
            products = system.toward(at, np.column_stack([alpha, a]), block)
            value = base + ft @ beta + products[:, 0]
            mu = np.linalg.solve(s, (products[:, 1:] - ft).T).T if len(s) else np.zeros((len(at), 0))
            spread = np.full(len(at), np.nan)
            if variance:
                own = system.model.total_sill() if block is None else _within(system.model, block)
                known = np.flatnonzero(np.isfinite(at).all(axis=1))
                for some in groups(at[known], GROUP):
                    w = known[some]
                    k = system.reduction(at[w], block)
                    spread[w] = np.maximum(own - (k - (products[w, 1:] * mu[w]).sum(axis=1)) - (mu[w] * ft[w]).sum(axis=1), 0)
            yield pd.DataFrame({key: b[key], **{c: b[c] for c in names}, "prediction": value, "variance": spread, "lagrange": mu[:, 0] if mu.shape[1] else np.full(len(at), np.nan)})

    schema = f"{key} long, {', '.join(f'{c} double' for c in names)}, prediction double, variance double, lagrange double"
    dealt = targets.select(key, *names, *covariates)
    if system.far is None and not variance:
        dealt = dealt.repartition(tasks)
    else:  # near targets together: they share their cells' far fields, and their variances' systems
        dim, side = len(names), max(float((box[1] - box[0]).max()), 1e-300)
        cells = [F.floor((F.col(c) - F.lit(float(lo))) * ((1 << BITS) / side)).cast("long") for c, lo in zip(names, box[0])]
        bits = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), dim * b + dim - 1 - k) for k, c in enumerate(cells) for b in range(BITS)]
        parts = spark.sparkContext.defaultParallelism * (SHARES if variance else 1)
        dealt = dealt.withColumn("_cell", sum(bits[1:], bits[0])).repartitionByRange(parts, "_cell", key).sortWithinPartitions("_cell", key).drop("_cell")
    return nulls(dealt.mapInPandas(run, schema), "prediction", "variance", "lagrange")


def _box(targets: DataFrame, names: list[str], xyz: np.ndarray, block: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners around the data and all targets with their blocks."""
    known = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    found = targets.agg(*[f(known(c)).alias(f"{n}_{c}") for c in names for n, f in (("min", F.min), ("max", F.max))]).first()
    corners = [xyz.min(axis=0), xyz.max(axis=0)]
    if found[0] is not None:
        ends = np.array([[found[f"{n}_{c}"] for c in names] for n in ("min", "max")], float)
        corners += [ends + o for o in (np.zeros((1, len(names))) if block is None else block)]
    corners = np.vstack(corners)
    return corners.min(axis=0), corners.max(axis=0)


def _within(model: VariogramModel, block: np.ndarray) -> float:
    """Mean covariance within a block; equal points don't take the nugget."""
    dh = block[:, None, :] - block[None, :, :]
    out = model.cov_np(dh)
    out[(dh == 0).all(axis=-1)] -= model.nugget
    return float(out.mean())

