"""Pair and neighbour joins.

``pair_join`` turns the join "closer than max_dist" into an equi-join on cells of
that size: a point meets the points of its own cell and, each pair of cells once, of half the
cells around, so it scales with the number of close pairs and not with n squared.  Salted
copies of a crowded cell keep one cell from filling one task.

``knn_join`` finds the k nearest data points.  Up to ``broadcast_points`` data points
(a checked bound) their coordinates are broadcast and each task answers its targets;
beyond it, tiles of targets meet the leaves of data that they need (tiles.py).
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.points import bbox, coords
from .lineage import share, shared
from .tiles import Reach, tile_map

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_POINTS = 1_000_000


def distance(names: list[str], a: str = "a_", b: str = "b_") -> Column:
    return F.sqrt(sum(((F.col(b + c) - F.col(a + c)) * (F.col(b + c) - F.col(a + c)) for c in names[1:]), (F.col(b + names[0]) - F.col(a + names[0])) * (F.col(b + names[0]) - F.col(a + names[0]))))


def pair_join(df: DataFrame, max_dist: float | None, columns: tuple[str, ...] = ("value",), within: tuple[str, ...] = (), salts: int = 8) -> DataFrame:
    """Each pair of rows once (a_id < b_id): a_*, b_*, d; d <= max_dist.

    within: columns on which both rows agree (realization, cutoff ...).  Rows need a
    unique id (within those).  max_dist None is the box's diagonal, so gives all n (n - 1) / 2 pairs: for small sets only.
    """
    names = coords(df)
    kept = ["id", *names, *columns]
    if max_dist is None:
        box = bbox(df)
        max_dist = 1.001 * sum(((box[f"max_{c}"] or 0.0) - (box[f"min_{c}"] or 0.0)) ** 2 for c in names) ** 0.5 or 1.0
    cell = [F.floor(F.col(c) / F.lit(float(max_dist))).cast("long") for c in names]
    based = df.select(*within, *kept, *[k.alias(f"_c{i}") for i, k in enumerate(cell)], F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"))
    half = [o for o in itertools.product((-1, 0, 1), repeat=len(names)) if o >= (0,) * len(names)]
    near = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in half])
    a = based.select(*within, *[F.col(c).alias(f"a_{c}") for c in kept], "_salt", F.explode(near).alias("_o"), *[F.col(f"_c{i}") for i in range(len(names))])
    own = sum((F.when(F.col(f"_o.o{i}") == 0, 0).otherwise(1) for i in range(len(names))), F.lit(0)) == 0
    a = a.select(*within, *[f"a_{c}" for c in kept], "_salt", own.alias("_own"), *[(F.col(f"_c{i}") + F.col(f"_o.o{i}")).alias(f"_k{i}") for i in range(len(names))])
    b = based.select(*within, *[F.col(c).alias(f"b_{c}") for c in kept], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), *[F.col(f"_c{i}").alias(f"_k{i}") for i in range(len(names))])
    met = a.join(b, [*within, "_salt", *[f"_k{i}" for i in range(len(names))]])
    met = met.filter(~F.col("_own") | (F.col("a_id") < F.col("b_id"))).withColumn("d", distance(names)).filter(F.col("d") <= max_dist)
    # Pairs across cells are found from one side only; put the smaller id first.
    swap = F.col("a_id") > F.col("b_id")
    sides = [x for c in kept for x in (F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}"), F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}"))]
    return met.select(*within, *sides, "d")


def cross_pairs(left: DataFrame, right: DataFrame, max_dist: float, salts: int = 8) -> DataFrame:
    """Radius join: a_* of left, b_* of right, d <= max_dist, by cells of that size; a cell's left rows are dealt to salts, so that a crowded one is no single task."""
    names = coords(left)
    around = list(itertools.product((-1, 0, 1), repeat=len(names)))
    cell = lambda c: F.floor(F.col(c) / F.lit(float(max_dist))).cast("long")
    near = F.explode(F.array(*[F.struct(*[(cell(c) + o).alias(f"k{i}") for i, (c, o) in enumerate(zip(names, off))]) for off in around]))
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns], F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"), near.alias("_k"))
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.struct(*[cell(c).alias(f"k{i}") for i, c in enumerate(names)]).alias("_k"))
    return a.join(b, ["_k", "_salt"]).drop("_k", "_salt").withColumn("d", distance(names)).filter(F.col("d") <= max_dist)


#: Data points in a cell of the index, about.
CELL_POINTS = 4


class NeighborIndex:
    """k nearest points by (distance, id) with radius, per-sector quota, exclusion.

    Points lie in cells in order; targets of one cell share their candidates, the points of
    the cells around up to some ring.  Within the distance to the ring's edge the answer is certain; a target
    that needs more goes on with twice the ring.  Where a ring would hold most points, all are candidates.
    """

    def __init__(self, xyz: np.ndarray, ids: np.ndarray, transform: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.order, self.ids = order, ids[order]
        self.transform = transform
        self.xyz = xyz[order] if transform is None else xyz[order] @ transform.T
        n, dim = self.xyz.shape
        self.low, self.side = (self.xyz.min(axis=0), np.ptp(self.xyz, axis=0)) if n else (np.zeros(dim), np.zeros(dim))
        live = self.side > 1e-9 * max(self.side.max(), 1e-300)
        self.cell = float((np.prod(self.side[live]) * CELL_POINTS / max(n, 1)) ** (1 / live.sum())) if live.any() else 1.0
        self.cell = max(self.cell, float(self.side.max()) / 4096, 1e-300)
        self.shape = np.floor(self.side / self.cell).astype(np.int64) + 1
        flat = self._flat(self._cells(self.xyz)) if n else np.zeros(0, np.int64)
        self.by_cell = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[self.by_cell], np.arange(int(np.prod(self.shape)) + 1))

    def _cells(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((p - self.low) / self.cell).astype(np.int64), 0, self.shape - 1)

    def _flat(self, c: np.ndarray) -> np.ndarray:
        out = c[..., 0]
        for k in range(1, c.shape[-1]):
            out = out * self.shape[k] + c[..., k]
        return out

    def _around(self, cell: np.ndarray, ring: int) -> np.ndarray:
        """Positions of the points in cells up to ``ring`` away, rising; rows of cells lie together."""
        lo, hi = np.maximum(cell - ring, 0), np.minimum(cell + ring, self.shape - 1)
        rows = self._flat(np.stack([g.ravel() for g in np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(lo[:-1], hi[:-1])], [lo[-1]], indexing="ij")], axis=-1))
        begin, end = self.starts[rows], self.starts[rows + (hi[-1] - lo[-1]) + 1]
        n = end - begin
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        return np.sort(self.by_cell[at])

    def query(self, targets: np.ndarray, k: int | None, radius: float | None = None, per_sector: int | None = None, exclude: np.ndarray | None = None, groups: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
        """For each target the positions (in the caller's order) of its neighbours, nearest first.

        exclude: an id for each target to leave out; groups: (data group, target
        group), data of the target's own group are left out.
        """
        t = targets if self.transform is None else targets @ self.transform.T
        n, out = len(self.xyz), [np.zeros(0, int)] * len(t)
        if not n or not len(t):
            return out
        data_groups = None if groups is None else groups[0][self.order]
        cells = self._cells(t)
        # A cell's ring of 1 or 2 holds about 9 or 25 (27 or 125) cells' points.
        ring = 1 if k is None else max(1, int(np.ceil(((2.0 * k / CELL_POINTS) ** (1 / t.shape[1]) - 1) / 2)))
        todo = np.argsort(self._flat(cells), kind="stable")
        while len(todo):
            whole = k is None and radius is None or 2 * ring + 1 >= self.shape.max()
            if radius is not None and not whole:
                ring = min(ring, int(radius / self.cell) + 2)
            key = np.zeros(len(todo), np.int64) if whole else self._flat(cells[todo])
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            again = []
            for a, b in zip(edge[:-1], edge[1:]):
                near = np.arange(n) if whole else self._around(cells[todo[a]], ring)
                step = max(1, 1_000_000 // max(1, len(near)))
                for lo in range(a, b, step):
                    some = todo[lo : min(b, lo + step)]
                    again.append(self._answer(t, some, near, cells[some[0]], np.inf if whole else ring, k, radius, per_sector, exclude, groups, data_groups, out))
            todo, ring = np.concatenate(again), ring * 2
        return out

    def _answer(self, t, some, near, cell, ring, k, radius, per_sector, exclude, groups, data_groups, out) -> np.ndarray:
        """Fills out for the targets whose answer is certain; returns the others."""
        d2 = ((t[some][:, None, :] - self.xyz[near][None, :, :]) ** 2).sum(axis=-1)
        if exclude is not None:
            d2[self.ids[near][None, :] == exclude[some][:, None]] = np.inf
        if data_groups is not None:
            d2[data_groups[near][None, :] == groups[1][some][:, None]] = np.inf
        if radius is not None:
            d2[d2 > radius * radius] = np.inf
        if np.isinf(ring):
            sure = np.full(len(some), np.inf)
        else:  # how far a target is from what its candidates leave out
            lo, hi = (cell - ring) * self.cell + self.low, (cell + ring + 1) * self.cell + self.low
            sure = np.minimum(np.where(cell - ring <= 0, np.inf, t[some] - lo), np.where(cell + ring >= self.shape - 1, np.inf, hi - t[some])).min(axis=1)
            sure = np.where(sure > 0, sure * sure * (1 - 1e-12), 0.0)
        if radius is not None:
            sure = np.where(sure >= radius * radius, np.inf, sure)
        want = len(near) if k is None or per_sector is not None else min(k, len(near))
        if want < len(near):
            kth = np.partition(d2, want - 1, axis=1)[:, want - 1]
            done = (kth < sure) | np.isinf(sure)
            # Ties at the k-th place go to the smaller id: take in all that tie, then sort; candidates rise by id.
            hit = (d2 <= kth[:, None]) & np.isfinite(d2)
            row, at = np.nonzero(hit)
            order = np.lexsort((at, d2[row, at], row))
            row, at = row[order], at[order]
            first = np.searchsorted(row, np.arange(len(some) + 1))
            for i in np.flatnonzero(done):
                out[some[i]] = self.order[near[at[first[i] : min(first[i + 1], first[i] + k)]]]
            return some[~done]
        done = np.zeros(len(some), bool)
        for i in range(len(some)):
            found = np.flatnonzero(np.isfinite(d2[i]))
            found = found[np.argsort(d2[i][found], kind="stable")]
            if per_sector is not None:
                sector = ((self.xyz[near[found]] >= t[some[i]]) * (1 << np.arange(t.shape[1]))).sum(axis=1)
                rank = np.zeros(len(found), int)
                for s in np.unique(sector):
                    rank[sector == s] = np.arange((sector == s).sum())
                found = found[rank < per_sector]
            found = found if k is None else found[:k]
            done[i] = np.isinf(sure[i]) or (k is not None and len(found) == k and d2[i][found[-1]] < sure[i])
            if done[i]:
                out[some[i]] = self.order[near[found]]
        return some[~done]


def knn_join(targets: DataFrame, data: DataFrame, k: int, radius: float | None = None, exclude_self: bool = False, broadcast_points: int = BROADCAST_POINTS, per_sector: int | None = None, matrix: np.ndarray | None = None) -> DataFrame:
    """target_id, id, rank (from 1), d: the k nearest data points of each target, by (d, id).

    per_sector: at most so many of each quadrant or octant; matrix: distances and sectors are those of this frame.
    """
    names = coords(data)
    known, aimed = data.select("id", *names), targets.select("id", *names)
    schema = "target_id long, id long, rank int, d double"
    if known.limit(broadcast_points + 1).count() > broadcast_points:
        reach = Reach(k, radius, per_sector, matrix, int(exclude_self))

        def kernel(own: pd.DataFrame, around: list[pd.DataFrame]) -> pd.DataFrame:
            index = NeighborIndex(around[0][names].to_numpy(float), around[0]["id"].to_numpy(), matrix)
            return _neighbors(index, own["id"].to_numpy(), own[names].to_numpy(float), k, radius, per_sector, exclude_self)

        return tile_map(aimed, [known], names, reach, kernel, schema)
    held = known.toPandas()
    points = share(targets.sparkSession, NeighborIndex(held[names].to_numpy(float), held["id"].to_numpy(), matrix))

    def find(batches):
        index = shared(points)
        for b in batches:
            yield _neighbors(index, b["id"].to_numpy(), b[names].to_numpy(float), k, radius, per_sector, exclude_self)

    return aimed.mapInPandas(find, schema)


def _neighbors(index: NeighborIndex, own: np.ndarray, at: np.ndarray, k: int, radius: float | None, per_sector: int | None, exclude_self: bool) -> pd.DataFrame:
    """knn_join's rows of some targets."""
    back = np.empty(len(index.order), int)
    back[index.order] = np.arange(len(back))
    found = index.query(at, k, radius, per_sector, exclude=own if exclude_self else None)
    sizes = [len(f) for f in found]
    flat = back[np.concatenate(found)] if found else np.zeros(0, int)
    rows = np.repeat(np.arange(len(own)), sizes)
    u = at if index.transform is None else at @ index.transform.T
    return pd.DataFrame({"target_id": own[rows], "id": index.ids[flat], "rank": np.concatenate([np.arange(1, s + 1) for s in sizes]) if sizes else flat, "d": np.sqrt(((index.xyz[flat] - u[rows]) ** 2).sum(axis=1))})
