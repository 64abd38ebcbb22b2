"""Counts, distances and products of increments by lag over all pairs in the plane, without most of the pairs.

Points lie in narrow square cells.  Where all distances between two cells fall into one lag, the pairs' sums follow from the cells' own:
counts, and sums of values and of their products; the distance by its Taylor series to the fourth order, at least NEAR cells off, so
to about 1e-10 of itself.  All cells that lie alike are summed at once, as a correlation of the cells' sums (a task for each tile of cells).
The other pairs, along the lags' edges and near by, are met one by one, with the tests that plans/blocks.py has: lags are exact.
Their number grows with the points to the power 1.5.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import coords
from .lineage import fits, share, shared

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points at least and at most; cells in a distance at most, points of a cell wanted, cells in all; cells off for a series; runs or pairs taken at once.
FEWEST, MOST, FINEST, WANTED, CELLS, NEAR, AT_ONCE = 20_000, 2_000_000, 400, 0.5, 48_000_000, 16, 1 << 17
ORDERS = [(i, j) for i in range(5) for j in range(5 - i)]


def _slopes(x: np.ndarray, y: np.ndarray) -> dict:
    """The distance's derivatives."""
    r2 = np.maximum(x * x + y * y, 1.0)
    r = np.sqrt(r2)
    r3, r5, r7, xx, yy, xy = r * r2, r * r2**2, r * r2**3, x * x, y * y, x * y
    return {
        (0, 0): r, (1, 0): x / r, (0, 1): y / r, (2, 0): yy / r3, (1, 1): -xy / r3, (0, 2): xx / r3,
        (3, 0): -3 * x * yy / r5, (2, 1): y * (2 * xx - yy) / r5, (1, 2): x * (2 * yy - xx) / r5, (0, 3): -3 * xx * y / r5,
        (4, 0): 3 * yy * (4 * xx - yy) / r7, (3, 1): xy * (9 * yy - 6 * xx) / r7, (2, 2): (2 * xx * xx - 11 * xx * yy + 2 * yy * yy) / r7, (1, 3): xy * (9 * xx - 6 * yy) / r7, (0, 4): 3 * xx * (4 * yy - xx) / r7,
    }


def _smooth(n: int) -> int:
    """The next size that transforms fast."""
    return min(2**a * 3**b * 5**c for a in range(15) for b in range(4) for c in range(3) if 2**a * 3**b * 5**c >= n)


class Cells:
    """Points in the order of their cells, row by row, and the cells' lags."""

    def __init__(self, xy: np.ndarray, values: np.ndarray, products: list[tuple[int, int]], max_dist: float, n_lags: int, width: float):
        self.products, self.max_dist, self.n_lags, self.width = products, max_dist, n_lags, width
        self.reach = int(math.ceil(max_dist / width)) + 2
        low = xy.min(axis=0)
        at = np.floor((xy - low) / width).astype(np.int64)
        self.rows, self.columns = int(at[:, 1].max()) + 1, int(at[:, 0].max()) + 1
        order = np.lexsort((at[:, 0], at[:, 1]))
        self.xy, self.values, at = xy[order], values[order] - values.mean(axis=0), at[order]
        self.row, self.column = at[:, 1], at[:, 0]
        self.x, self.y = (np.ascontiguousarray(self.xy[:, k]) for k in (0, 1))
        self.each = [np.ascontiguousarray(z) for z in self.values.T]
        self.off = (self.xy - low) / width - at - 0.5
        # Points before each cell; a margin of empty ones serves cells beyond the edge.
        self.wide = self.columns + 2 * self.reach + 2
        n = np.bincount(self.row * self.wide + self.column + self.reach, minlength=(self.rows + self.reach + 1) * self.wide)
        self.before = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)

    def lag(self, d: np.ndarray) -> np.ndarray:
        """As Pairs.lag."""
        out = d / (self.max_dist / self.n_lags)
        np.ceil(out, out=out)
        np.minimum(out, self.n_lags, out=out)
        out += d > self.max_dist
        return out.astype(np.intp)

    def lags(self) -> np.ndarray:
        """The lag of cells that lie j rows and i columns off (both from -reach): n_lags + 1 beyond, -1 where it isn't one."""
        k = np.abs(np.arange(-self.reach, self.reach + 1.0))
        least, most = (np.hypot(f[:, None], f[None, :]) * self.width for f in (np.maximum(k - 1, 0), k + 1))
        low, high = self.lag(least * (1 - 1e-9)), self.lag(most * (1 + 1e-9))
        return np.where((low == high) & ((np.hypot(k[:, None], k[None, :]) >= NEAR) | (low > self.n_lags)), low, -1)

    def tiles(self) -> list[tuple[int, int]]:
        side = self.reach
        return [(int(t) // 100_000, int(t) % 100_000) for t in np.unique(self.row // side * 100_000 + self.column // side)]

    def far(self, tile: tuple[int, int]) -> np.ndarray:
        """lags x (1 + 1 + products): sums over pairs of the tile's points with all others, in cells of one lag; each pair of both ends' tiles twice."""
        m, side = self.reach, _smooth(3 * self.reach)
        r, c = self.row - (tile[0] - 1) * m, self.column - (tile[1] - 1) * m
        around = np.flatnonzero((r >= 0) & (r < side) & (c >= 0) & (c < side))
        r, c = r[around], c[around]
        own = (r >= m) & (r < 2 * m) & (c >= m) & (c < 2 * m)
        u, v, z = self.off[around, 0], self.off[around, 1], self.values[around]

        def both(x):
            return tuple(np.fft.rfft2(np.bincount(r[s] * side + c[s], x[s], side * side).reshape(side, side)) for s in (own, slice(None)))

        lags = self.lags()
        inside = (lags >= 1) & (lags <= self.n_lags)
        codes = lags[inside]

        def sums(spectrum, factor=None):
            found = np.fft.irfft2(spectrum, (side, side))
            k = np.arange(-m, m + 1)
            found = found[np.ix_(k, k)][inside]
            return np.bincount(codes, found if factor is None else found * factor[inside], self.n_lags + 1)[1:]

        powers = {(i, j): both(u**i * v**j) for i, j in ORDERS}
        k = np.arange(-m, m + 1.0)
        slopes = _slopes(*np.broadcast_arrays(k[None, :], k[:, None]))
        n = powers[0, 0]
        out = np.zeros((self.n_lags, 2 + len(self.products)))
        out[:, 0] = np.rint(sums(np.conj(n[0]) * n[1]))
        for i, j in ORDERS:
            spectrum = sum((-1) ** (a + b) * math.comb(i, a) * math.comb(j, b) * np.conj(powers[a, b][0]) * powers[i - a, j - b][1] for a in range(i + 1) for b in range(j + 1))
            out[:, 1] += sums(spectrum, slopes[i, j]) * (self.width / (math.factorial(i) * math.factorial(j)))
        del powers, slopes
        single = {s: both(z[:, s]) for s in {s for p in self.products for s in p}}
        for q, (s, t) in enumerate(self.products):
            whole, a, b = both(z[:, s] * z[:, t]), single[s], single[t]
            out[:, 2 + q] = 0.5 * sums(np.conj(n[0]) * whole[1] + np.conj(whole[0]) * n[1] - np.conj(a[0]) * b[1] - np.conj(b[0]) * a[1])
        return out

    def runs(self) -> np.ndarray:
        """(rows off, first and last column off) of cells of no one lag, each pair of cells once."""
        m, out = self.reach, []
        lags = self.lags()
        for j in range(m + 1):
            loose = np.flatnonzero(np.diff(np.concatenate([[0], (lags[m + j] < 0) & ((j > 0) | (np.arange(-m, m + 1) >= 0)), [0]])))
            out += [(j, a - m, z - 1 - m) for a, z in zip(loose[::2], loose[1::2])]
        return np.array(out)

    def near(self, lo: int, hi: int) -> np.ndarray:
        """far()'s sums over the points lo to hi and those after them in cells of no one lag, each pair once."""
        runs, out = self.runs(), np.zeros((self.n_lags, 2 + len(self.products)))
        first, last = runs[:, 0] * self.wide + runs[:, 1], runs[:, 0] * self.wide + runs[:, 2] + 1
        step = max(1, AT_ONCE // len(runs))
        for a in range(lo, hi, step):
            own = np.arange(a, min(hi, a + step))
            cell = (self.row[own] * self.wide + self.column[own] + self.reach)[:, None]
            start, stop = self.before[cell + first], self.before[cell + last]
            start = np.where(runs[:, 0] == 0, np.maximum(start, own[:, None] + 1), start)
            n = np.maximum(stop - start, 0).ravel()
            some = np.flatnonzero(n)
            start, n, whose = start.ravel()[some], n[some], own[some // len(runs)]
            ends = np.cumsum(n)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, AT_ONCE), side="right"), len(n)))
            for x, y in zip(cuts[:-1], cuts[1:]):
                size = n[x:y]
                total = int(size.sum())
                one = whose[x:y]
                b = np.arange(total) + np.repeat(start[x:y] - (np.cumsum(size) - size), size)
                d = self.x[b] - np.repeat(self.x[one], size)
                e = self.y[b] - np.repeat(self.y[one], size)
                d *= d
                e *= e
                d += e
                np.sqrt(d, out=d)
                lag = self.lag(d)
                z = {s: self.each[s][b] - np.repeat(self.each[s][one], size) for s in {s for q in self.products for s in q}}
                terms = [None, d, *[0.5 * z[s] * z[t] for s, t in self.products]]
                for q, t in enumerate(terms):
                    out[:, q] += np.bincount(lag, t, self.n_lags + 2)[1 : self.n_lags + 1]
        return out


def product_sums(df: DataFrame, max_dist: float, n_lags: int, columns: tuple[str, ...], products: list[tuple[int, int]]) -> DataFrame | None:
    """bin (from 0), n, sums (of distances, and half the products of two columns' increments for each of products); None where plans/blocks.py must do it.

    That is in space, for few points or more than MOST, values that are null or not finite, and where points are too thin for cells.
    """
    names = coords(df)
    if len(names) != 2 or not fits(df, MOST):
        return None
    spark = df.sparkSession
    held = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate((*names, *columns))]).toArrow()
    if held.num_rows < FEWEST or any(c.null_count for c in held.columns):
        return None
    data = np.column_stack([c.to_numpy() for c in held.columns])
    if not np.isfinite(data).all():
        return None
    data = data[np.lexsort(data.T[::-1])]  # in one order, whatever the partitions
    middle = np.quantile(data[:, :2], [0.25, 0.75], axis=0)
    side = np.ptp(data[:, :2], axis=0)
    area = float(np.prod(np.maximum(np.minimum(2 * (middle[1] - middle[0]), side), max_dist / 100)))
    width = max(math.sqrt(WANTED * area / len(data)), max_dist / FINEST)
    if max_dist / width < 4 * n_lags or np.prod(side / width + 2 * max_dist / width + 8) > CELLS:
        return None
    cells = Cells(data[:, :2], data[:, 2:], products, max_dist, n_lags, width)
    tiles, tasks = cells.tiles(), 16 * spark.sparkContext.defaultParallelism
    edges = np.linspace(0, len(data), tasks + 1).astype(int).tolist()
    work = [("far", *t) for t in tiles] + [("near", a, z) for a, z in zip(edges[:-1], edges[1:]) if z > a]
    known = share(spark, (cells, work))

    def run(batches):
        cells, work = shared(known)
        for b in batches:
            for i in b.column("id").to_pylist():
                kind, x, y = work[i]
                found = cells.far((x, y)) if kind == "far" else cells.near(x, y)
                scale = 1 if kind == "far" else 2  # counts are of both directions
                k = np.flatnonzero(found[:, 0])
                sums = [(r * (scale / 2)).tolist() for r in found[k, 1:]]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array((found[k, 0] * scale).astype(np.int64)), pa.array(sums, pa.list_(pa.float64()))], ["bin", "n", "sums"])

    parts = spark.range(0, len(work), 1, len(work)).mapInArrow(run, "bin long, n long, sums array<double>")
    add = lambda i: F.aggregate(F.array_sort(F.collect_list(F.get("sums", F.lit(i)))), F.lit(0.0), lambda x, y: x + y)
    return parts.groupBy("bin").agg((F.sum("n") / 2).cast("long").alias("n"), F.array(*map(add, range(1 + len(products)))).alias("sums"))
