"""The nearest neighbours among those that come earlier in an order, for points of any number.

Positions are cut into levels, each as large as all before it.  A level's points look among all points of earlier
levels, which bound how far their nearest predecessors can be, and among the earlier ones of their own level within that
bound.  So there are as many joins as the number of points has bits, and no point meets all before it.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import coords
from .pairs import NeighborIndex
from .tiles import Reach, tile_map

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Positions of the first level, which one task compares with one another; cells of a matrix of distances.
FIRST, CELLS = 1024, 2_000_000
SCHEMA = "pos long, neighbor long, rank int, d double"


def _nearest(own: pd.DataFrame, before: pd.DataFrame, level: pd.DataFrame, names: list[str], m: int) -> pd.DataFrame:
    """Rows of SCHEMA.  before: points that all precede; level: points of which the earlier ones do."""
    at, pos = own[names].to_numpy(float), own["pos"].to_numpy()
    known, xyz = before["pos"].to_numpy(), before[names].to_numpy(float)
    index = NeighborIndex(xyz, known)
    far, other = level[names].to_numpy(float), level["pos"].to_numpy()
    out = []
    step = max(1, CELLS // max(1, len(other)))
    found = index.query(at, m)
    for lo in range(0, len(at), step):
        d2 = ((at[lo : lo + step, None, :] - far[None]) ** 2).sum(axis=-1)
        d2[other[None, :] >= pos[lo : lo + step, None]] = np.inf
        for i, row in enumerate(d2, lo):
            some = np.flatnonzero(np.isfinite(row))
            ids = np.concatenate([known[found[i]], other[some]])
            dist = np.concatenate([((xyz[found[i]] - at[i]) ** 2).sum(axis=1), row[some]])
            best = np.lexsort((ids, dist))[:m]
            out.append((np.full(len(best), pos[i]), ids[best], np.arange(1, len(best) + 1), np.sqrt(dist[best])))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
    return pd.DataFrame(dict(zip(("pos", "neighbor", "rank", "d"), columns)))


def predecessor_join(points: DataFrame, m: int, n: int) -> DataFrame:
    """pos, neighbor, rank (from 1), d: of each point the m nearest by (d, pos) among those of smaller pos.

    points: pos (each of 0 .. n - 1 once) and coordinates.
    """
    names = coords(points)
    rows = points.select("pos", *names)

    def first(frames):
        held = pd.concat([*frames, pd.DataFrame({c: [] for c in ("pos", *names)})])
        yield _nearest(held, held.iloc[:0], held, names, m)

    out = rows.filter(F.col("pos") < FIRST).coalesce(1).mapInPandas(first, SCHEMA)
    low = FIRST
    while low < n:
        own = rows.filter((F.col("pos") >= low) & (F.col("pos") < 2 * low))
        out = out.unionByName(tile_map(own, [rows.filter(F.col("pos") < low), own], names, Reach(k=min(m, low)), lambda t, d: _nearest(t, *d, names, m), SCHEMA, bound_by=0))
        low *= 2
    return out
