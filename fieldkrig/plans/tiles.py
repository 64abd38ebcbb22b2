"""Neighbourhoods for data of any number: tiles of targets meet the data around them.

A k-d tree grown from a bounded sample cuts space into leaves of about equally many data.  Its cuts, and a
directory of the leaves (bounding box and count: at most ``MOST_LEAVES`` rows), go to every task.  For the targets of a leaf the directory
says how far their neighbours can be: within the least distance to which leaves with enough data reach.  Leaves
nearer than that are needed; with quotas for sectors this is asked for each sector, in an ellipsoid's frame the leaves lie in that frame.
A tile (some neighbouring leaves' targets) then gets the data of all leaves it needs, in one exchange, and runs
the same kernel that a broadcast of the whole set would feed.  Tiles with many targets are dealt to several tasks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import fits, share, shared

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Data in a leaf (about), leaves at most, sampled points for each leaf, leaves of a tile (a power of two as an exponent), targets of a task.
LEAF, MOST_LEAVES, SAMPLED, TILE, TILE_TARGETS = 256, 1 << 16, 16, 4, 20_000
#: Rows of (tile, leaf) that may be broadcast.
MOST_NEEDS = 1_000_000


@dataclass(frozen=True)
class Reach:
    """What a target's neighbourhood is: the k nearest, within a radius, at most per_sector of each sector, in the frame of a matrix.

    spare: data that may not count (1 where a target leaves itself out); group: column of data and targets, those of the own group don't count.
    """

    k: int | None = None
    radius: float | None = None
    per_sector: int | None = None
    matrix: np.ndarray | None = None
    spare: int = 0
    group: str | None = None


class Tree:
    """Cuts of a full binary tree; a point goes right where its coordinate on a node's axis is greater than the cut."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int8), np.zeros((1 << depth) - 1)
        parts = [sample]
        for level in range(depth):
            below = []
            for i, own in enumerate(parts, (1 << level) - 1):
                if len(own):
                    self.axis[i] = np.ptp(own, axis=0).argmax()
                    x = own[:, self.axis[i]]
                    self.cut[i] = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
                    below += [own[x <= self.cut[i]], own[x > self.cut[i]]]
                else:
                    below += [own, own]
            parts = below

    def leaf(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (p[np.arange(len(p)), self.axis[at]] > self.cut[at])
        return at - ((1 << self.depth) - 1)


def grow(data: DataFrame, names: list[str], matrix: np.ndarray | None, n: int, groups: int = 1) -> Tree:
    leaves = min(MOST_LEAVES, (1 << 24) // max(groups, 1), max(1, -(-n // LEAF)))
    depth = max(0, (leaves - 1).bit_length())
    want = SAMPLED << depth
    some = data.select(*names) if n <= want else data.select(*names).sample(min(1.0, 1.2 * want / n), seed=7).limit(2 * want)
    p = np.column_stack([c.to_numpy() for c in some.toArrow().columns]) if n else np.zeros((0, len(names)))
    return Tree(p if matrix is None else p @ matrix.T, depth)


def _placed(df: DataFrame, names: list[str], tree, matrix: np.ndarray | None) -> DataFrame:
    """df with _leaf and the coordinates in the frame, _u0, _u1 ..."""
    dim = len(names)

    def run(batches):
        own = shared(tree)
        for b in batches:
            p = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)
            u = p if matrix is None else p @ matrix.T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.leaf(u).astype(np.int32)), *[pa.array(np.ascontiguousarray(u[:, i])) for i in range(dim)]], [*b.schema.names, "_leaf", *[f"_u{i}" for i in range(dim)]])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "_leaf int", *[f"_u{i} double" for i in range(dim)]])
    return df.mapInArrow(run, fields)


def _boxes(dim: int) -> list[Column]:
    return [f(f"_u{i}").alias(f"{n}{i}") for i in range(dim) for n, f in (("lo", F.min), ("hi", F.max))]


@dataclass(frozen=True)
class Directory:
    """Leaves of one data set: number, box, count, and counts by group."""

    leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    own: dict

    def within(self, lo: np.ndarray, hi: np.ndarray, reach: Reach) -> float:
        """The least squared distance within which every target in the box has k data."""
        most = (np.maximum(self.hi - lo, hi - self.lo) ** 2).sum(axis=1)
        order = np.argsort(most, kind="stable")
        at = np.searchsorted(np.cumsum(self.n[order]), reach.k + reach.spare)
        return most[order[at]] * (1 + 1e-9) if at < len(order) else np.inf

    def nearer(self, lo: np.ndarray, hi: np.ndarray, bound: float) -> np.ndarray:
        """Leaves that have data within the bound, as a squared distance, of a target in the box."""
        return self.leaf[(np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0) ** 2).sum(axis=1) <= bound]

    def needed(self, lo: np.ndarray, hi: np.ndarray, group, reach: Reach) -> np.ndarray:
        """Leaves that may hold neighbours of a target in the box."""
        least = (np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0) ** 2).sum(axis=1)
        most = (np.maximum(self.hi - lo, hi - self.lo) ** 2).sum(axis=1)
        n = self.n if group is None or group not in self.own else self.n - self.own[group]
        end = np.inf if reach.radius is None else reach.radius**2 * (1 + 1e-9)

        def bound(inside: np.ndarray, want: int) -> float:
            """The least distance within which leaves have so many data."""
            order = inside[np.argsort(most[inside], kind="stable")]
            at = np.searchsorted(np.cumsum(n[order]), want)
            return most[order[at]] * (1 + 1e-9) if at < len(order) else np.inf

        every = np.arange(len(self.leaf))
        if reach.per_sector is None:
            return self.leaf[least <= min(end, bound(every, reach.k + reach.spare) if reach.k is not None else np.inf)]
        out = np.zeros(len(every), bool)
        for s in range(1 << len(lo)):
            up = np.array([s >> i & 1 for i in range(len(lo))], bool)
            whole = np.where(up, self.lo >= hi, self.hi < lo).all(axis=1)
            touched = np.where(up, self.hi >= lo, self.lo < hi).all(axis=1)
            out |= touched & (least <= min(end, bound(every[whole], reach.per_sector + reach.spare)))
        return self.leaf[out]


def _directory(placed: DataFrame, dim: int, group: str | None) -> Directory:
    rows = placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n"), *_boxes(dim)).toArrow().to_pandas().sort_values("_leaf")  # at most MOST_LEAVES
    own = {}
    if group is not None:
        at = {leaf: i for i, leaf in enumerate(rows["_leaf"].tolist())}
        for r in placed.groupBy(group, "_leaf").count().toArrow().to_pylist():
            own.setdefault(r[group], np.zeros(len(rows), np.int64))[at[r["_leaf"]]] = r["count"]
    return Directory(rows["_leaf"].to_numpy(np.int32), rows[[f"lo{i}" for i in range(dim)]].to_numpy(float), rows[[f"hi{i}" for i in range(dim)]].to_numpy(float), rows["n"].to_numpy(np.int64), own)


def tile_map(targets: DataFrame, data: list[DataFrame], names: list[str], reach: Reach, kernel, schema: str, bound_by: int | None = None) -> DataFrame:
    """kernel(targets, [data ...]) of each tile, as pandas frames; gives pandas frames of the schema.

    data: sets of equal columns (coordinates, id ...).  Every set holds all that a target of the tile can have as neighbours, and other rows.
    bound_by: the set that says how far the k nearest are at most, for all sets (as where another set's rows may not count).
    """
    spark, dim = targets.sparkSession, len(names)
    sizes = [d.count() for d in data]
    groups = data[0].select(reach.group).distinct().count() if reach.group else 1
    largest = max(range(len(data)), key=sizes.__getitem__)
    tree = share(spark, grow(data[largest], names, reach.matrix, sizes[largest], groups))
    placed = [_placed(d, names, tree, reach.matrix) for d in data]
    directories = share(spark, [_directory(p, dim, reach.group) for p in placed])
    aimed = _placed(targets, names, tree, reach.matrix).withColumn("_tile", F.shiftright("_leaf", TILE))
    crowd = aimed.groupBy("_tile").count().filter(F.col("count") > TILE_TARGETS).collect()  # at most a tile each
    deals = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in crowd for x in (r["_tile"], -(-r["count"] // TILE_TARGETS))]), F.col("_tile")), F.lit(1)) if crowd else F.lit(1)
    group = [reach.group] if reach.group else []

    def needs(frames):
        own = shared(directories)
        for b in frames:
            low, high = b[[f"lo{i}" for i in range(dim)]].to_numpy(float), b[[f"hi{i}" for i in range(dim)]].to_numpy(float)
            found = [(t, v, x) for t, lo, hi, g in zip(b["_tile"].tolist(), low, high, b[reach.group].tolist() if group else [None] * len(b)) for v, d in enumerate(own) if len(d.leaf) for x in (d.needed(lo, hi, g, reach) if bound_by is None else d.nearer(lo, hi, own[bound_by].within(lo, hi, reach))).tolist()]
            yield pd.DataFrame(found, columns=["_tile", "_v", "_leaf"]).drop_duplicates()

    units = aimed.groupBy("_tile", "_leaf", *group).agg(*_boxes(dim)).drop("_leaf")
    pairs = units.mapInPandas(needs, "_tile int, _v int, _leaf int").distinct()
    pairs = pairs.withColumn("_deal", F.explode(F.sequence(F.lit(0), (deals - 1).cast("int"))))
    drop = [f"_u{i}" for i in range(dim)]
    every = None
    for v, p in enumerate(placed):
        p = p.drop(*drop).withColumn("_v", F.lit(v))
        every = p if every is None else every.unionByName(p)
    around = every.join(F.broadcast(pairs) if fits(pairs, MOST_NEEDS) else pairs, ["_v", "_leaf"]).drop("_leaf")
    aimed = aimed.drop("_leaf", *drop).withColumn("_deal", F.pmod(F.monotonically_increasing_id(), deals).cast("int"))
    count = len(data)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t, d = left.drop_columns(["_tile", "_deal"]).to_pandas(), right.drop_columns(["_tile", "_deal"]).to_pandas()
        out = [kernel(t, [d[d["_v"] == v].drop(columns="_v") for v in range(count)])] if len(t) else []
        return pa.concat_tables([pa.Table.from_pandas(x, schema=arrow, preserve_index=False) for x in out]) if out else arrow.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return aimed.groupBy("_tile", "_deal").cogroup(around.groupBy("_tile", "_deal")).applyInArrow(run, schema)
