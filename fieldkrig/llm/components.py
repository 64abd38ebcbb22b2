"""Connected components of an edge table, by contraction.

Each round hooks every vertex to its smallest neighbour, halves the paths twice,
relabels the edges and drops loops, so the vertices at least halve.  Tables stay
distributed; each round is written to the shared folder.  Once at most FEW_EDGES are
left, one task finishes them.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, map_arrow, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Edges that one task may hold (some 10 MB).
FEW_EDGES = 100_000


def _stars(edges, centres: bool = False) -> pa.RecordBatch:
    """A star around the smallest vertex for each component of the edges; with centres, each centre as its own edge too."""
    parent: dict[int, int] = {}

    def root(v):
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent.setdefault(p, p)
        return v

    for x, y in edges:
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(v, r) for v in list(parent) if (r := root(v)) != v or centres]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["x", "y"])


def _forest(batches):
    """The same connections batch by batch, with no more edges than vertices."""
    for b in batches:
        yield _stars(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))


def _whole(batches):
    yield _stars((e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), centres=True)


def components(edges: DataFrame) -> DataFrame:
    """edges: x, y (long).  Returns v, component (the smallest vertex of v's component), for the vertices of edges."""
    edges = written(map_arrow(edges.select("x", "y").filter("x <> y"), _forest, "x long, y long").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        few = fits(edges, FEW_EDGES)
        if few:
            hooked = written(map_arrow(edges.coalesce(1), _whole, "x long, y long").toDF("v", "p"), "hooked")
        else:
            both = edges.union(edges.select("y", "x"))
            hooked = both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("p"))
            for _ in range(2):
                hooked = written(hooked, "hooked")
                up = hooked.select(F.col("v").alias("p"), F.col("p").alias("pp"))
                hooked = hooked.join(up, "p").select("v", F.col("pp").alias("p"))
            hooked = written(hooked, "hooked")
        new = hooked.select(F.col("v").alias("component"), F.col("p").alias("_p"))
        if label is None:
            label = hooked.select("v", F.col("p").alias("component"))
        else:
            label = written(label.join(new, "component", "left").select("v", F.coalesce("_p", "component").alias("component")), "label")
        if few:
            break
        px, py = hooked.select(F.col("v").alias("x"), F.col("p").alias("_x")), hooked.select(F.col("v").alias("y"), F.col("p").alias("_y"))
        edges = written(edges.join(px, "x").join(py, "y").select(F.col("_x").alias("x"), F.col("_y").alias("y")).filter("x <> y").distinct(), "edges")
    if label is None:
        return edges.select(F.col("x").alias("v"), F.col("y").alias("component"))
    return label
