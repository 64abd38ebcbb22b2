"""Point tables: id, coordinates, one value; validation, grids, CSV and model files."""

from __future__ import annotations

import sys
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DuplicatePoints, InvalidParameter
from ..functions.models import VariogramModel

from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def coords(df: DataFrame) -> list[str]:
    return ["x", "y", "z"] if "z" in df.columns else ["x", "y"]


def points(df: DataFrame, x: str, y: str, value: str | None = None, z: str | None = None, id: str | None = None, extras: tuple[str, ...] = ()) -> DataFrame:
    """Project to (id, x, y[, z][, value][, extras]); a missing column is named with those that exist."""
    for c in (x, y, z, value, id, *extras):
        if c is not None and c not in df.columns:
            raise InvalidParameter(f"no column {c!r}; there are: {', '.join(df.columns)}")
    number = lambda c, name: F.col(f"`{c}`").cast("double").alias(name)
    key = F.col(f"`{id}`").cast("long") if id else F.monotonically_increasing_id()
    out = [key.alias("id"), number(x, "x"), number(y, "y")]
    if z:
        out.append(number(z, "z"))
    if value:
        out.append(number(value, "value"))
    return df.select(*out, *[number(c, c) for c in extras])


def read_csv(spark: SparkSession, path: str, x: str, y: str, value: str | None = None, z: str | None = None, extras: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(points without rows that lack a number, how many rows were skipped)."""
    raw = spark.read.csv(path, header=True)
    named = points(raw.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if c in (x, y, z, value, *extras) else F.col(f"`{c}`") for c in raw.columns]), x, y, value, z, None, extras)
    kept = named.dropna()
    return kept, raw.count() - kept.count()


def validate_points(df: DataFrame, unique: bool = False) -> int:
    """The number of points; raises on no points, on values that aren't finite and, if asked, on equal coordinates."""
    names = [*coords(df), *(["value"] if "value" in df.columns else [])]
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 1).otherwise(0) for c in names), F.lit(0))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad")).first()
    if not seen["n"]:
        raise InvalidParameter("there are no points")
    if seen["bad"]:
        raise InvalidParameter("coordinates and values must be finite")
    if unique and not duplicates(df).isEmpty():
        raise DuplicatePoints("two points have the same coordinates")
    return seen["n"]


def duplicates(df: DataFrame) -> DataFrame:
    """Coordinates that occur more than once, with their count."""
    return df.groupBy(*coords(df)).agg(F.count(F.lit(1)).alias("n_points")).filter("n_points > 1")


def bbox(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in coords(df) for n, f in (("min", F.min), ("max", F.max))]).first()
    return row.asDict()


def diagonal(df: DataFrame) -> float:
    b = bbox(df)
    return math.sqrt(sum((b[f"max_{c}"] - b[f"min_{c}"]) ** 2 for c in coords(df)))


@dataclass(frozen=True)
class Grid:
    """A regular grid: origin is the lower edge, nodes are cell centres, x runs fastest."""

    origin: tuple[float, ...]
    size: tuple[float, ...]
    n: tuple[int, ...]

    @classmethod
    def from_bbox(cls, low, high, n) -> Grid:
        if any(k < 1 for k in n) or any(b <= a for a, b in zip(low, high)):
            raise InvalidParameter("a grid needs cells and an extent on every axis")
        return cls(tuple(low), tuple((b - a) / k for a, b, k in zip(low, high, n)), tuple(n))

    @classmethod
    def with_resolution(cls, low, high, resolution: float) -> Grid:
        """Cells of equal sides; the extent grows to whole cells."""
        if resolution <= 0:
            raise InvalidParameter("the resolution must be positive")
        n = tuple(max(1, math.ceil((b - a) / resolution)) for a, b in zip(low, high))
        return cls(tuple(low), (resolution,) * len(n), n)

    @property
    def cells(self) -> int:
        return math.prod(self.n)

    def frame(self, spark: SparkSession) -> DataFrame:
        """node, ix, iy[, iz], x, y[, z]"""
        out = spark.range(self.cells).withColumnRenamed("id", "node")
        step = 1
        for axis, k in zip("xyz", self.n):
            out = out.withColumn(f"i{axis}", (F.floor(F.col("node") / step) % k).cast("int"))
            step *= k
        return out.select("node", *[f"i{a}" for a in "xyz"[: len(self.n)]], *[(F.lit(o) + (F.col(f"i{a}") + 0.5) * F.lit(s)).alias(a) for a, o, s in zip("xyz", self.origin, self.size)])

    def cell_of(self, *c: Column) -> list[Column]:
        return [F.floor((v - F.lit(o)) / F.lit(s)).cast("int") for v, o, s in zip(c, self.origin, self.size)]


def sample_raster(targets: DataFrame, raster: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """targets plus ``sampled``, the value of the cell they lie in; null outside and where the raster has none.  An equi-join on cell numbers."""
    ix, iy = grid.cell_of(F.col("x"), F.col("y"))
    cells = raster.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.when(~F.isnan(value), F.col(value)).alias("sampled"))
    return targets.withColumns({"_cx": ix, "_cy": iy}).join(cells, (F.col("_cx") == F.col("_ix")) & (F.col("_cy") == F.col("_iy")), "left").drop("_cx", "_cy", "_ix", "_iy")


def read_model(path: str) -> VariogramModel:
    with open(path, encoding="utf-8") as f:
        return VariogramModel.from_json(f.read())


def write_model(model: VariogramModel, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(model.to_json()), indent=2))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header, one per partition."""
    df.write.mode("overwrite").csv(path, header=True)


def wide_simulations(sims: DataFrame, realizations: int) -> DataFrame:
    """node, x, y[, z], sim1 .. simN from the long form."""
    keys = ["node", *coords(sims)]
    wide = sims.groupBy(*keys).pivot("realization", list(range(realizations))).agg(F.first("value"))
    return wide.select(*keys, *[F.col(str(i)).alias(f"sim{i + 1}") for i in range(realizations)])


def wide_ccdf(ik: DataFrame, cutoffs: int) -> DataFrame:
    return ik.select(*coords(ik), *[F.get("ccdf", k).alias(f"F_{k + 1}") for k in range(cutoffs)], "e_type", "cond_var")


def row_index(df: DataFrame, *order: str) -> Column:
    """1-based position in an order, for small tables such as lag bins."""
    return F.row_number().over(Window.orderBy(*order))
