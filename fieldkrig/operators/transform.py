"""Normal scores, tails, declustering, truncation thresholds, trends."""

from __future__ import annotations

import math
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientData, InvalidParameter
from ..functions.special import inv_norm_cdf, inv_norm_cdf_col, norm_cdf, norm_cdf_col
from ..sources.points import bbox, coords

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Ranges of values that totals in order of value are cut into, at most.
MAX_RANGES = 512


def _range_of(df: DataFrame, tie: str | None = None) -> Column:
    """A number for ranges of ``value`` that hold about equally many rows and rise with it.

    Equal values share one, unless tie is given: then a value that many rows hold is cut into ranges of that column.
    """
    k = min(MAX_RANGES, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.agg(F.percentile_approx("value", [i / k for i in range(1, k)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(cuts))
    number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("value"))) if bounds else F.lit(0)
    # A bound that stands m times among the cuts is the value of about m of k parts of the rows.
    hot = {v: m for v, m in Counter(cuts).items() if m > 1}
    if tie is None or not hot:
        return number
    part = F.lit(0)
    for r in df.filter(F.col("value").isin(list(hot))).groupBy("value").agg(F.percentile_approx(tie, [i / k for i in range(1, k)], 10_000).alias("cuts")).collect():  # at most k / 2 values
        own = sorted({r["cuts"][int(i * len(r["cuts"]) / hot[r["value"]])] for i in range(1, hot[r["value"]])})
        part = F.when(F.col("value") == r["value"], F.size(F.filter(F.array(*map(F.lit, own)), lambda b: b < F.col(tie))) if own else F.lit(0)).otherwise(part)
    return number * F.lit(MAX_RANGES) + part


def before_in_order(df: DataFrame, amount: Column) -> tuple[DataFrame, DataFrame]:
    """(df plus ``before``: the amount of all rows earlier by (value, id); one row, ``total``).

    Ranges of values, and of ids within a value that many rows hold, are summed first (at most 2 MAX_RANGES rows), then each range
    runs through its own rows, so no task orders the whole table, or all rows of one value.
    """
    rows = df.withColumn("_amount", amount).withColumn("_range", _range_of(df, "id"))
    sums = rows.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select("_range", earlier.alias("_start"))  # at most 2 MAX_RANGES rows
    own = F.coalesce(F.sum("_amount").over(Window.partitionBy("_range").orderBy("value", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = rows.withColumn("_own", own).join(F.broadcast(starts), "_range")
    return placed.withColumn("before", F.col("_start") + F.col("_own")).drop("_range", "_start", "_own", "_amount"), sums.agg(F.sum("_sum").alias("total"))


def normal_scores(df: DataFrame, weight: str | None = None) -> DataFrame:
    """The knots: value, score.  Plotting position (weight before + half the own) / total; equal values get their weighted mean score."""
    w = F.col(weight) if weight else F.lit(1.0)
    placed, total = before_in_order(df.withColumn("_w", w), F.col("_w"))
    p = (F.col("before") + F.col("_w") / 2) / F.col("total")
    return placed.crossJoin(F.broadcast(total)).groupBy("value").agg((F.sum(F.col("_w") * inv_norm_cdf_col(p)) / F.sum("_w")).alias("score"))


@dataclass(frozen=True)
class Tail:
    """kind: none, linear, power or hyperbolic (upper only); bound: the value at probability 0 or 1."""

    kind: str = "none"
    bound: float | None = None
    omega: float = 2.0

    @classmethod
    def parse(cls, text: str) -> Tail:
        kind, *rest = text.strip().lower().split(":")
        kind = {"hyper": "hyperbolic"}.get(kind, kind)
        if kind == "none":
            return cls()
        if kind not in ("linear", "power", "hyperbolic"):
            raise InvalidParameter(f"unknown tail {text!r}")
        default = 1.5 if kind == "hyperbolic" else 2.0
        if kind == "hyperbolic":
            return cls(kind, None, float(rest[0]) if rest else default)
        return cls(kind, float(rest[0]) if rest else None, float(rest[1]) if len(rest) > 1 else default)


def lower_tail(u, z, f, tail: Tail):
    """Quantile below the first knot (z at probability f), for u in (0, f)."""
    if tail.kind == "none":
        return np.full_like(u, z)
    return tail.bound + (z - tail.bound) * (u / f) ** (1 / tail.omega if tail.kind == "power" else 1.0)


def upper_tail(u, z, f, tail: Tail):
    """Quantile above the last knot (z at probability f), for u in (f, 1)."""
    if tail.kind == "none":
        return np.full_like(u, z)
    if tail.kind == "hyperbolic":
        return z * ((1 - f) / (1 - u)) ** (1 / tail.omega)
    return tail.bound - (tail.bound - z) * ((1 - u) / (1 - f)) ** (1 / tail.omega if tail.kind == "power" else 1.0)


def lower_tail_col(u: Column, z: Column, f: Column, tail: Tail) -> Column:
    return F.lit(float(tail.bound)) + (z - float(tail.bound)) * F.pow(u / f, F.lit(1 / tail.omega if tail.kind == "power" else 1.0))


def upper_tail_col(u: Column, z: Column, f: Column, tail: Tail) -> Column:
    if tail.kind == "hyperbolic":
        return z * F.pow((1 - f) / (1 - u), F.lit(1 / tail.omega))
    return F.lit(float(tail.bound)) - (F.lit(float(tail.bound)) - z) * F.pow((1 - u) / (1 - f), F.lit(1 / tail.omega if tail.kind == "power" else 1.0))


def tail_moments(z: float, f: float, tail: Tail, upper: bool) -> tuple[float, float]:
    """E[Z] and E[Z**2] over a tail's probability mass (not divided by it)."""
    mass = 1 - f if upper else f
    if tail.kind == "none" or mass <= 0:
        return mass * z, mass * z * z
    if tail.kind == "hyperbolic":
        first = float("inf") if tail.omega <= 1 else mass * z * tail.omega / (tail.omega - 1)
        second = float("inf") if tail.omega <= 2 else mass * z * z * tail.omega / (tail.omega - 2)
        return first, second
    a = 1 / tail.omega if tail.kind == "power" else 1.0
    b, d = tail.bound, z - tail.bound  # value = b + d t**a, t uniform in (0, 1)
    return mass * (b + d / (a + 1)), mass * (b * b + 2 * b * d / (a + 1) + d * d / (2 * a + 1))


class NormalScore:
    """Knots on the driver (one per distinct value) for kernels and plans."""

    def __init__(self, values, weights=None, lower: Tail = Tail(), upper: Tail = Tail()):
        values = np.asarray(values, float)
        weights = np.ones(len(values)) if weights is None else np.asarray(weights, float)
        order = np.argsort(values, kind="stable")
        v, w = values[order], weights[order]
        p = (np.cumsum(w) - w / 2) / w.sum()
        self.z, first = np.unique(v, return_index=True)
        if len(self.z) < 2:
            raise InsufficientData("normal scores need two distinct values")
        self.y = np.add.reduceat(w * inv_norm_cdf(p), first) / np.add.reduceat(w, first)
        self.lower, self.upper = lower, upper

    def forward(self, z):
        return np.interp(z, self.z, self.y)

    def back(self, y):
        y = np.asarray(y, float)
        out = np.interp(y, self.y, self.z)
        for below, end, tail, f in ((True, self.y[0], self.lower, lower_tail), (False, self.y[-1], self.upper, upper_tail)):
            far = y < end if below else y > end
            if tail.kind != "none" and far.any():
                out[far] = f(norm_cdf(y[far]), self.z[0 if below else -1], float(norm_cdf(end)), tail)
        return out


def _between(df: DataFrame, column: str, knots: DataFrame, x: str, y: str) -> DataFrame:
    """df plus the knots on either side of a value: _x0, _y0 (the last at most it) and _x1, _y1 (the first at least it).

    Rows and knots are merged in order within ranges of knots; a range also gets the last knot before and the first after it.
    """
    own = knots.select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    named = own.withColumn("value", F.col("_x"))
    number = _range_of(named)
    named = named.withColumn("_range", number)
    ends = named.groupBy("_range").agg(F.min(F.struct("_x", "_y")).alias("first"), F.max(F.struct("_x", "_y")).alias("last"))
    count = 1 + (named.agg(F.max("_range")).first()[0] or 0)  # at most MAX_RANGES
    every = df.sparkSession.range(count).select(F.col("id").cast("int").alias("_range")).join(ends, "_range", "left")
    before, after = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    edges = every.select("_range", F.last("last", ignorenulls=True).over(before).alias("a"), F.first("first", ignorenulls=True).over(after).alias("b"))
    points = named.select("_range", "_x", "_y").unionByName(edges.select("_range", F.explode(F.array_compact(F.array("a", "b"))).alias("e")).select("_range", "e._x", "e._y"))
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(column).alias("value")).withColumn("_range", number)
    # Ranges with many rows are dealt to several tasks, each with a copy of the range's knots.
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # at most MAX_RANGES
    mean = max(1.0, sum(sizes.values()) / max(len(sizes), 1))
    many = {k: -(-c // int(mean)) for k, c in sizes.items() if k is not None and c > 2 * mean}
    deals = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("_range")), F.lit(1)) if many else F.lit(1)
    rows = rows.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), deals).cast("int"))
    points = points.withColumn("_deal", F.explode(F.sequence(F.lit(0), (deals - 1).cast("int"))))
    merged = rows.select("_range", "_deal", F.col("value").alias("_at"), "_row", F.lit(None).cast("struct<x:double,y:double>").alias("_k"))
    merged = merged.unionByName(points.select("_range", "_deal", F.col("_x").alias("_at"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")).alias("_k")))
    up = Window.partitionBy("_range", "_deal").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("_range", "_deal").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    met = merged.select("_row", F.last("_k", ignorenulls=True).over(up).alias("_lo"), F.first("_k", ignorenulls=True).over(down).alias("_hi")).filter("_row is not null")
    return met.select("_row.*", F.col("_lo.x").alias("_x0"), F.col("_lo.y").alias("_y0"), F.col("_hi.x").alias("_x1"), F.col("_hi.y").alias("_y1"))


def _interpolated(df: DataFrame, column: str, knots: DataFrame, x: str, y: str, name: str, below: Column | None = None, above: Column | None = None) -> DataFrame:
    met = _between(df, column, knots, x, y)
    inside = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.when(F.col("_x1") > F.col("_x0"), (F.col(column) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))).otherwise(0.0)
    value = F.when(F.col(column).isNull(), None).when(F.col("_x0").isNull(), F.col("_y1") if below is None else below).when(F.col("_x1").isNull(), F.col("_y0") if above is None else above).otherwise(inside)
    return met.withColumn(name, value).drop("_x0", "_y0", "_x1", "_y1")


def forward_scores(df: DataFrame, knots: DataFrame, column: str = "value") -> DataFrame:
    """df plus ``score``: linear between knots (value, score), the end scores outside."""
    return _interpolated(df, column, knots, "value", "score", "score")


def back_scores(df: DataFrame, knots: DataFrame, lower: Tail = Tail(), upper: Tail = Tail(), column: str = "score") -> DataFrame:
    """df plus ``value``: linear between knots, tails outside (none: the end values)."""
    u = norm_cdf_col(F.col(column))
    low = None if lower.kind == "none" else lower_tail_col(u, F.col("_y1"), norm_cdf_col(F.col("_x1")), lower)
    high = None if upper.kind == "none" else upper_tail_col(u, F.col("_y0"), norm_cdf_col(F.col("_x0")), upper)
    return _interpolated(df, column, knots, "score", "value", "value", low, high)


def decluster(df: DataFrame, cell: float, n_offsets: int = 4) -> DataFrame:
    """df plus ``weight``: cell declustering over shifted grids; weights sum to n."""
    return decluster_many(df, [cell], n_offsets).drop("cell")


def decluster_many(df: DataFrame, cells: list[float], n_offsets: int = 4) -> DataFrame:
    """df's rows for each cell size, with ``cell`` and ``weight``: one aggregation for all sizes and offsets."""
    names, b, n = coords(df), bbox(df), df.count()
    options = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cell"), F.lit(o).alias("o")) for c in cells for o in range(n_offsets)]))
    rows = df.select("*", options.alias("_s"))
    place = F.struct(*[F.floor((F.col(c) - b[f"min_{c}"] + F.col("_s.cell") * F.col("_s.o") / n_offsets) / F.col("_s.cell")).alias(c) for c in names])
    rows = rows.withColumn("_at", place)
    counts = rows.groupBy("_s", "_at").agg(F.count(F.lit(1)).alias("_n"))
    occupied = counts.groupBy("_s").agg(F.count(F.lit(1)).alias("_cells"))
    met = rows.join(counts, ["_s", "_at"]).join(F.broadcast(occupied), "_s")  # one row per size and offset
    share = F.sum(1 / (F.col("_n") * F.col("_cells"))) * (n / n_offsets)
    return met.groupBy("id", *names, "value", F.col("_s.cell").alias("cell")).agg(share.alias("weight"))


def decluster_scan(df: DataFrame, cells: list[float], n_offsets: int = 4) -> DataFrame:
    """cell, mean: the declustered mean for each size."""
    return decluster_many(df, cells, n_offsets).groupBy("cell").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("mean"))


def best_cell(scan: DataFrame, minimum: bool = True) -> float:
    """The first size that improves strictly; sizes in rising order."""
    pick = F.min_by("cell", F.struct(F.col("mean") if minimum else -F.col("mean"), "cell"))
    return scan.agg(pick).first()[0]


def category_proportions(df: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """category, proportion for 0 .. k - 1."""
    w = F.col(weight) if weight else F.lit(1.0)
    seen = df.groupBy("category").agg(F.sum(w).alias("w"))
    total = seen.agg(F.sum("w").alias("total"))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("category"))
    return every.join(seen, "category", "left").crossJoin(F.broadcast(total)).select("category", (F.coalesce("w", F.lit(0.0)) / F.col("total")).alias("proportion"))


def truncation(proportions: DataFrame) -> DataFrame:
    """category, proportion, lower and upper threshold (NULL: none), pseudo (score of the middle of the class)."""
    w = Window.orderBy("category")
    upto = F.sum("proportion").over(w)
    rows = proportions.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("proportion")).withColumn("_last", F.lead("category").over(w).isNull())
    return rows.select(
        "category",
        "proportion",
        F.when(F.col("category") > 0, inv_norm_cdf_col(F.col("_from"))).alias("lower"),
        F.when(~F.col("_last"), inv_norm_cdf_col(F.col("_to"))).alias("upper"),
        inv_norm_cdf_col((F.col("_from") + F.col("_to")) / 2).alias("pseudo"),
    )


def classify_col(y: Column, thresholds: list[float]) -> Column:
    """Category of a Gaussian value; on a threshold the lower one."""
    return sum((F.when(y > t, 1).otherwise(0) for t in thresholds), F.lit(0)).cast("int")


def quantile_cutoffs(df: DataFrame, quantiles: list[float]) -> list[float]:
    """The value at place floor(q n) of the order (from 0, at most n - 1); exact.  Rows are counted by value, values by range, and only ranges that hold a place are ordered."""
    distinct = df.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    distinct = distinct.withColumn("_range", _range_of(distinct))
    sizes = sorted((r["_range"], r["n"]) for r in distinct.groupBy("_range").agg(F.sum("_n").alias("n")).collect())  # at most MAX_RANGES rows
    n = sum(c for _, c in sizes)
    if not n:
        raise InsufficientData("there are no values")
    places, wanted, start = {q: min(int(q * n), n - 1) for q in quantiles}, [], 0
    for number, c in sizes:
        wanted += [(number, p - start, p) for p in set(places.values()) if start <= p < start + c]
        start += c
    sought = F.broadcast(df.sparkSession.createDataFrame(wanted, "_range int, _own long, _place long"))  # one row a quantile
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = distinct.join(sought.select("_range").distinct(), "_range").withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
    found = {r["_place"]: r["value"] for r in ranked.join(sought, "_range").filter((F.col("_own") >= F.col("_from")) & (F.col("_own") < F.col("_to"))).collect()}
    return [found[places[q]] for q in quantiles]


def _triangles(batches, width: int):
    """The triangular factor of all rows of a task: of points (columns) or of other tasks' factors (packed)."""
    r = np.zeros((0, width))
    for b in batches:
        rows = np.concatenate([np.frombuffer(x, float).reshape(-1, width) for x in b["r"]]) if "r" in b.columns else b.to_numpy(float)
        r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
    yield pd.DataFrame({"r": [np.ascontiguousarray(r).tobytes()]})


def ols(df: DataFrame, terms: list[Column], y: str = "value") -> np.ndarray:
    """Coefficients of a linear trend by a QR of the tall matrix of terms: a small triangle a task, merged in two steps.

    Products of terms are never summed, so the condition number isn't squared.  Rows with a null are left out.
    """
    width = len(terms) + 2
    rows = df.select(F.lit(1.0).alias("t0"), *[t.cast("double").alias(f"t{i}") for i, t in enumerate(terms, 1)], F.col(y).cast("double").alias("y")).dropna()
    parts = rows.mapInPandas(lambda b: _triangles(b, width), "r binary")
    some = parts.repartition(max(1, math.isqrt(df.rdd.getNumPartitions()))).mapInPandas(lambda b: _triangles(b, width), "r binary")
    held = [np.frombuffer(x["r"], float).reshape(-1, width) for x in some.collect()]  # about the square root of the tasks' number
    r = np.linalg.qr(np.concatenate([np.zeros((0, width)), *held]), mode="r")
    n = width - 1
    size = np.sqrt((r[:, :n] ** 2).sum(axis=0))
    if len(r) < n or not (size > 0).all() or (np.abs(np.linalg.qr(r[:, :n] / size, mode="r").diagonal()) <= 1e-13).any():
        raise InsufficientData("the trend's terms are linearly dependent")
    return np.linalg.solve(r[:n, :n] / size, r[:n, n]) / size


def trend_col(coefficients, terms: list[Column]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, t in zip(coefficients[1:], terms):
        out = out + F.lit(float(c)) * t
    return out


def polynomial_terms(df: DataFrame, degree: int) -> list[Column]:
    """Monomials up to the degree in coordinates centred on the box and divided by its largest extent."""
    names, b = coords(df), bbox(df)
    scale = max(b[f"max_{c}"] - b[f"min_{c}"] for c in names) or 1.0
    u = [(F.col(c) - (b[f"min_{c}"] + b[f"max_{c}"]) / 2) / scale for c in names]
    out = list(u)
    if degree >= 2:
        out += [u[i] * u[j] for i in range(len(u)) for j in range(i, len(u))]
    return out


def detrend(df: DataFrame, terms: list[Column]) -> DataFrame:
    """df plus ``trend``, with value less the trend."""
    c = ols(df, terms)
    out = df.withColumn("trend", trend_col(c, terms))
    return out.withColumn("value", F.col("value") - F.col("trend"))


def collocated_stats(df: DataFrame) -> DataFrame:
    """One row: rho, std_primary, std_secondary (population)."""
    return df.agg(F.corr("value", "secondary").alias("rho"), F.stddev_pop("value").alias("std_primary"), F.stddev_pop("secondary").alias("std_secondary"))


def order_corrections_col(ccdf: Column) -> Column:
    """Clamped to [0, 1], then the mean of the running maximum from the left and minimum from the right."""
    c = F.transform(ccdf, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.transform(F.sequence(F.lit(1), F.size(ccdf)), lambda i: (F.array_max(F.slice(c, F.lit(1), i)) + F.array_min(F.slice(c, i, F.size(ccdf)))) / 2)
