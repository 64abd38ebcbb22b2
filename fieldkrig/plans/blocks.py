"""Sums over all pairs of points within a distance, where pairs never become rows, and rows of pairs.

Points are gathered into blocks: up to ``BLOCK`` points of one cell (more where there are many points), as arrays.  Cells are as wide as the distance, or
wider where points are sparse.  Blocks of a cell and of half the cells around meet as (block, block) rows, made from
their numbers alone, so a crowded cell's many pairs of blocks are dealt out evenly; arrays
are joined to them afterwards.  A kernel takes two blocks in one call and adds to sums by bin; each task gives one row
a bin.  A task's sums are correctly rounded, and the tasks' are added in rising order, so results don't
hang on the order in which tasks end.  pair_rows gives rows instead: a bounded number at a time.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import bbox, coords
from .lineage import fits, share, shared, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points in a block, points for which cells are widened, and points of a cell that go to one task.
BLOCK, SPARSE, CROWDED = 1024, 128, 100_000
#: Blocks that all points are cut into at least where BLOCK is smaller, and points of a block at most then.
CUT, LARGEST = 128, 8192
#: Pairs that a kernel takes at once; bytes of blocks that are broadcast; tasks for each core.
AT_ONCE, BROADCAST, TASKS = 1 << 14, 128 << 20, 8


@dataclass(frozen=True)
class Pairs:
    """All pairs of some points with some others: columns of the first (down) and second points (across), coordinate differences (second less first), distance.

    Pairs that don't count, as they are met the other way round, have an infinite distance.
    """

    a: dict[str, np.ndarray]
    b: dict[str, np.ndarray]
    diff: list[np.ndarray]
    d: np.ndarray

    def lag(self, max_dist: float, n_lags: int) -> np.ndarray:
        """1 to n_lags; 0 at distance 0, n_lags + 1 beyond max_dist.  Bins are closed on the right."""
        out = self.d / (max_dist / n_lags)
        np.ceil(out, out=out)
        np.minimum(out, n_lags, out=out)
        out += self.d > max_dist
        return out.astype(np.intp)


def _pack(batches, names: list[str], columns: list[str], within: list[str], dim: int, size: int):
    """Rows sorted by cell become blocks."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    keys = [*within, *[f"_k{i}" for i in range(dim)]]
    for b in batches:
        if not b.num_rows:
            continue
        edge = np.zeros(b.num_rows, bool)
        edge[0] = True
        for k in keys:
            code = b.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edge[1:] |= code[1:] != code[:-1]
        run = np.flatnonzero(edge)
        starts = np.concatenate([np.arange(lo, hi, size) for lo, hi in zip(run, np.append(run[1:], b.num_rows))])
        ends = np.append(starts[1:], b.num_rows)
        packed = [np.ascontiguousarray(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cs], axis=1)) for cs in (names, columns)]
        at = pa.array(starts)
        out = [b.column(k).take(at) for k in keys] + [pa.array(number + np.arange(len(starts)))]
        out += [pa.array([p[lo:hi].tobytes() for lo, hi in zip(starts, ends)], pa.binary()) for p in packed]
        number += len(starts)
        yield pa.RecordBatch.from_arrays(out, [*keys, "block", "xyz", "values"])


def blocks(df: DataFrame, max_dist: float, columns: tuple[str, ...], within: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """(within, _k0, _k1 ..., block, xyz, values: a row for each block; the cells' width)."""
    names = coords(df)
    box = bbox(df)
    n, volume = df.count(), math.prod(max((box[f"max_{c}"] or 0.0) - (box[f"min_{c}"] or 0.0), max_dist) for c in names)
    width = max(max_dist, (volume * SPARSE / max(n, 1)) ** (1 / len(names)))
    cells = [f"_k{i}" for i in range(len(names))]
    placed = df.select(*within, "id", *names, *columns, *[F.floor(F.col(c) / F.lit(width)).cast("long").alias(k) for c, k in zip(names, cells)])
    crowded = placed.groupBy(*within, *cells).count().filter(F.col("count") > CROWDED).withColumnRenamed("count", "_n")
    if crowded.isEmpty():
        placed = placed.withColumn("_deal", F.lit(0).cast("long"))
    else:
        few = F.broadcast(crowded) if fits(crowded, 100_000) else crowded
        placed = placed.join(few, [*within, *cells], "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / CROWDED)), F.lit(0)).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join([*[f"`{w}` {kinds[w]}" for w in within], *[f"{k} long" for k in cells], "block long, xyz binary, values binary"])
    size = max(BLOCK, min(LARGEST, n // CUT))
    sorted_ = placed.repartition(*within, *cells, "_deal").sortWithinPartitions(*within, *cells, "id").select(*within, *cells, *names, *columns)
    return written(sorted_.mapInArrow(lambda b: _pack(b, names, list(columns), list(within), len(names), size), schema), "blocks"), width


@dataclass
class Sums:
    """Sums by bin of one group of a task: a list of partial sums for each."""

    n: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    parts: dict[int, list] = field(default_factory=lambda: defaultdict(list))

    def add(self, n: np.ndarray, sums: list[np.ndarray], base: int) -> None:
        """Counts and sums of the bins from base on."""
        for i in np.flatnonzero(n).tolist():
            k = base + i
            self.n[k] += int(n[i])
            if sums:
                self.parts[k].append([float(s[i]) for s in sums])
                if len(self.parts[k]) > 4096:  # memory stays bounded
                    self.parts[k] = [[math.fsum(c) for c in zip(*self.parts[k])]]

    def rows(self):
        for k in sorted(self.n):
            yield k, self.n[k], [math.fsum(c) for c in zip(*self.parts[k])]


class Counts:
    """Counts by bin where bins are many: sorted arrays."""

    def __init__(self):
        self.bins, self.n, self.new, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, bins: np.ndarray) -> None:
        self.new.append(bins)
        self.size += len(bins)
        if self.size > COUNTERS:
            self.fold()

    def fold(self) -> None:
        bins, n = np.unique(np.concatenate([*self.new, np.zeros(0, np.int64)]), return_counts=True)
        both, back = np.unique(np.concatenate([self.bins, bins]), return_inverse=True)
        self.n = np.bincount(back, np.concatenate([self.n, n]), len(both)).astype(np.int64)
        self.bins, self.new, self.size = both, [], 0


def _meet(ax: np.ndarray, av: np.ndarray, bx: np.ndarray, bv: np.ndarray, columns: list[str], own: bool):
    """All pairs of two blocks (of one: each once), some rows of the first at a time."""
    across = [np.ascontiguousarray(bx[:, c]) for c in range(bx.shape[1])]
    b = {c: np.ascontiguousarray(bv[:, j])[None, :] for j, c in enumerate(columns)}
    step = max(1, AT_ONCE // len(bx))
    for lo in range(0, len(ax), step):
        hi = min(lo + step, len(ax))
        diff = [x[None, :] - ax[lo:hi, c, None] for c, x in enumerate(across)]
        d = diff[0] * diff[0]
        for x in diff[1:]:
            d += x * x
        np.sqrt(d, out=d)
        if own:
            d[np.arange(len(bx))[None, :] <= np.arange(lo, hi)[:, None]] = np.inf
        yield Pairs({c: av[lo:hi, j, None] for j, c in enumerate(columns)}, b, diff, d)


def _task(batches, kernel, dim: int, columns: list[str], within: list[str]):
    groups: dict[tuple, Sums] = defaultdict(Sums)
    counts: dict[tuple, Counts] = defaultdict(Counts)
    kinds = None
    for batch in batches:
        kinds = [batch.schema.field(w).type for w in within]
        keys = list(zip(*[batch.column(w).to_pylist() for w in within])) if within else [()] * batch.num_rows
        own = batch.column("own").to_pylist()
        sides = [batch.column(c) for c in ("a_xyz", "a_values", "b_xyz", "b_values")]
        for i in range(batch.num_rows):
            arrays = [np.frombuffer(s[i].as_buffer(), float).reshape(-1, k) for s, k in zip(sides, (dim, len(columns), dim, len(columns)))]
            met: dict[tuple, list[np.ndarray]] = {}  # the two blocks' sums
            for pairs in _meet(*arrays, columns, own[i]):
                for codes, first, size, base, stats in kernel(pairs):
                    if size is None:
                        counts[keys[i]].add(codes)
                        continue
                    flat, end = codes.ravel(), first + size
                    found = [np.bincount(flat, minlength=end)[first:end], *[np.bincount(flat, s.ravel(), end)[first:end] for s in stats]]
                    held = met.setdefault((first, size, base), found)
                    if held is not found:
                        for x, y in zip(held, found):
                            x += y
            for (_, _, base), (n, *sums) in met.items():
                groups[keys[i]].add(n, sums, base)
    if kinds is None:
        return
    types = [*kinds, pa.int64(), pa.int64(), pa.list_(pa.float64())]
    names = [*within, "bin", "n", "sums"]
    rows = [(*g, k, n, s) for g, sums in groups.items() for k, n, s in sums.rows()]
    columns_ = list(zip(*rows)) if rows else [()] * (len(within) + 3)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns_, types)], names)
    for g, c in counts.items():
        c.fold()
        some = [pa.array([x] * len(c.bins), t) for x, t in zip(g, kinds)]
        yield pa.RecordBatch.from_arrays([*some, pa.array(c.bins), pa.array(c.n), pa.array([[]] * len(c.bins), types[-1])], names)


def _dim(packed: DataFrame) -> int:
    return sum(c.startswith("_k") and c[2:].isdigit() for c in packed.columns)


def _met_blocks(packed: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """within, own, a_xyz, a_values, b_xyz, b_values: each two blocks of a cell, or of neighbouring cells, once; own: a block meets itself."""
    spark = packed.sparkSession
    cells = [c for c in packed.columns if c.startswith("_k") and c[2:].isdigit()]
    dim = len(cells)
    half = [o for o in itertools.product((-1, 0, 1), repeat=dim) if o >= (0,) * dim]
    narrow = packed.select(*within, *cells, "block")
    near = F.explode(F.array(*[F.struct(*[(F.col(c) + v).alias(f"k{i}") for i, (c, v) in enumerate(zip(cells, o))], F.lit(not any(o)).alias("same")) for o in half]))
    a = narrow.select(*within, F.col("block").alias("_a"), near.alias("_o")).select(*within, "_a", F.col("_o.same").alias("_same"), *[F.col(f"_o.k{i}").alias(c) for i, c in enumerate(cells)])
    met = a.join(narrow.withColumnRenamed("block", "_b"), [*within, *cells]).filter("not _same or _a <= _b").select(*within, "_a", "_b")
    left = packed.select(F.col("block").alias("_a"), F.col("xyz").alias("a_xyz"), F.col("values").alias("a_values"))
    right = packed.select(F.col("block").alias("_b"), F.col("xyz").alias("b_xyz"), F.col("values").alias("b_values"))
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("xyz") + F.length("values")), F.lit(0)).alias("bytes")).first()
    # Few bytes take long here, so the number of tasks is set and not left to their size.
    tasks = max(1, min(TASKS * spark.sparkContext.defaultParallelism, 2 * size["n"]))
    if size["bytes"] <= BROADCAST:
        rows = met.repartition(tasks, "_a", "_b").join(F.broadcast(left), "_a").join(F.broadcast(right), "_b")
    else:
        rows = met.join(left, "_a").join(right, "_b").repartition(tasks, "_a", "_b")
    return rows.select(*within, (F.col("_a") == F.col("_b")).alias("own"), "a_xyz", "a_values", "b_xyz", "b_values")


def sum_pairs(packed: DataFrame, columns: tuple[str, ...], kernel, stats: int, within: tuple[str, ...] = ()) -> DataFrame:
    """within, bin, n, sums (array of ``stats``): over all pairs of equal ``within``, each once, of the blocks of a cell and of the cells around it.

    packed: from blocks(), of cells not narrower than any distance that counts.  kernel(pairs) gives (codes, first, size, base, [values ...]) any number of times:
    a code and values for each pair; codes from first on stand for size bins from base on, others don't count.  Where size is None, codes are bins to be counted, one for each pair that does.
    """
    spark, dim, rows = packed.sparkSession, _dim(packed), _met_blocks(packed, within)
    held = share(spark, kernel)
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join([*[f"`{w}` {kinds[w]}" for w in within], "bin long, n long, sums array<double>"])
    parts = rows.mapInArrow(lambda b: _task(b, shared(held), dim, list(columns), list(within)), schema)
    # A row a task and bin: they are added in rising order.
    add = lambda i: F.aggregate(F.array_sort(F.collect_list(F.get("sums", F.lit(i)))), F.lit(0.0), lambda x, y: x + y)
    return parts.groupBy(*within, "bin").agg(F.sum("n").alias("n"), F.array(*map(add, range(stats))).alias("sums") if stats else F.array().cast("array<double>").alias("sums"))


#: Rows that are held and ordered at once, and rows of a batch.
HELD, SENT = 1 << 20, 1 << 17


def _rows(batches, kernel, dim: int, columns: list[str], names: list[str]):
    """pair_rows' rows of a task."""

    def sent(found):
        held = [np.concatenate(c) for c in zip(*found)]
        order = np.argsort(held[0])
        for lo in range(0, len(order), SENT):
            at = order[lo : lo + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in held], names)

    found, n = [], 0
    for batch in batches:
        own = batch.column("own").to_pylist()
        sides = [batch.column(c) for c in ("a_xyz", "a_values", "b_xyz", "b_values")]
        for i in range(batch.num_rows):
            arrays = [np.frombuffer(s[i].as_buffer(), float).reshape(-1, k) for s, k in zip(sides, (dim, len(columns), dim, len(columns)))]
            for pairs in _meet(*arrays, columns, own[i]):
                some = kernel(pairs)
                if not len(some[0]):
                    continue
                found.append(some)
                n += len(some[0])
                if n >= HELD or len(found) >= HELD >> 6:  # small arrays take memory, too
                    yield from sent(found)
                    found, n = [], 0
    if n:
        yield from sent(found)


def pair_rows(packed: DataFrame, columns: tuple[str, ...], kernel, schema: str) -> DataFrame:
    """Rows of pairs, each pair met once, of the blocks of a cell and of the cells around it.

    packed: from blocks(), of cells not narrower than any distance that counts.  kernel(pairs) gives an array for each field of schema.
    Of a task's rows each HELD rise by the first field, so that equal values lie together and take few bytes where rows are written.
    """
    held, dim = share(packed.sparkSession, kernel), _dim(packed)
    names = [f.split()[0] for f in schema.split(", ")]
    return _met_blocks(packed, ()).mapInArrow(lambda b: _rows(b, shared(held), dim, list(columns), names), schema)


#: Loose counts that a task holds; parts that a pass cuts a range into, as bits; values left that are counted one by one.
COUNTERS, CUTS, LAST = 1 << 20, 13, 1 << 22
#: Points whose pairs say where medians should lie, the share of a bin's values to either side of them, and the pairs that a bin needs for it.
SAMPLED, ASIDE, ENOUGH = 3000, 0.04, 400
#: Bits of a value's place within its range, where it is a bin of its own.
PLACE = 44


def _likely(packed: DataFrame, columns: tuple[str, ...], value, n_bins: int) -> np.ndarray:
    """A range of bits for each bin, which should hold the median; all bits where too few pairs say so."""
    dim = _dim(packed)
    points = packed.agg(F.coalesce(F.sum(F.length("xyz")), F.lit(0))).first()[0] // (8 * dim)
    step = max(1, -(-points // SAMPLED))

    def some(batches):
        for b in batches:
            for number, x, v in zip(b.column("block").to_pylist(), b.column("xyz"), b.column("values")):
                at = slice(number % step, None, step)
                x, v = (np.frombuffer(y.as_buffer(), float).reshape(-1, k)[at] for y, k in ((x, dim), (v, len(columns))))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], ["xyz", "values"])

    rows = packed.select("block", "xyz", "values").mapInArrow(some, "xyz binary, values binary").toArrow()
    x, v = (np.frombuffer(b"".join(rows.column(c).to_pylist()), float).reshape(-1, k) for c, k in (("xyz", dim), ("values", len(columns))))
    found: list[list] = [[] for _ in range(n_bins + 1)]
    if len(x) > 1:
        for pairs in _meet(x, v, x, v, list(columns), True):
            codes, values = value(pairs)
            for k in range(1, n_bins + 1):
                found[k].append(np.abs(values[codes == k]))
    out = np.tile(np.array([0, np.iinfo(np.int64).max]), (n_bins, 1))
    for k in range(n_bins):
        own = np.concatenate([*found[k + 1], np.zeros(0)])
        if len(own) >= ENOUGH:
            out[k] = np.quantile(own, [0.5 - ASIDE, 0.5 + ASIDE], method="nearest").view(np.int64) + [0, 1]
    return out


def middle_values(packed: DataFrame, columns: tuple[str, ...], value, n_bins: int) -> dict[int, float]:
    """The exact median of ``value`` (not negative) in each bin, over all pairs; value(pairs) gives codes (1 to n_bins, others don't count) and values.

    Doubles that aren't negative rise with their bits.  A pass counts the values below, and by parts within, each bin's range of bits that
    should hold its middle places; then the part that does hold them is the range.  The first range comes from a few points' pairs; if it
    misses, the counts say on which side to go on.  When few values are left within the ranges each is counted, so a bin's values are never held, whatever their number.
    """
    # For each bin and each of its two middle places: the range (its end is beyond it), and the values below it if known.
    low, end = (np.repeat(c[:, None], 2, axis=1) for c in _likely(packed, columns, value, n_bins).T)
    below = np.where(low == 0, 0, -1)
    rank, left, total = np.zeros((n_bins, 2), np.int64), np.full(n_bins, -1), None
    out: dict[tuple[int, int], int] = {}
    whole = np.iinfo(np.int64).max
    while True:
        open_ = np.array([[total is None or (total[k] > 0 and (k, j) not in out) for j in (0, 1)] for k in range(n_bins)])
        if not open_.any():
            break
        both = open_ & np.c_[np.ones(n_bins, bool), (low[:, 0] != low[:, 1]) | (end[:, 0] != end[:, 1])]  # one count serves equal ranges
        both[:, 1] |= open_[:, 1] & ~open_[:, 0]
        width = np.where(both, end - low, 0)
        single = total is not None and (left >= 0).all() and left.sum() <= LAST and width.max() <= 1 << PLACE
        shift = np.zeros_like(low) if single else np.maximum(np.array([[int(w).bit_length() for w in row] for row in width]) - CUTS, 0)
        ask = total is None
        edge = np.zeros((2, n_bins + 2), np.int64)
        span, cut = np.zeros((2, n_bins + 2), np.uint64), np.zeros((2, n_bins + 2), np.int64)
        edge[:, 1:-1], span[:, 1:-1], cut[:, 1:-1] = low.T, width.T.astype(np.uint64), shift.T
        unknown = bool((both & (below < 0)).any())
        sets = [j for j in (0, 1) if both[:, j].any()]

        def kernel(pairs, edge=edge, span=span, cut=cut, sets=sets, ask=ask, unknown=unknown):
            codes, values = value(pairs)
            bits = np.abs(values).view(np.int64)
            if ask:
                yield codes, 1, n_bins, 0, []
            for j in sets:
                at = bits - edge[j][codes]
                hit = np.flatnonzero((at.view(np.uint64) < span[j][codes]).ravel())
                own = codes.ravel()[hit]
                yield ((own - 1) * 2 + j + 1 << PLACE) + (at.ravel()[hit] >> cut[j][own]), None, None, None, []
                if unknown:
                    yield np.where(at < 0, codes, 0), 1, n_bins, (1 + j) * n_bins, []

        found = sum_pairs(packed, columns, kernel, 0).select("bin", "n").toArrow().to_pandas().sort_values("bin")
        bins, n = found["bin"].to_numpy(), found["n"].to_numpy()
        loose = np.searchsorted(bins, 1 << PLACE)
        plain = dict(zip(bins[:loose].tolist(), n[:loose].tolist()))
        if ask:
            total = np.array([plain.get(k, 0) for k in range(n_bins)])
            rank = np.stack([(total - 1) // 2, total // 2], axis=1)
        left = np.zeros(n_bins, np.int64)
        # The second place first: it may have been counted by the first one's range.
        for j, k in sorted(zip(*np.nonzero(open_.T)), reverse=True):
            k, j = int(k), int(j)
            if not total[k]:
                continue
            source = j if both[k, j] else 0
            known = int(below[k, source]) if below[k, source] >= 0 else plain.get((1 + source) * n_bins + k, 0)
            parts = slice(*np.searchsorted(bins, [k * 2 + source + 1 << PLACE, k * 2 + source + 2 << PLACE]))
            upto = np.cumsum(n[parts])
            inside = int(upto[-1]) if len(upto) else 0
            start, stop, s, place = int(low[k, source]), int(end[k, source]), int(shift[k, source]), int(rank[k, j]) - known
            if place < 0:  # the range lies too high
                low[k, j], end[k, j], below[k, j] = 0, start, 0
                left[k] += known
            elif place >= inside:  # too low
                low[k, j], end[k, j], below[k, j] = stop, whole, known + inside
                left[k] += total[k] - known - inside
            else:
                i = int(np.searchsorted(upto, place, side="right"))
                part, own = int(bins[parts][i]) & (1 << PLACE) - 1, int(n[parts][i])
                low[k, j], end[k, j], below[k, j] = start + (part << s), min(stop, start + (part + 1 << s)), known + int(upto[i]) - own
                left[k] += own
                if end[k, j] - low[k, j] == 1:
                    out[k, j] = int(low[k, j])
    exact = {at: float(np.array([p], np.int64).view(float)[0]) for at, p in out.items()}
    return {k: (exact[k, 0] + exact[k, 1]) / 2 for k, j in exact if j == 0}
