"""Vector codes: a short code of small integers for each vector (product quantization), learned and assigned exactly in integers.

Components become integers (floor of ``scale`` times the value); a vector is cut into equal parts, and each place of a
part has a codebook.  A round assigns every part to its nearest entry and moves each entry to the
floor of its parts' mean.  Sums of a task's parts are added up by Spark; only codebooks and their sums (parts x entries rows) reach the driver.

Assignment is by memoised grid cells.  A part lies in a coarse cell; the cell's box bounds from below and above how
far it can be from each entry.  An entry whose least distance is greater than another's greatest is dominated across
the box, and so is one that is farther than the entry of the least greatest distance at each of the box's points; the others are kept for that cell, and only they are evaluated, exactly.  A task keeps the lists of up to
``MEMO_CELLS`` cells of each place, by hash; the cell itself is compared too, so equal hashes change nothing.

Rows whose vector is null, or holds a null or a value that isn't finite, go.  The vectors' length is that of the
smallest kept vec_id; vectors of another length get null code and errors, take no part in learning, and stay.  Ties of vec_id are
ordered by vector, null vec_ids come last; rows that repeat count as often as they occur.  With fewer rows than entries a codebook is smaller.
Empty table: no rows.  Integers may be of any size below MOST (those too large for 64-bit sums go by Python's own, exactly);
an error beyond 64 bits is null and counts in no sum.  A length that parts don't divide, or a value of MOST and more, raises ValueError.
"""

from __future__ import annotations

import hashlib
import math
import sys
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_kernel as bk
from .common import map_arrow, share, shared, small_side, written
from .packing import HashTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells that a task remembers for each place, rows that it works on at a time, and the bound of integers.
MEMO_CELLS, ROWS, MOST = 1 << 16, 4096, 10**50
#: A sum is high * UNIT + low, so that 38 digits hold each.
UNIT = 10**18


class Cells:
    """Nearest entries of one codebook (entries x width, 64-bit integers)."""

    def __init__(self, book: np.ndarray):
        self.book = book
        # Half of what the entries span: in each direction two or three cells hold most parts.
        self.edge = max(1, int(np.ptp(book, axis=0).mean()) // 2)
        self.forget()

    def forget(self) -> None:
        self.memo = HashTable()
        self.cells = np.zeros((0, self.book.shape[1]), np.int64)
        self.open = np.zeros((0, len(self.book)), bool)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries aren't dominated across its box."""
        out, book = np.empty((len(cells), len(self.book)), bool), self.book[None]
        for lo in range(0, len(cells), ROWS):
            low = cells[lo : lo + ROWS, None, :] * self.edge
            high = low + self.edge - 1
            below, above = low - book, book - high
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=-1)
            greatest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=-1)
            # By how much the entry of the least greatest distance can be the farther one at most, over the box.
            best = self.book[greatest.argmin(axis=1)][:, None, :]
            lead = best * best - book * book + 2 * np.maximum((book - best) * low, (book - best) * high)
            out[lo : lo + ROWS] = (least <= greatest.min(axis=1, keepdims=True)) & (lead.sum(axis=-1) >= 0)
        return out

    def masks(self, parts: np.ndarray) -> np.ndarray:
        """For each part the entries to evaluate, from its cell's list."""
        cells = parts // self.edge
        with np.errstate(over="ignore"):
            h = bk.mix((cells.astype(np.uint64) * bk.PLACES[np.arange(cells.shape[1]) % len(bk.PLACES)]).sum(axis=1))
        at = self.memo.get(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if len(self.cells) + len(new) > MEMO_CELLS:
                self.forget()
                missing = np.arange(len(h))
                new, one, back = np.unique(h, return_index=True, return_inverse=True)
            own = cells[missing[one]]
            codes = np.arange(len(self.cells), len(self.cells) + len(new), dtype=np.int32)
            self.memo.put(new, codes)
            self.cells, self.open = np.concatenate([self.cells, own]), np.concatenate([self.open, self.candidates(own)])
            at[missing] = codes[back]
        out = self.open[at]
        out[(self.cells[at] != cells).any(axis=1)] = True  # another cell of that hash
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part; the lower index of equals."""
        row, entry = np.nonzero(self.masks(parts))
        d = ((parts[row] - self.book[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(d, first) if len(d) else d
        hit = np.flatnonzero(d == least[row])
        _, at = np.unique(row[hit], return_index=True)
        return entry[hit[at]], least


def nearest_of_any_size(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() in Python's integers."""
    d = ((parts.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(axis=-1)
    entry = np.array([min(range(len(x)), key=x.__getitem__) for x in d], np.int64)
    return entry, d[np.arange(len(d)), entry]


class Coder:
    """Codes of vectors under one codebook for each place."""

    def __init__(self, books: list[np.ndarray], scale: int):
        self.books, self.scale = books, scale
        self.width = books[0].shape[1]
        #: Integers so small that squared distances fit 64 bits.
        self.small = math.isqrt((1 << 62) // self.width) // 2
        self.fits = all(abs(int(x)) < self.small for b in books for x in b.flat)
        self.cells = None

    def begin(self) -> Coder:
        """In a task: with cells of its own, since a broadcast value is shared by a worker's tasks."""
        self.cells = [Cells(b.astype(np.int64)) for b in self.books] if self.fits else None
        return self

    def integers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit integers, rows that need Python's); such rows are 0 there."""
        with np.errstate(over="ignore"):
            y = np.floor(x * float(self.scale))
        large = ~(np.abs(y) < self.small).all(axis=1)
        if self.cells is None:
            large[:] = True
        return np.where(large[:, None], 0.0, y).astype(np.int64), np.flatnonzero(large)

    def exact(self, x: np.ndarray) -> np.ndarray:
        ratios = [v.as_integer_ratio() for r in x.tolist() for v in r]
        out = np.array([(n * self.scale) // d for n, d in ratios] + [None], object)[:-1].reshape(x.shape)  # None: an array of objects whatever the numbers
        if any(abs(v) >= MOST for v in out.flat):
            raise ValueError("a component is too large")
        return out

    def code(self, x: np.ndarray):
        """For each place: (parts, entries, squared distances); of rows x width of all parts doubles."""
        small, large = self.integers(x)
        whole = self.exact(x[large]) if len(large) else None
        for p, book in enumerate(self.books):
            cut = slice(p * self.width, (p + 1) * self.width)
            parts = small[:, cut]
            if self.cells is None:
                entry, d = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            else:
                entry, d = self.cells[p].nearest(parts)
            if whole is not None:
                parts, d = parts.astype(object), d.astype(object)
                parts[large] = whole[:, cut]
                entry[large], d[large] = nearest_of_any_size(whole[:, cut], book)
            yield parts, entry, d


def _vectors(batch: pa.RecordBatch, column: str, dim: int):
    """(rows of that length, their vectors), some at a time."""
    lists = batch.column(column)
    edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    own = np.flatnonzero(np.diff(edges) == dim)
    for lo in range(0, len(own), ROWS):
        at = own[lo : lo + ROWS]
        yield at, flat[edges[at][:, None] + np.arange(dim)]


def _sums(batches, coder: Coder, dim: int):
    """slot (place and entry), pos, n, low, high: sums over the task's parts."""
    slots, k = len(coder.books) * len(coder.books[0]), len(coder.books[0])
    n, total = np.zeros(slots, np.int64), np.zeros((slots, coder.width), object)
    for b in batches:
        for _, x in _vectors(b, "vector", dim):
            for p, (parts, entry, _) in enumerate(coder.code(x)):
                n[p * k : p * k + k] += np.bincount(entry, minlength=k)
                own = np.zeros((k, coder.width), parts.dtype)
                np.add.at(own, entry, parts)
                total[p * k : p * k + k] += own
    slot = np.repeat(np.arange(slots), coder.width)
    digits = pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(slot, pa.int32()), pa.array(np.tile(np.arange(coder.width), slots), pa.int32()), pa.array(n[slot]),
            pa.array([Decimal(v % UNIT) for v in total.flat], digits), pa.array([Decimal(v // UNIT) for v in total.flat], digits),
        ],
        ["slot", "pos", "n", "low", "high"],
    )


def _codes(batches, coder: Coder, dim: int):
    """vec_id, label, code, error."""
    hexes = [f"{i:02x}" for i in range(len(coder.books[0]))] if coder.books else []
    for b in batches:
        codes, errors = [None] * b.num_rows, [None] * b.num_rows
        for at, x in _vectors(b, "vector", dim):
            entries, ds = zip(*((entry.tolist(), d) for _, entry, d in coder.code(x)))
            fits = sum(int(d.max()) for d in ds) < 1 << 63
            error = sum(ds if fits else (d.astype(object) for d in ds))
            for i, code, e in zip(at.tolist(), zip(*entries), error.tolist()):
                codes[i], errors[i] = "".join(hexes[c] for c in code), e if e < 1 << 63 else None
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])


def first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """Codebooks of the vectors of the smallest ids."""
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    seeds = [r["vector"] for r in kept.orderBy(*order).limit(entries).collect()]
    if not seeds:
        return []
    dim = len(seeds[0])
    if any(len(s) != dim for s in seeds):
        seeds = [r["vector"] for r in kept.filter(F.size("vector") == dim).orderBy(*order).limit(entries).collect()]
    if dim == 0 or dim % parts:
        raise ValueError(f"{parts} parts don't divide vectors of length {dim}")
    width = dim // parts
    whole = Coder([np.zeros((1, width), np.int64)], scale).exact(np.array(seeds, float).reshape(len(seeds), dim))
    return [whole[:, p * width : (p + 1) * width] for p in range(parts)]


def next_books(kept: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """One round: entries become the floor of their parts' means; unused ones stay."""
    dim, k = len(books) * books[0].shape[1], len(books[0])
    held = share(kept.sparkSession, Coder(books, scale))
    rows = map_arrow(kept.select("vector"), lambda b: _sums(b, shared(held).begin(), dim), "slot int, pos int, n long, low decimal(38,0), high decimal(38,0)")
    out = [b.copy() for b in books]
    for r in rows.groupBy("slot", "pos").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")]).collect():  # parts x entries x width
        if r["n"]:
            out[r["slot"] // k][r["slot"] % k, r["pos"]] = (int(r["high"]) * UNIT + int(r["low"])) // r["n"]
    return out


def vector_codes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error (over rows of equal label), codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kept = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    books = first_books(kept, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = next_books(kept, books, scale)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()
    dim = len(books) * books[0].shape[1] if books else -1
    held = share(df.sparkSession, Coder(books, scale) if books else None)
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = written(map_arrow(kept, lambda b: _codes(b, shared(held).begin(), dim), f"vec_id {names['vec_id']}, label {names['label']}, code string, error long"), "codes") if books else kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    out = coded.join(small_side(sums, 100_000), F.col("label").eqNullSafe(F.col("_label")))
    whole = F.when(F.col("_sum") < Decimal(1 << 63), F.col("_sum")).cast("long")
    return out.select("vec_id", "label", "code", "error", F.when(F.col("code").isNotNull(), whole).alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
