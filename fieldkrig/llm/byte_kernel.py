"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Texts are never turned into Python strings: words, shingles and rolling hashes
come from a column's data and offsets.  Work goes in slices of whole texts of
about SLICE bytes (one longer text is a slice by itself), which bounds memory.

Hashes are 64 bits wide: polynomials modulo 2**64 over a random 64-bit value for
each byte, then mixed.  Two different strings agree by chance once in about
2**64 pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 17
#: Powers that are kept from one slice to the next (16 MB); longer texts compute their own.
KEPT_POWERS = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
with np.errstate(over="ignore"):
    #: BASE to the power -1 modulo 2**64, by Newton's iteration.
    _inv = BASE
    for _ in range(6):
        _inv = _inv * (U(2) - BASE * _inv)
    BASE_INVERSE = _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(32))
        x = x * U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
    return x


#: A value for each byte; FOLDED gives A-Z those of a-z.
VALUES = mix(np.arange(1, 257, dtype=U) * U(0xC2B2AE3D27D4EB4F))
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers for the places in a shingle.
PLACES = mix(np.arange(101, 165, dtype=U)) | U(1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if _powers and len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    size, made = 1 << max(16, (n - 1).bit_length()), {}
    with np.errstate(over="ignore"):
        for k, b in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, b, U)
            p[0] = U(1)
            made[k] = np.multiply.accumulate(p)
    if size <= KEPT_POWERS:
        _powers.update(made)
    return made["up"][:n], made["down"][:n]


def slices(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets): offsets start at 0 and have one more entry than the slice has rows; null is empty.  size: bytes, else SLICE."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (size or SLICE), side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes that aren't blank), and for each text the index of its first word, then the count of all."""
    inside = ~BLANK[data]
    first = inside.copy()
    last = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def shingle_sets(hashes: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, rising within each text; offsets by text).  A text of fewer words is one shingle; without words it has none."""
    n = len(firsts) - 1
    counts = np.diff(firsts)
    with np.errstate(over="ignore"):
        m = max(0, len(hashes) - width + 1)
        full = np.zeros(m, U)
        for k in range(width):
            full += hashes[k : k + m] * PLACES[k]
        text_of = np.repeat(np.arange(n), counts)
        inside = text_of[:m] == text_of[width - 1 :] if m else np.zeros(0, bool)
        full, owner = mix(full[inside]), text_of[:m][inside]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.zeros(len(short), U)
            for k in range(width - 1):
                has = counts[short] > k
                extra[has] += hashes[firsts[short[has]] + k] * PLACES[k]
            extra = mix(extra + counts[short].astype(U) * U(0xE7037ED1A0B428DB))
            full, owner = np.concatenate([full, extra]), np.concatenate([owner, short])
    order = np.argsort(full, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    full, owner = full[order], owner[order]
    keep = np.ones(len(full), bool)
    keep[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
    full, owner = full[keep], owner[keep]
    return full, np.searchsorted(owner, np.arange(n + 1))


def rolling(data: np.ndarray, width: int, values: np.ndarray = VALUES) -> np.ndarray:
    """Mixed hashes of all runs of so many bytes, in order (text ends are not looked at)."""
    m = len(data) - width + 1
    if m <= 0:
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * up[:-1], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * down[:m])


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values, from running minima to either side inside blocks of that width."""
    m = len(x) - width + 1
    if m <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    top = np.iinfo(x.dtype).max
    padded = np.full(blocks * width, top, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
