"""A keyed bijection of 0 .. n - 1 as a Column: a seeded shuffle that no task has to hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the Feistel network.
ROUNDS = 6


def _once(x: Column, half: int, seed: int) -> Column:
    """A permutation of 0 .. 4**half - 1: in each round one half of the bits is changed by a hash of the other."""
    mask = F.lit((1 << half) - 1)

    def turn(x: Column, i: Column) -> Column:
        right = x.bitwiseAND(mask)
        return F.shiftleft(right, half).bitwiseOR(F.shiftright(x, half).bitwiseXOR(F.xxhash64(right, F.lit(seed), i).bitwiseAND(mask)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def permuted_col(place: Column, n: int, seed: int) -> Column:
    """The place's image.  A value beyond n - 1 is mapped again until it lies below (cycle walking): each image then belongs to one place.

    At most three quarters of the values lie beyond, so a walk of many steps is rare; the walk is bounded only by the cycle.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    step = lambda x: _once(x, half, seed)
    # A fold over a sequence has no early end; 256 further steps are skipped where the value is in range.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(256)), step(place.cast("long")), lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk did not end")))
