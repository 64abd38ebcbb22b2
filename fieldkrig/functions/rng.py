"""Seeded generator for simulations: splitmix64 seeding, xoshiro256++, Box-Muller."""

from __future__ import annotations

import sys
import math

from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def splitmix64(state: int) -> tuple[int, int]:
    """(next state, output)."""
    state = (state + GOLDEN) & MASK
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return state, z ^ (z >> 31)


def realization_seed(seed: int, realization: int) -> int:
    return splitmix64((seed ^ (realization * GOLDEN)) & MASK)[1]


class Rng:
    def __init__(self, seed: int):
        self.s = []
        state = seed & MASK
        for _ in range(4):
            state, out = splitmix64(state)
            self.s.append(out)
        self.spare: float | None = None

    def next(self) -> int:
        a, b, c, d = self.s
        total = (a + d) & MASK
        out = ((((total << 23) | (total >> 41)) & MASK) + a) & MASK
        t = (b << 17) & MASK
        c ^= a
        d ^= b
        b ^= c
        a ^= d
        c ^= t
        d = ((d << 45) | (d >> 19)) & MASK
        self.s = [a, b, c, d]
        return out

    def uniform(self) -> float:
        """53 bits in [0, 1)."""
        return (self.next() >> 11) * 2.0**-53

    def normal(self) -> float:
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        u = 0.0
        while u <= 0.0:
            u = self.uniform()
        r, angle = math.sqrt(-2 * math.log(u)), 2 * math.pi * self.uniform()
        self.spare = r * math.sin(angle)
        return r * math.cos(angle)

    def shuffle(self, items: list) -> None:
        for i in range(len(items) - 1, 0, -1):
            j = self.next() % (i + 1)
            items[i], items[j] = items[j], items[i]


def fold_of(n: int, k: int, seed: int) -> list[int]:
    """The fold of each of n rows: its place in a seeded shuffle, modulo k."""
    order = list(range(n))
    Rng(seed).shuffle(order)
    out = [0] * n
    for place, row in enumerate(order):
        out[row] = place % k
    return out
