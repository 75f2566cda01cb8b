"""The seeded 32-bit generator, as a column over draw numbers and as a Python iterator.

Draw i (from 1) is a function of seed and i alone, so a column of draws needs no sequence. Products modulo 2**32
are taken in 16-bit halves, which keeps them within a signed long.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed value: the counter's step.
STEP = 0x6D2B79F5


def times32(a: Column, b: Column) -> Column:
    low = a * b.bitwiseAND(0xFFFF)
    high = (a * F.shiftrightunsigned(b, 16)).bitwiseAND(0xFFFF)
    return (low + F.shiftleft(high, 16)).bitwiseAND(MASK)


def draw_u32(seed: Column, nth: Column) -> Column:
    """The nth output (from 1) for the seed, as a long in [0, 2**32)."""
    state = (seed.cast("long").bitwiseAND(MASK) + times32(nth.cast("long").bitwiseAND(MASK), F.lit(STEP).cast("long"))).bitwiseAND(MASK)
    t = times32(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(1))
    t = t.bitwiseXOR((t + times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(61))).bitwiseAND(MASK))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14))


def draw(seed: Column, nth: Column) -> Column:
    """The nth output as a double in [0, 1)."""
    return draw_u32(seed, nth) / F.lit(4294967296.0)


class Draws:
    """The same generator one draw at a time, for programs whose draws depend on earlier ones."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def __iter__(self) -> Iterator[float]:
        return self

    def __next__(self) -> float:
        self.state = (self.state + STEP) & MASK
        s = self.state
        t = ((s ^ (s >> 15)) * (s | 1)) & MASK
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & MASK)) & MASK
        return (t ^ (t >> 14)) / 4294967296

    def index(self, n: int) -> int:
        return int(next(self) * n)

    def shuffled(self, items: list) -> list:
        """Exchange from the last place down."""
        for i in range(len(items) - 1, 0, -1):
            j = self.index(i + 1)
            items[i], items[j] = items[j], items[i]
        return items
