"""Parameters of the bounded multi-source algorithms, as plain functions and as columns of a grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least k of the demonstration settings.
DEMO_K_BOUNDED, DEMO_K_FOREST = 4, 6


@dataclass(frozen=True)
class Bounded:
    k: int
    t: int
    levels: int


def bounded(n: int, k: int | None = None, t: int | None = None, demo: bool = True) -> Bounded:
    """k = floor(log2(n)^(1/3)), t = floor(log2(n)^(2/3)), at least 1; levels = ceil(log2(n) / t)."""
    bits = math.log2(max(2, n))
    paper_k, paper_t = max(1, math.floor(bits ** (1 / 3))), max(1, math.floor(bits ** (2 / 3)))
    k = k or (max(DEMO_K_BOUNDED, paper_k) if demo else paper_k)
    t = t or paper_t
    return Bounded(k, t, max(1, math.ceil(bits / t)))


def forest(n: int, delta: int = 3, k: int | None = None, t: int | None = None, demo: bool = True) -> Bounded:
    """t = ceil(sqrt(log2(n) log2(log2(n)) / delta)), k = ceil(t / log2(t)) (1 for t < 2); levels 0 for n < 2."""
    bits = math.log2(n) if n > 1 else 0.0
    nested = max(0.0, math.log2(bits)) if bits > 0 else 0.0
    paper_t = max(1, math.ceil(math.sqrt(bits * nested / delta)))
    t = t or paper_t
    paper_k = math.ceil(t / math.log2(t)) if t >= 2 else 1
    k = k or (max(DEMO_K_FOREST, paper_k) if demo else paper_k)
    return Bounded(k, t, math.ceil(bits / t) if n >= 2 else 0)


def bounded_block(level: int, t: int) -> float:
    """Elements of one pull at a level."""
    return 2.0 ** ((level - 1) * t)


def bounded_cap(level: int, k: int, t: int) -> float:
    return k * 2.0 ** (level * t)


def forest_block(level: int, t: int) -> float:
    return t * 2.0 ** ((level - 1) * t)


def forest_cap(level: int, t: int) -> float:
    return t**3 * 2.0 ** (level * t)


def degree_bound(n: int, m: int) -> int | None:
    """None: no reduction. Else a quarter of log2(log2(n)), held between 3 and m / n."""
    if n < 2 or m < 3 * n:
        return None
    return max(3, min(math.floor(math.log2(max(1.0, math.log2(n))) / 4), m // n))


def bounded_columns(n: Column) -> dict[str, Column]:
    """The formulas over a column of vertex numbers (at least 2)."""
    bits = F.log2(n.cast("double"))
    k, t = F.greatest(F.floor(F.pow(bits, F.lit(1 / 3))), F.lit(1)), F.greatest(F.floor(F.pow(bits, F.lit(2 / 3))), F.lit(1))
    return {"k": k.cast("long"), "t": t.cast("long"), "demo_k": F.greatest(k, F.lit(DEMO_K_BOUNDED)).cast("long"), "levels": F.greatest(F.ceil(bits / t), F.lit(1)).cast("long")}


def forest_columns(n: Column, delta: int = 3) -> dict[str, Column]:
    """forest() over a column of vertex numbers (at least 4)."""
    bits = F.log2(n.cast("double"))
    t = F.greatest(F.ceil(F.sqrt(bits * F.log2(bits) / delta)), F.lit(1))
    k = F.when(t >= 2, F.ceil(t / F.log2(t.cast("double")))).otherwise(1)
    return {"t": t.cast("long"), "k": k.cast("long"), "demo_k": F.greatest(k, F.lit(DEMO_K_FOREST)).cast("long"), "levels": F.ceil(bits / t).cast("long")}


def degree_bound_column(n: Column, m: Column) -> Column:
    """degree_bound() over columns; null where there is no reduction."""
    quarter = F.floor(F.log2(F.greatest(F.lit(1.0), F.log2(n.cast("double")))) / 4)
    return F.when((n >= 2) & (m >= 3 * n), F.greatest(F.lit(3), F.least(quarter, F.floor(m / n)))).cast("long")
