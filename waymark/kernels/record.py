"""Columns of a trace as a kernel fills them."""

from __future__ import annotations

import math

import pandas as pd

from waymark.schema import BATCH, DSTRUCT, FOREST, HEAP, NONE, PIVOT, RECURSE, RELAX, SETTLE, SLAB

COLUMNS = ["kind", "vertex", "edge", "aux0", "aux1", "aux2", "aux_f", "cost"]


class Recorder:
    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.settled = 0

    def relax(self, edge: int, improved: bool) -> None:
        self.rows.append((RELAX, NONE, edge, int(improved), NONE, NONE, 0.0, 1))

    def settle(self, vertex: int) -> None:
        self.rows.append((SETTLE, vertex, NONE, self.settled, NONE, NONE, 0.0, 1))
        self.settled += 1

    def heap(self, op: int, compared: int) -> None:
        self.rows.append((HEAP, NONE, NONE, op, compared, NONE, 0.0, compared))

    def pivot(self, vertex: int, level: int) -> None:
        self.rows.append((PIVOT, vertex, NONE, level, NONE, NONE, 0.0, 0))

    def batch(self, ended: bool, level: int, size: int) -> None:
        self.rows.append((BATCH, NONE, NONE, int(ended), level, size, 0.0, 0))

    def recurse(self, outward: bool, level: int, bound: float) -> None:
        self.rows.append((RECURSE, NONE, NONE, int(outward), level, NONE, bound, 0))

    def forest(self, op: int, edge: int, tree: int) -> None:
        self.rows.append((FOREST, NONE, edge, op, tree, NONE, 0.0, 0))

    def dstruct(self, op: int, n: int, compared: int) -> None:
        self.rows.append((DSTRUCT, NONE, NONE, op, n, compared, 0.0, compared))

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=COLUMNS)
        out.insert(0, "idx", range(len(out)))
        return out.assign(chunk=out["idx"] // SLAB, row=out["idx"] % SLAB)

    def work(self) -> int:
        return sum(r[-1] for r in self.rows)


class Arcs:
    """Arcs in (src, dst) order; a vertex's arcs are a span of it."""

    def __init__(self, n: int, arcs: list[tuple[int, int, float]]):
        self.n = n
        ordered = sorted(arcs)
        self.src, self.dst, self.w = [a for a, _, _ in ordered], [b for _, b, _ in ordered], [w for _, _, w in ordered]
        self.first = [0] * (n + 1)
        for a in self.src:
            self.first[a + 1] += 1
        for v in range(n):
            self.first[v + 1] += self.first[v]

    def of(self, v: int) -> range:
        return range(self.first[v], self.first[v + 1])


INFINITY = math.inf
