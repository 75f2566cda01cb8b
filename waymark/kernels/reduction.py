"""A graph of low degree for a kernel, and a recorder that writes its lane as one on the original graph."""

from __future__ import annotations

from waymark.functions.parameters import degree_bound
from waymark.kernels.record import INFINITY, Arcs, Recorder
from waymark.schema import FOREST, PIVOT, RELAX, SETTLE


class Reduced:
    """Every vertex is a ring of copies at weight 0; its kth neighbour (either way, ascending) meets copy k div (delta - 2).

    owner: the vertex of each copy; first: the lowest copy of each vertex; origin: the original arc's number, or None for
    an arc of a ring."""

    def __init__(self, arcs: Arcs, delta: int):
        each = delta - 2
        near: list[set[int]] = [set() for _ in range(arcs.n)]
        for a, b in zip(arcs.src, arcs.dst, strict=True):
            near[a].add(b)
            near[b].add(a)
        self.owner, self.first, at = [], [], []
        for v, around in enumerate(near):
            start = len(self.owner)
            self.first.append(start)
            self.owner += [v] * max(1, -(-len(around) // each))
            at.append({u: start + k // each for k, u in enumerate(sorted(around))})
        made = [((at[a][b], at[b][a], w), e) for e, (a, b, w) in enumerate(zip(arcs.src, arcs.dst, arcs.w, strict=True))]
        for v, start in enumerate(self.first):
            copies = (self.first[v + 1] if v + 1 < arcs.n else len(self.owner)) - start
            made += [((start + k, start + (k + 1) % copies, 0.0), None) for k in range(copies)] if copies > 1 else []
        made.sort(key=lambda x: x[0][:2])
        self.origin = [e for _, e in made]
        self.arcs = Arcs(len(self.owner), [a for a, _ in made])

    def distances(self, dist: list[float]) -> list[float]:
        out = [INFINITY] * len(self.first)
        for copy, d in enumerate(dist):
            out[self.owner[copy]] = min(out[self.owner[copy]], d)
        return out

    def predecessors(self, labels: list[tuple]) -> list[int]:
        """The owner of the first copy of another vertex up the predecessors of each vertex's copy of least label."""
        least: dict[int, int] = {}
        for copy, label in enumerate(labels):
            v = self.owner[copy]
            if v not in least or label < labels[least[v]]:
                least[v] = copy
        out = []
        for v in range(len(self.first)):
            copy, steps = least[v], 0
            while copy >= 0 and self.owner[copy] == v:
                copy, steps = int(labels[copy][3]) if labels[copy][0] < INFINITY else -1, steps + 1
                if steps > len(self.owner):
                    raise ValueError("predecessors stay inside a ring")
            out.append(self.owner[copy] if copy >= 0 else -1)
        return out


def reduced(arcs: Arcs) -> Reduced | None:
    """None where the graph is sparse enough as it is."""
    delta = degree_bound(arcs.n, len(arcs.src))
    return None if delta is None else Reduced(arcs, delta)


def unmapped(rows: list[tuple], small: Reduced, arcs: Arcs, source: int) -> Recorder:
    """The lane on original numbers: the first settling and the first pivot of each vertex stay, what concerns rings'
    arcs goes, and whether a relaxation improves is told anew by the original distances."""
    out, dist = Recorder(), [INFINITY] * arcs.n
    dist[source] = 0.0
    settled: set[int] = set()
    chosen: set[int] = set()
    for row in rows:
        kind, vertex, edge = row[:3]
        if kind == SETTLE:
            if (v := small.owner[vertex]) not in settled:
                settled.add(v)
                out.settle(v)
        elif kind == PIVOT:
            if (v := small.owner[vertex]) not in chosen:
                chosen.add(v)
                out.pivot(v, row[3])
        elif kind in (RELAX, FOREST):
            if (e := small.origin[edge]) is None:
                continue
            if kind == FOREST:
                out.forest(row[3], e, row[4])
                continue
            new = dist[arcs.src[e]] + arcs.w[e]
            better = new < dist[arcs.dst[e]]
            if better:
                dist[arcs.dst[e]] = new
            out.relax(e, better)
        else:
            out.rows.append(row)
    return out
