"""The classic lane: a heap with stale entries left in it."""

from __future__ import annotations

from waymark.kernels.heap import CountingHeap
from waymark.kernels.record import INFINITY, Arcs, Recorder


def run(arcs: Arcs, source: int, out: Recorder) -> tuple[list[float], list[int]]:
    """Distances and predecessors (-1 for none); every step goes to the recorder."""
    dist, pred = [INFINITY] * arcs.n, [-1] * arcs.n
    dist[source] = 0.0
    heap = CountingHeap()
    out.heap(0, heap.push(source, 0.0))
    while heap:
        v, key, compared = heap.pop()
        out.heap(1, compared)
        if key != dist[v]:
            continue
        out.settle(v)
        for e in arcs.of(v):
            u, new = arcs.dst[e], key + arcs.w[e]
            better = new < dist[u]
            out.relax(e, better)
            if better:
                dist[u], pred[u] = new, v
                out.heap(0, heap.push(u, new))
    return dist, pred
