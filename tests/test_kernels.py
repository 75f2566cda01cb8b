import heapq
import random

import pytest

from waymark.functions import parameters
from waymark.functions.prng import Draws
from waymark.kernels.heap import CountingHeap
from waymark.kernels.record import Arcs, Recorder
from waymark.plans.lanes import run_one
from waymark.sources import generators

#: Published work of the classic lane from vertex 0.
WORK = {
    ("maze", 500, 0): 2430, ("maze", 500, 1): 1922, ("maze", 500, 2): 2279, ("maze", 5000, 0): 28853, ("sparse", 500, 0): 5767, ("sparse", 500, 1): 5768, ("sparse", 500, 2): 3, ("sparse", 500, 4): 5498,
    ("sparse", 5000, 0): 84824, ("sparse", 5000, 4): 82326, ("clusters", 500, 0): 24546, ("clusters", 500, 1): 24574, ("clusters", 500, 2): 24129, ("adversarial", 500, 0): 8562, ("adversarial", 500, 1): 8568, ("adversarial", 5000, 0): 118508,
    ("cascade3", 500, 0): 13993, ("cascadeAll", 500, 0): 57439, ("cascadeHub", 500, 0): 56989, ("wideFrontier", 500, 0): 7435, ("city", 500, 0): 10075, ("city", 500, 1): 10180, ("city", 500, 1729): 9830,
}


@pytest.mark.parametrize("spec", list(WORK))
def test_published_work(spec):
    arcs = Arcs(spec[1], generators.build(*spec)[1])
    assert run_one(arcs, "dijkstra")[0].work() == WORK[spec]


def exact(arcs, source):
    dist, queue = [float("inf")] * arcs.n, [(0.0, source)]
    dist[source] = 0.0
    while queue:
        d, v = heapq.heappop(queue)
        if d == dist[v]:
            for e in arcs.of(v):
                if d + arcs.w[e] < dist[arcs.dst[e]]:
                    dist[arcs.dst[e]] = d + arcs.w[e]
                    heapq.heappush(queue, (d + arcs.w[e], arcs.dst[e]))
    return dist


def test_lanes_agree_on_seeded_graphs():
    for seed in range(300):
        kind = ("maze", "clusters", "adversarial", "sparse", "city", "wideFrontier")[seed % 6]
        n = 8 + seed % 40
        arcs, source = Arcs(n, generators.build(kind, n, seed)[1]), seed % n
        want = exact(arcs, source)
        for algorithm in ("dijkstra", "bounded", "forest"):
            assert run_one(arcs, algorithm, source)[1] == want


def test_lanes_agree_on_ties():
    for seed in range(300):
        draws, n = Draws(seed), 4 + seed % 9
        arcs = [(u, v, 1.0 if next(draws) < 0.5 else 2.0) for u in range(n) for v in range(n) if u != v and next(draws) < 0.4]
        graph = Arcs(n, arcs)
        for k, t in ((None, None), (1, 1), (2, 1), (3, 2)):
            for algorithm in ("bounded", "forest"):
                assert run_one(graph, algorithm, seed % n, k, t)[1] == exact(graph, seed % n)


def test_golden_chain():
    arcs = Arcs(3, [(0, 1, 1.0), (1, 2, 1.0)])
    out, dist, pred = run_one(arcs, "dijkstra")
    assert dist == [0, 1, 2] and pred == [-1, 0, 1]
    assert [(r[0], r[3]) for r in out.rows] == [(2, 0), (2, 1), (1, 0), (0, 1), (2, 0), (2, 1), (1, 1), (0, 1), (2, 0), (2, 1), (1, 2)]


def test_golden_stale_entry():
    arcs = Arcs(4, [(0, 1, 1.0), (0, 2, 4.0), (1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0)])
    out, dist, pred = run_one(arcs, "dijkstra")
    assert dist == [0, 1, 2, 3] and pred == [-1, 0, 1, 2]
    assert len([r for r in out.rows if r[0] == 2 and r[3] == 1]) == 5 and out.settled == 4


def test_heap_orders_and_counts():
    random.seed(1)
    heap, keys = CountingHeap(), [random.randrange(50) for _ in range(200)]
    assert heap.push(0, keys[0]) == 0
    for i, k in enumerate(keys[1:], 1):
        assert heap.push(i, k) >= 1
    out = [heap.pop() for _ in keys]
    assert [k for _, k, _ in out] == sorted(keys) and out[-1][2] == 0


def test_parameters():
    assert parameters.bounded(25_000, demo=False) == parameters.Bounded(2, 5, 3)
    assert parameters.bounded(100_000) == parameters.Bounded(4, 6, 3)
    assert parameters.forest(100_000).t == 5 and parameters.forest(100_000).k == 6
    assert parameters.forest(1).levels == 0 and parameters.degree_bound(100, 200) is None and parameters.degree_bound(100, 1000) == 3


def test_recorder_schema():
    out = Recorder()
    out.relax(3, True)
    out.heap(0, 2)
    out.dstruct(2, 5, 7)
    frame = out.frame()
    assert list(frame["cost"]) == [1, 2, 7] and list(frame["idx"]) == [0, 1, 2] and list(frame["aux1"]) == [-1, 2, 5]


def test_bad_graphs():
    for call in (lambda: generators.build("torus", 5, 1), lambda: generators.build("maze", 0, 1), lambda: generators.build("sparse", 2, 1)):
        with pytest.raises(ValueError):
            call()


def test_labels_break_ties_by_the_least_tail():
    out, dist, pred = run_one(Arcs(3, [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0)]), "forest")
    assert dist == [0, 1, 1] and pred == [-1, 0, 0]


def test_trees_are_cut_into_groups():
    from waymark.kernels.forest import cut_tree

    for seed in range(60):
        draws, n, size = Draws(seed), 3 + seed % 40, 1 + seed % 5
        sides = [(v, draws.index(v), v) for v in range(1, n)]
        groups = cut_tree(list(range(n)), sides, size)
        edges = [e for _, es in groups for e in es]
        assert sorted(edges) == [e for e, _, _ in sides]
        assert set().union(*(set(vs) for vs, _ in groups)) == set(range(n))
        assert all(size <= len(set(vs)) < max(3 * size, 3) for vs, _ in groups) or len(groups) == 1


def test_local_searches_on_a_chain():
    from waymark.kernels.forest import ENDLESS, Lane

    lane = Lane(Arcs(3, [(0, 1, 1.0), (1, 2, 1.0)]), 0, parameters.Bounded(2, 1, 1), Recorder())
    groups, lone, small = lane.pivots(ENDLESS, [0])
    assert groups == [[0]] and lone == [] and small == []
    kinds = [(r[0], r[3]) for r in lane.out.rows]
    assert kinds == [(2, 0), (2, 1), (0, 1), (6, 0), (2, 0), (6, 1)]


def test_blocks_against_a_sorted_map():
    """Random inserts, prepends and pulls, against a plain dictionary; sizes stay within their window."""
    import random

    from waymark.kernels.blocks import BlockList

    for seed in range(60):
        rng = random.Random(seed)
        m = rng.choice([1, 2, 3, 7, 16])
        held, plain = BlockList(m, (1000.0, -1)), {}
        for _ in range(120):
            what = rng.random()
            if what < 0.6:
                k, v = rng.randrange(80), float(rng.randrange(1000))
                held.insert(k, v)
                plain[k] = min(v, plain.get(k, v))
            elif what < 0.75:
                low = min(plain.values(), default=1000.0)
                pairs = [(low - 1 - rng.randrange(50), rng.randrange(80)) for _ in range(rng.randrange(6))]
                held.prepend(pairs)
                new = {}
                for v, k in pairs:
                    new[k] = min(v, new.get(k, v))
                plain |= new
            else:
                order = sorted((v, k) for k, v in plain.items())
                bound, keys = held.pull()
                assert keys == sorted(k for _, k in order[:m]) and bound == (order[m] if len(order) > m else (1000.0, -1))
                plain = {k: v for v, k in order[m:]}
            assert held.value == plain and sum(map(len, held.blocks)) == len(plain)
            assert all(0 < len(b) <= max(m, 1) for b in held.blocks)
            flat = [sorted((v, k) for k, v in b.items()) for b in held.blocks]
            assert all(a[-1] < b[0] for a, b in zip(flat, flat[1:]))
        for bad in (float("nan"), float("inf"), 1001.0):
            with pytest.raises(ValueError):
                held.insert(1, bad)
