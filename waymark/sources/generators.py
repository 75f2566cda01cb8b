"""Seeded graphs. Draws whose number depends on earlier draws run as a sequence in one task per graph; the
adversarial family's draws depend on the vertex alone and are columns over a range."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.prng import Draws, draw

#: Gallery kinds and sizes.
KINDS = ("city", "maze", "clusters", "adversarial", "sparse")
SIZES = {"S": 500, "M": 5_000, "L": 25_000, "XL": 100_000}
#: Weights are 1 + 99 u; clusters stand on a ring of radius 0.35 with jitter 0.12, between 4 and 24 of
#: them, each vertex with up to 8 peers, 3 bridges from each cluster to the next.
LEAST_WEIGHT, WEIGHT_SPAN = 1.0, 99.0
RING, JITTER, FEWEST, MOST, PEERS, BRIDGES = 0.35, 0.12, 4, 24, 8, 3

Arc = tuple[int, int, float]
Built = tuple[list[tuple[float, float]], list[Arc]]


def weight(draws: Draws) -> float:
    return LEAST_WEIGHT + next(draws) * WEIGHT_SPAN


def both_ways(pairs: dict[tuple[int, int], float]) -> list[Arc]:
    return [arc for (a, b), w in pairs.items() for arc in ((a, b, w), (b, a, w))]


def sparse(n: int, seed: int) -> Built:
    """Twice as many distinct arcs as vertices; loops and repeats are drawn again, weights only for those kept."""
    if n < 3:
        raise ValueError("a sparse graph needs at least 3 vertices")
    draws = Draws(seed)
    places = [(next(draws), next(draws)) for _ in range(n)]
    arcs: dict[tuple[int, int], float] = {}
    while len(arcs) < 2 * n:
        pair = draws.index(n), draws.index(n)
        if pair[0] != pair[1] and pair not in arcs:
            arcs[pair] = weight(draws)
    return places, [(a, b, w) for (a, b), w in arcs.items()]


def maze(n: int, seed: int) -> Built:
    """A spanning tree of the grid by depth-first walks; a step goes to the first of the shuffled unseen neighbours."""
    draws, across = Draws(seed), math.ceil(math.sqrt(n))
    seen, trail, pairs = {0}, [0], {}
    while trail:
        v = trail[-1]
        west, east = v - 1 if v % across else -1, v + 1 if v % across < across - 1 else n
        open_cells = [u for u in (west, east, v - across, v + across) if 0 <= u < n and u not in seen]
        if not open_cells:
            trail.pop()
            continue
        u = draws.shuffled(open_cells)[0]
        seen.add(u)
        trail.append(u)
        pairs[v, u] = 1.0
    return [(float(v % across), float(v // across)) for v in range(n)], both_ways(pairs)


def clusters(n: int, seed: int) -> Built:
    """Dense groups on a ring with a few bridges; a pair drawn twice keeps its first weight."""
    draws = Draws(seed)
    count = min(n, max(FEWEST, min(MOST, math.floor(math.sqrt(n) / 3 + 0.5))))
    sizes = [n // count + (c < n % count) for c in range(count)]
    starts = [sum(sizes[:c]) for c in range(count)]
    places = []
    for c, size in enumerate(sizes):
        turn = 2 * math.pi * c / count
        for _ in range(size):
            dx, dy = next(draws), next(draws)
            places.append((0.5 + RING * math.cos(turn) + (dx - 0.5) * JITTER, 0.5 + RING * math.sin(turn) + (dy - 0.5) * JITTER))
    pairs: dict[tuple[int, int], float] = {}

    def link(a: int, b: int) -> None:
        pair = min(a, b), max(a, b)
        if a != b and pair not in pairs:
            pairs[pair] = weight(draws)

    for start, size in zip(starts, sizes, strict=True):
        for v in range(start, start + size):
            if size > 1:
                for u in draws.shuffled([u for u in range(start, start + size) if u != v])[:PEERS]:
                    link(v, u)
    if count > 1:
        for c in range(count):
            after = (c + 1) % count
            for _ in range(BRIDGES):
                u = starts[c] + draws.index(sizes[c])
                link(u, starts[after] + draws.index(sizes[after]))
    return places, both_ways(pairs)


def chain_length(n: int) -> int:
    return max(2, math.isqrt(n))


def adversarial(n: int, seed: int) -> Built:
    """A chain of unit weights with heavy leaves dealt round its vertices but the last."""
    if n < 2:
        return [(0.0, 0.5)] * n, []
    draws, chain = Draws(seed), chain_length(n)
    pairs = {(i, i + 1): 1.0 for i in range(chain - 1)}
    pairs |= {((v - chain) % (chain - 1), v): chain + next(draws) for v in range(chain, n)}
    places = [(i / (chain - 1), 0.5) for i in range(chain)]
    for v in range(chain, n):
        parent, nth = (v - chain) % (chain - 1), (v - chain) // (chain - 1)
        leaves = (n - chain - parent + chain - 2) // (chain - 1)
        x = places[parent][0]
        reach = math.sqrt(max(0.0, 0.999 - x * x))
        places.append((x, 0.5 - min(reach, 0.08) if leaves <= 1 else 0.5 + (nth / (leaves - 1) - 0.5) * 2 * reach))
    return places, both_ways(pairs)


MAKERS: dict[str, Callable[[int, int], Built]] = {"sparse": sparse, "maze": maze, "clusters": clusters, "adversarial": adversarial}


def build(kind: str, n: int, seed: int) -> Built:
    from waymark.sources import families

    make = MAKERS.get(kind) or families.MAKERS.get(kind)
    if make is None:
        raise ValueError(f"no such kind of graph: {kind}")
    if n < 1:
        raise ValueError("a graph needs at least one vertex")
    return make(n, seed)


def generate(spark: SparkSession, specs: list[tuple[str, int, int]]) -> DataFrame:
    """(kind, n, seed, src, dst, w) of several graphs, a task for each."""

    def made(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for frame in frames:
            for kind, n, seed in frame.itertuples(index=False):
                arcs = build(kind, int(n), int(seed))[1]
                yield pd.DataFrame(arcs, columns=["src", "dst", "w"]).assign(kind=kind, n=n, seed=seed)[["kind", "n", "seed", "src", "dst", "w"]]

    rows = spark.createDataFrame(specs, "kind string, n long, seed long").repartition(max(1, len(specs)))
    return rows.mapInPandas(made, "kind string, n long, seed long, src long, dst long, w double")


def adversarial_arcs(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """The adversarial family's arcs as columns over a range: leaf number i uses draw i + 1."""
    chain = chain_length(n)
    spine = spark.range(chain - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    leaves = spark.range(n - chain).select((F.col("id") % (chain - 1)).alias("src"), (F.col("id") + chain).alias("dst"), (draw(F.lit(seed), F.col("id") + 1) + chain).alias("w"))
    there = spine.union(leaves)
    return there.union(there.select("dst", "src", "w"))
