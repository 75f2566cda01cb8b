"""Lanes of algorithms as grouped kernels: one task for each graph and lane, traces out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from waymark.functions import parameters
from waymark.kernels import bounded, dijkstra, forest, reduction
from waymark.kernels.record import INFINITY, Arcs, Recorder
from waymark.plans.specs import Race
from waymark.schema import TRACE
from waymark.sources import generators

SPECS = "run_id string, lane int, kind string, n long, seed long, algorithm string, k int, t int"
ORDER = [c.split()[0] for c in TRACE.split(", ")]


def specs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (graph kind, n, seed, algorithm[, k, t]); a lane each."""
    full = [(f"{r[0]}-{r[1]}-{r[2]}", i, *r[:4], *(r[4:] or (None, None))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SPECS).repartition(max(1, len(full)), "run_id", "lane")


#: The names of lanes: those of a race's specification, and what they stand for.
ALGORITHMS = {"dijkstra": "dijkstra", "bmssp": "bounded", "bounded": "bounded", "dmsy": "forest", "forest": "forest"}


def run_one(arcs: Arcs, algorithm: str, source: int = 0, k: int | None = None, t: int | None = None, demo: bool = True) -> tuple[Recorder, list[float], list[int]]:
    """A lane's trace, distances and predecessors. The forest-based lane runs on the graph of low degree where the graph
    is dense, and its trace comes back on the original numbers."""
    out = Recorder()
    name = ALGORITHMS.get(algorithm)
    if name is None:
        raise ValueError(f"no such lane: {algorithm}")
    if not 0 <= source < arcs.n:
        raise ValueError("the source is no vertex of the graph")
    if name == "dijkstra":
        return out, *dijkstra.run(arcs, source, out)
    if name == "bounded":
        return out, *bounded.run(arcs, source, parameters.bounded(arcs.n, k, t, demo), out)
    small = reduction.reduced(arcs)
    if small is None:
        return out, *forest.run(arcs, source, parameters.forest(arcs.n, 3, k, t, demo), out)
    labels = forest.labelled(small.arcs, small.first[source], parameters.forest(small.arcs.n, 3, k, t, demo), out)
    return reduction.unmapped(out.rows, small, arcs, source), small.distances([x[0] for x in labels]), small.predecessors(labels)


def given(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def run_lanes(lanes: DataFrame) -> DataFrame:
    """The traces of all lanes, in the physical schema."""

    def traced(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for s in frame.itertuples(index=False):
            arcs = Arcs(int(s.n), generators.build(s.kind, int(s.n), int(s.seed))[1])
            out = run_one(arcs, s.algorithm, 0, given(s.k), given(s.t))[0].frame()
            parts.append(out.assign(run_id=s.run_id, lane=s.lane)[ORDER])
        return pd.concat(parts)

    return lanes.groupBy("run_id", "lane").applyInPandas(lambda frame: traced(frame), TRACE)


RESULT = "run_id string, lane int, v long, dist double, pred long"


def run_results(lanes: DataFrame) -> DataFrame:
    """The distances and predecessors that every lane ends with (unreached vertices left out)."""

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for s in frame.itertuples(index=False):
            arcs = Arcs(int(s.n), generators.build(s.kind, int(s.n), int(s.seed))[1])
            _, dist, pred = run_one(arcs, s.algorithm, 0, given(s.k), given(s.t))
            parts.append(pd.DataFrame({"run_id": s.run_id, "lane": s.lane, "v": range(arcs.n), "dist": dist, "pred": pred})[[d < INFINITY for d in dist]])
        return pd.concat(parts)

    return lanes.groupBy("run_id", "lane").applyInPandas(lambda frame: solved(frame), RESULT)


def race(spark: SparkSession, spec: Race) -> DataFrame:
    """The traces of a race read from its specification, a lane for each of its algorithms."""
    k = {"bmssp": (spec.bk, spec.bt), "dmsy": (spec.dk, spec.dt), "dijkstra": (None, None)}
    return run_lanes(specs(spark, [(spec.g, spec.n, spec.seed, name, *k[name]) for name in spec.race]))
