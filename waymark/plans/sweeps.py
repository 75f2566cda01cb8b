"""Grids of runs: every graph is built once in its task, and its baseline serves all settings."""

from __future__ import annotations

import platform
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import parameters
from waymark.kernels.record import Arcs
from waymark.plans.lanes import run_one
from waymark.sources import generators

CELLS = "kind string, n long, seed long, k int, t int, dijkstra_work long, lane_work long, ratio double"


def graphs_of(spark: SparkSession, kinds: tuple[str, ...], sizes: tuple[int, ...], seeds: tuple[int, ...]) -> DataFrame:
    rows = [(kind, n, seed) for kind in kinds for n in sizes for seed in seeds if not (kind == "sparse" and n < 3)]
    return spark.createDataFrame(rows, "kind string, n long, seed long").repartition(max(1, len(rows)), "kind", "n", "seed")


def work_grid(spark: SparkSession, kinds: tuple[str, ...], sizes: tuple[int, ...], seeds: tuple[int, ...]) -> DataFrame:
    """kind, n, seed, work of the classic lane."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(work=[run_one(Arcs(int(s.n), generators.build(s.kind, int(s.n), int(s.seed))[1]), "dijkstra")[0].work() for s in frame.itertuples(index=False)])

    return graphs_of(spark, kinds, sizes, seeds).groupBy("kind", "n", "seed").applyInPandas(lambda f: work(f), "kind string, n long, seed long, work long")


#: The sweep's ks, and its variants of t (by formula, k squared, twice k).
KS, VARIANTS, SEEDS = (2, 4, 8, 12, 16, 24, 32), ("paper", "k2", "twoK"), range(10)


def t_of(variant: str, n: int, k: int, algorithm: str) -> int:
    if variant == "paper":
        return (parameters.bounded(n) if algorithm == "bounded" else parameters.forest(n)).t
    return k * k if variant == "k2" else 2 * k


def blocks_fit(n: int, k: int, t: int, algorithm: str) -> bool:
    """Whether the top level's block is a finite number."""
    levels = (parameters.bounded(n, k, t) if algorithm == "bounded" else parameters.forest(n, 3, k, t)).levels
    try:
        (parameters.bounded_cap(levels, k, t), parameters.bounded_block(levels, t)) if algorithm == "bounded" else (parameters.forest_cap(levels, t), parameters.forest_block(levels, t))
    except OverflowError:
        return False
    return True


def kt_sweep(spark: SparkSession, kinds: tuple[str, ...], sizes: tuple[int, ...], seeds: tuple[int, ...], ks: tuple[int, ...], ts: tuple[int | str, ...], algorithm: str = "bounded") -> DataFrame:
    """A row for each graph and setting: the lane's work against the classic lane's, which is run once a graph. A t is a
    number or the name of a variant; settings whose blocks are no finite numbers are left out."""

    def cells(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in frame.itertuples(index=False):
            arcs = Arcs(int(s.n), generators.build(s.kind, int(s.n), int(s.seed))[1])
            base = run_one(arcs, "dijkstra")[0].work()
            for k in ks:
                for x in ts:
                    t = t_of(x, arcs.n, k, algorithm) if isinstance(x, str) else x
                    if not blocks_fit(arcs.n, k, t, algorithm):
                        continue
                    lane = run_one(arcs, algorithm, 0, k, t)[0].work()
                    out.append((s.kind, s.n, s.seed, k, t, base, lane, ratio(lane, base)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CELLS.split(", ")])

    return graphs_of(spark, kinds, sizes, seeds).groupBy("kind", "n", "seed").applyInPandas(lambda f: cells(f), CELLS)


def ratio(work: int, base: int) -> float:
    return work / base if base else float("nan")


CANDIDATES = "family string, n long, seed long, m long, dijkstra_work long, bounded_work long, forest_work long, ratio_bounded double, ratio_forest double"


def candidate_bench(spark: SparkSession, families: tuple[str, ...], sizes: tuple[int, ...], seeds: tuple[int, ...]) -> DataFrame:
    """All three lanes on every family, size and seed, a task for each graph."""

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in frame.itertuples(index=False):
            arcs = Arcs(int(s.n), generators.build(s.kind, int(s.n), int(s.seed))[1])
            work = [run_one(arcs, a)[0].work() for a in ("dijkstra", "bounded", "forest")]
            out.append((s.kind, s.n, s.seed, len(arcs.src), *work, ratio(work[1], work[0]), ratio(work[2], work[0])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return graphs_of(spark, families, sizes, seeds).groupBy("kind", "n", "seed").applyInPandas(lambda f: rows(f), CANDIDATES)


def family_gate(cells: DataFrame) -> DataFrame:
    """family, size, passed (the bounded lane wins on every seed), losses."""
    wins = F.col("bounded_work") < F.col("dijkstra_work")
    return cells.groupBy("family", "size").agg(F.bool_and(wins).alias("passed"), F.count_if(~wins).alias("losses"))


def timed(spark: SparkSession, kind: str, n: int, seed: int, algorithms: tuple[str, ...] = ("dijkstra", "bounded", "forest")) -> dict[str, float]:
    """Milliseconds of each lane on one graph, the graph's making left out."""
    arcs, out = Arcs(n, generators.build(kind, n, seed)[1]), {}
    for name in algorithms:
        began = time.perf_counter()
        run_one(arcs, name)
        out[name] = 1000 * (time.perf_counter() - began)
    return out


def wall_clock(spark: SparkSession, cells: list[tuple[str, int, int]], path: str) -> None:
    """One JSON row a graph: milliseconds and work of every lane, with where and when it was measured."""
    rows = []
    for kind, n, seed in cells:
        arcs = Arcs(n, generators.build(kind, n, seed)[1])
        wall = timed(spark, kind, n, seed)
        rows.append((kind, n, seed, wall, {a: run_one(arcs, a)[0].work() for a in wall}))
    out = spark.createDataFrame(rows, "kind string, n long, seed long, wall_ms map<string,double>, work map<string,long>")
    made = out.withColumns({"generated_at": F.current_timestamp(), "platform": F.lit(platform.system().lower()), "arch": F.lit(platform.machine()), "python": F.lit(platform.python_version())})
    made.coalesce(1).write.mode("overwrite").json(path)


def read_wall_clock(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, n long, seed long, wall_ms map<string,double>, work map<string,long>, generated_at timestamp, platform string, arch string, python string").json(path)


def markdown(cells: DataFrame, title: str) -> str:
    """A table of a sweep's cells; these are few, a row for each setting."""
    columns = cells.columns
    shown = lambda c, x: ("n/a" if x is None or x != x else f"{x:.4f}") if c.startswith("ratio") else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(shown(c, r[c]) for c in columns) + " |" for r in cells.orderBy(*columns).collect()), ""])


def write_table(cells: DataFrame, path: str) -> None:
    """Tab-separated cells with the ratio to four places, n/a where there is none."""
    ratio = F.when(F.isnan("ratio") | F.col("ratio").isNull(), "n/a").otherwise(F.format_string("%.4f", "ratio"))
    cells.withColumn("ratio", ratio).write.csv(path, sep="\t", header=True)
