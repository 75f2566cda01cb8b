"""Long searches, region by region.

A region is a range of vertices, with about as many arcs as any other. A step brings every region that new values came into
to a fixpoint inside, in its own task, and sends the least candidates over the arcs that leave it through the exchange. A search
takes a step each time a least way crosses from region to region, where rounds would take one for each of its arcs. Copies
of a hub but the first are dealt over the regions behind its own, so that no region holds a hub's arcs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.graphs import prefix_sums
from waymark.staging import forget, keep

#: Arcs of a region: at most about so many (40 bytes each in its task), and of a smaller graph five eighths, but no fewer than LEAST.
MOST, LEAST = 1_000_000, 65_536
#: Places looked at for the cut that ends a full region.
PLACES = 16
#: Kinds of values that a region's task adds and compares as Spark does.
KINDS = ("bigint", "double")


def bounds(lists: DataFrame, arcs: int) -> list[int]:
    """The first vertex of every region but the first, for lists(tail, part, arcs) of so many arcs: where few arcs cross, in
    the second half of a full region, and else where it is full. A few numbers for each region reach the driver."""
    most = min(MOST, max(LEAST, arcs * 5 // 8))
    if arcs <= most:
        return []
    ends = F.transform("arcs", lambda a: F.struct(a["v"].alias("x"), F.signum(F.col("tail") - a["v"]).cast("long").alias("open"), F.lit(0).alias("n")))
    own = F.struct(F.col("tail").alias("x"), F.aggregate("arcs", F.lit(0).cast("long"), lambda s, a: s + F.signum(a["v"] - F.col("tail")).cast("long")).alias("open"), F.size("arcs").alias("n"))
    marks = lists.select(F.inline(F.concat(F.array(own), ends))).groupBy("x").agg((F.sum("n") * 2**32 + F.sum("open")).alias("both"))
    sums = prefix_sums(marks, "x", "both").select("x", F.shiftright("before", 32).alias("before"), F.col("before").bitwiseAND(F.lit(2**32 - 1)).alias("across"))
    near = sums.groupBy(F.floor(F.col("before") * PLACES / most)).agg(F.min_by(F.struct("before", "across", "x"), "across").alias("c")).select("c.*")
    places, cuts, start = sorted(map(tuple, near.collect())), [], 0
    while arcs - start > most:
        inside = [c for c in places if start + most // 2 < c[0] <= start + most] or [c for c in places if c[0] > start][:1]
        if not inside:
            break
        least = min(across for _, across, _ in inside)
        start, _, x = [c for c in inside if c[1] <= 8 * least][-1]
        cuts.append(x)
    return cuts


def region(v: Column, part: Column, firsts: list[int]) -> Column:
    if not firsts:
        return F.lit(0)
    place = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in firsts)), lambda x: x <= v))
    return ((place + part) % (len(firsts) + 1)).cast("int")


def flat(lists: DataFrame, firsts: list[int]) -> DataFrame:
    """region, tail, tail_part, v, part, w: the arcs, with the region of their tails."""
    arcs = lists.select("tail", F.col("part").alias("tail_part"), F.inline("arcs")).select("tail", "tail_part", "v", "part", "w")
    return arcs.select(region(F.col("tail"), F.col("tail_part"), firsts).alias("region"), "*")


def inside(firsts: list[int], bound: float | None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A region's step: its rows with their least values, none of them fresh, and fresh rows for vertices of other regions."""
    cuts = np.array(firsts, dtype=np.int64)

    def step(key: tuple, state: pa.Table, arcs: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        value, fresh, w = column(state, "best"), column(state, "fresh").astype(bool), column(arcs, "w")
        ids, node = np.unique(np.concatenate([column(arcs, "tail"), column(arcs, "v"), column(state, "v")]), return_inverse=True)
        parts = np.concatenate([column(arcs, "tail_part"), column(arcs, "part"), column(state, "part")]).astype(np.int64)
        many = parts.max() + 1
        v, part = ids, np.zeros(len(ids), dtype=np.int64)
        if many > 1:
            codes, node = np.unique(node * many + parts, return_inverse=True)
            v, part = ids[codes // many], codes % many
        tail, head, at = np.split(node, [len(w), 2 * len(w)])
        own = (np.searchsorted(cuts, v, "right") + part) % (len(cuts) + 1) == key[0].as_py()
        best = np.full(len(v), np.iinfo(np.int64).max if value.dtype.kind == "i" else np.inf, dtype=value.dtype)
        none = best[:1].copy()
        before = best.copy()
        np.minimum.at(best, at, value)
        np.minimum.at(before, at[~fresh], value[~fresh])
        order = np.argsort(tail, kind="stable")
        first, head, w = np.searchsorted(tail[order], np.arange(len(v) + 1)), head[order], w[order]
        front = np.flatnonzero(best < before)
        while len(front):
            n = first[front + 1] - first[front]
            arc = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
            made, to = np.repeat(best[front], n) + w[arc], head[arc]
            if len(made) and made.min() < 0:
                raise OverflowError("a length is beyond 64 bits")
            less = made < best[to] if bound is None else (made < best[to]) & (made < bound)
            np.minimum.at(best, to[less], made[less])
            front = np.unique(to[less & own[to]])
        met = best < none
        out = {"region": (np.searchsorted(cuts, v, "right") + part) % (len(cuts) + 1), "v": v, "part": part, "best": best, "fresh": ~own}
        kinds = {"region": pa.int32(), "part": pa.int32()}
        return pa.table({k: pa.array(x[met], type=kinds.get(k)) for k, x in out.items()})

    return step


def finished(own: SparkSession, state: DataFrame, arcs: str, firsts: list[int], bound: float | None) -> DataFrame:
    """state(v, part, best, changed) at its fixpoint over the table of arcs as flat() gives them. own is a session whose plans
    are settled before they run."""
    kind = dict(state.dtypes)["best"]
    path = keep(state.select(region(F.col("v"), F.col("part"), firsts).alias("region"), "v", "part", "best", F.col("changed").alias("fresh")), "regions")
    limit = None if bound is None or bound != int(bound) else int(bound)
    step = inside(firsts, bound if limit is None else limit)
    while True:
        known = own.read.parquet(path)
        due = [r["region"] for r in known.filter("fresh").select("region").distinct().collect()]
        if not due:
            return state.sparkSession.read.parquet(path)
        moving = known.filter(F.col("region").isin(due)).groupBy("region").cogroup(own.table(arcs).filter(F.col("region").isin(due)).groupBy("region"))
        after = moving.applyInArrow(step, f"region int, v long, part int, best {kind}, fresh boolean")
        before, path = path, keep(after.unionByName(known.filter(~F.col("region").isin(due))), "regions")
        forget(own, before)
