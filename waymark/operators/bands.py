"""Distances from many sources at once, nearest band first.

The state is a table of (source, v) with the least distance so far. Bands of `delta` are closed in order: inside a band
arcs of weight up to delta are followed until nothing in it changes, then the longer arcs of all its vertices are taken once, which
lead beyond it. A vertex is thus expanded about once, with a distance that is already final or nearly so, and few
candidates are made that a better one replaces. Empty bands are skipped.

As in sssp, a row of the state carries itself through the same exchange as the candidates, arcs come from lists of bounded
size, and HOPS rounds are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.sssp import bucketed, dropped, listed
from waymark.staging import discard, stage

#: Rounds inside a band that are one job.
HOPS = 4
KEY = ("source", "v", "part")


def expanded(state: DataFrame, lists: DataFrame, due: Column, taken: Column, bound: float, shut: Column) -> DataFrame:
    """state after the due rows' arcs have been followed, of those that `taken` picks by weight; shut: what closed becomes."""
    own = F.struct("source", "v", F.col("state.part").alias("part"), "best", F.when(due, F.col("best")).otherwise(F.col("sent")).alias("sent"), shut.alias("closed"), "tries", F.lit(True).alias("own"))
    picked = F.filter("arcs", lambda a: taken(a["w"]) & (F.col("best") + a["w"] < F.lit(bound)))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind = dict(state.dtypes)["best"]
    made = F.transform(picked, lambda a: F.struct(F.col("source").alias("source"), a["v"].alias("v"), a["part"].alias("part"), (F.col("best") + a["w"]).alias("best"), none("sent", kind), none("closed", "boolean"), F.lit(1).cast("long").alias("tries"), F.lit(False).alias("own")))
    met = state.alias("state").join(lists.alias("lists"), (F.col("v") == F.col("tail")) & (F.col("state.part") == F.col("lists.part")) & due, "left")
    rows = met.select(F.inline(F.when(F.col("arcs").isNull(), F.array(own)).otherwise(F.concat(F.array(own), made))))
    least = rows.groupBy(*KEY).agg(F.min("best").alias("best"), F.min("sent").alias("sent"), F.coalesce(F.bool_or("closed"), F.lit(False)).alias("closed"), F.sum("tries").alias("tries"))
    return least


def distances(edges: DataFrame, start: DataFrame, bound: float, delta: float) -> DataFrame:
    """source, v, dist, tries of every vertex within the bound (exclusive) of each source of start(source, v): tries is how
    many candidates were made for it. Weights must not be negative."""
    kind = dict(edges.dtypes)["w"]
    lists, name = bucketed(listed(edges.filter(F.col("w") < F.lit(bound))), "tail", "part")  # others lead beyond the bound
    state = stage(start.select(F.col("source").cast("long").alias("source"), F.col("v").cast("long").alias("v")).distinct().select(
        "source", "v", F.lit(0).alias("part"), F.lit(0).cast(kind).alias("best"), F.lit(None).cast(kind).alias("sent"), F.lit(False).alias("closed"), F.lit(0).cast("long").alias("tries")), "state")

    def moved(after: DataFrame, before: DataFrame) -> DataFrame:
        staged = stage(after, "state")
        discard(before)
        return staged

    while (least := state.filter("not closed").agg(F.min("best")).first()[0]) is not None:
        high = (least // delta + 1) * delta
        inside = ~F.col("closed") & (F.col("best") < F.lit(high))
        due = inside & (F.col("sent").isNull() | (F.col("best") < F.col("sent")))
        while state.filter(due).head(1):
            ahead = state
            for _ in range(HOPS):
                ahead = expanded(ahead, lists, due, lambda w: w <= F.lit(delta), bound, F.col("closed"))
            state = moved(ahead, state)
        state = moved(expanded(state, lists, inside, lambda w: w > F.lit(delta), bound, F.col("closed") | inside), state)
    dropped(lists, name)
    return state.filter("part = 0").select("source", "v", F.col("best").alias("dist"), "tries")
