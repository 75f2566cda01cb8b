"""Distances as a trace leaves them behind, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.prefix import running
from waymark.operators.trace import is_kind
from waymark.schema import RELAX
from waymark.staging import discard, stage

#: Doublings in one job.
JUMPS = 2


def improvements(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """lane, idx, src, dst, w of the improving relaxations."""
    return trace.filter(is_kind(RELAX) & (F.col("aux0") == 1)).join(edges.select(F.col("e").alias("edge"), "src", "dst", "w"), "edge").select("lane", "idx", "src", "dst", "w")


def last_before(hits: DataFrame) -> DataFrame:
    """hits with prev: the idx of the latest improvement of the row's tail before the row (an as-of join), null if none."""
    writes = hits.select("lane", F.col("dst").alias("vertex"), "idx", F.col("idx").alias("wrote"), F.lit(False).alias("reads"))
    reads = hits.select("lane", F.col("src").alias("vertex"), "idx", F.lit(None).cast("long").alias("wrote"), F.lit(True).alias("reads"))
    seen = running(writes.unionByName(reads), ["lane", "vertex"], "idx", {"prev": ("last", F.col("wrote"))}, inclusive=False)
    return hits.join(seen.filter("reads").select("lane", "idx", "prev"), ["lane", "idx"])


def labels_over_time(trace: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """lane, idx, v, dist, n_edges, pred after each improving relaxation: its tail's distance and number of arcs just then, one
    arc further; a null dist (infinity, for weights with a fraction) where the chain does not begin at the source.

    Rows point at the improvement that they build on. Whole-number weights are summed along the pointers by doubling, which
    is exact in any order: twenty rounds for a chain of a million. Weights with a fraction are added in the trace's own
    order, outward level by level, a job for each arc of the longest chain; a level joins only the rows of the one before."""
    hits = stage(last_before(improvements(trace, edges)), "hits")
    whole = dict(hits.dtypes)["w"] in ("bigint", "int", "smallint", "tinyint")
    return by_doubling(hits, source) if whole else by_levels(hits, source)


def distances_over_time(trace: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """lane, idx, v, dist after each improving relaxation."""
    return labels_over_time(trace, edges, source).select("lane", "idx", "v", "dist")


OUT = ("lane", "idx", "v", "dist", "n_edges", "pred")


def by_doubling(hits: DataFrame, source: int) -> DataFrame:
    """labels_over_time() of hits(lane, idx, src, dst, w, prev). Rows that have reached their chain's start only stand ready
    to be met."""
    begins = F.when(F.col("prev").isNull(), F.col("src") == source)
    own = ("lane", "idx", "v", "pred")
    rows = hits.select("lane", "idx", F.col("dst").alias("v"), F.col("src").alias("pred"), F.col("w").cast("long").alias("dist"), F.lit(1).cast("long").alias("n_edges"), "prev", begins.alias("begins"))
    rows = stage(rows, "chains")
    while rows.filter("prev is not null").head(1):
        ahead = rows
        for _ in range(JUMPS):
            met = ahead.select("lane", F.col("idx").alias("prev"), F.col("dist").alias("more"), F.col("n_edges").alias("arcs"), F.col("prev").alias("then"), F.col("begins").alias("so"))
            moved = ahead.filter("prev is not null").join(met, ["lane", "prev"])
            moved = moved.select(*own, (F.col("dist") + F.col("more")).alias("dist"), (F.col("n_edges") + F.col("arcs")).alias("n_edges"), F.col("then").alias("prev"), F.col("so").alias("begins"))
            ahead = moved.unionByName(ahead.filter("prev is null"))
        before, rows = rows, stage(ahead, "chains")
        discard(before)
    return rows.withColumn("dist", F.when(F.col("begins"), F.col("dist"))).select(*OUT)


def by_levels(hits: DataFrame, source: int) -> DataFrame:
    """The same in the trace's own order of additions."""
    begin = F.when(F.col("src") == source, F.lit(0.0)).otherwise(F.lit(float("inf")))
    next_ = lambda rows, dist, n: stage(rows.select("lane", "idx", F.col("dst").alias("v"), dist.alias("dist"), n.cast("long").alias("n_edges"), F.col("src").alias("pred")), "level")
    level = next_(hits.filter("prev is null"), begin + F.col("w"), F.lit(1))
    found = level
    while level.head(1):
        parents = level.select("lane", F.col("idx").alias("prev"), F.col("dist").alias("so_far"), F.col("n_edges").alias("arcs"))
        level = next_(hits.join(parents, ["lane", "prev"]), F.col("so_far") + F.col("w"), F.col("arcs") + 1)
        found = found.unionByName(level)
    whole = stage(found, "replayed")
    discard(hits)
    return whole.select(*OUT)


def distances(trace: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """lane, v, dist that the trace leaves behind, the source at 0."""
    last = distances_over_time(trace, edges, source).groupBy("lane", "v").agg(F.max_by("dist", "idx").alias("dist"))
    start = trace.select("lane").distinct().select("lane", F.lit(source).cast("long").alias("v"), F.lit(0).cast(dict(last.dtypes)["dist"]).alias("dist"))
    return last.filter(F.col("v") != source).select("lane", F.col("v").cast("long").alias("v"), "dist").unionByName(start)
