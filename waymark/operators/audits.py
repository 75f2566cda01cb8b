"""Constraints that a lane's trace must keep, each as a query for the rows that break it: lane, idx, what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.prefix import running
from waymark.operators.replay import labels_over_time
from waymark.operators.trace import LANE, is_kind
from waymark.schema import BATCH, DSTRUCT, FOREST, HEAP, NONE, PIVOT, RECURSE, RELAX, SETTLE


def broken(rows: DataFrame, what: str) -> DataFrame:
    return rows.select("lane", F.col("idx").cast("long").alias("idx"), F.lit(what).alias("what"))


def in_calls(trace: DataFrame) -> DataFrame:
    """trace with depth, call_level and call_bound: the recursion that is active at each row (after inward, before
    outward rows); the matching inward row is the last one at the same depth."""
    inward, outward = is_kind(RECURSE) & (F.col("aux0") == 0), is_kind(RECURSE) & (F.col("aux0") == 1)
    rows = running(trace, LANE, "idx", {"sum": ("sum", F.when(inward, 1).when(outward, -1).otherwise(0))})
    rows = rows.withColumn("depth", F.when(outward, F.col("sum") + 1).otherwise(F.col("sum"))).drop("sum")
    found = running(rows, ["lane", "depth"], "idx", {"call_level": ("last", F.when(inward, F.col("aux1"))), "call_bound": ("last", F.when(inward, F.col("aux_f")))})
    return found


def matched_calls(trace: DataFrame) -> DataFrame:
    """lane, depth, entered, left: every recursion's inward row and its outward one, null if it is never left."""
    rows = in_calls(trace).filter(is_kind(RECURSE))
    entered = running(rows, ["lane", "depth"], "idx", {"entered": ("last", F.when(F.col("aux0") == 0, F.col("idx")))})
    ends = entered.filter("aux0 = 1").select("lane", "depth", "entered", F.col("idx").alias("left"))
    begun = rows.filter("aux0 = 0").select("lane", "depth", F.col("idx").alias("entered"))
    return begun.join(ends, ["lane", "depth", "entered"], "left")


def nesting(trace: DataFrame) -> DataFrame:
    calls = broken(matched_calls(trace).filter("left is null").withColumn("idx", F.col("entered")), "recursion is not left")
    return calls.unionByName(broken(in_calls(trace).filter(is_kind(RECURSE) & (F.col("depth") < 1)), "recursion out without in"))


def settle_order(trace: DataFrame, dist: DataFrame) -> DataFrame:
    """dist(lane, v, dist): settled nearer than one settled before."""
    settles = trace.filter(is_kind(SETTLE)).select("lane", "idx", F.col("vertex").cast("long").alias("v")).join(dist, ["lane", "v"])
    found = running(settles, LANE, "idx", {"before": ("max", F.col("dist"))}, inclusive=False)
    return broken(found.filter(F.col("dist") < F.col("before")), "settled out of order")


def bounded_settles(trace: DataFrame, dist: DataFrame) -> DataFrame:
    """dist(lane, v, dist): settled beyond the active recursion's bound, or outside any."""
    rows = in_calls(trace).filter(is_kind(SETTLE)).withColumn("v", F.col("vertex").cast("long")).join(dist, ["lane", "v"])
    return broken(rows.filter(F.col("call_bound").isNull() | (F.col("dist") > F.col("call_bound"))), "settled beyond the bound")


def heap_levels(trace: DataFrame) -> DataFrame:
    rows = in_calls(trace).filter(is_kind(HEAP))
    return broken(rows.filter(F.col("call_level").isNull() | (F.col("call_level") != 0)), "heap above level 0")


def pull_sizes(trace: DataFrame, t: int) -> DataFrame:
    """More pulled at once than 2^((level - 1) t)."""
    rows = in_calls(trace).filter(is_kind(DSTRUCT) & (F.col("aux0") == 2))
    most = F.pow(F.lit(2.0), (F.col("call_level") - 1) * t)
    return broken(rows.filter(F.col("call_level").isNull() | (F.col("call_level") < 1) | (F.col("aux1") > most)), "pulled too many")


#: Classes of an improvement of a settled vertex: a shorter length, an equal one with a lesser label, the very label that
#: it had; and, in a trace that is wrong about it, a greater label.
CLASSES = ("strict-length", "lex-only", "equal-label", "no improvement")


def late_improvements(trace: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """lane, idx, v, settled_at, klass: vertices improved after they had settled, by how the new label (length, arcs,
    vertex, predecessor) stands to the one before. A vertex that no improvement has reached has no length yet."""
    over_time = labels_over_time(trace, edges, source)
    far = F.lit(float("inf"))
    length = F.coalesce(F.col("dist").cast("double"), far)
    label = F.struct(length.alias("length"), F.col("n_edges").alias("n_edges"), F.col("v").cast("long").alias("curr"), F.col("pred").cast("long").alias("pred"))
    steps = running(over_time.withColumn("label", label), ["lane", "v"], "idx", {"before": ("last", F.col("label"))}, inclusive=False)
    zero, none = F.lit(0).cast("long"), F.lit(NONE).cast("long")
    begin = F.struct(F.when(F.col("v") == source, 0.0).otherwise(far).alias("length"), zero.alias("n_edges"), F.col("v").cast("long").alias("curr"), none.alias("pred"))
    settles = trace.filter(is_kind(SETTLE)).groupBy("lane", F.col("vertex").cast("long").alias("v")).agg(F.min("idx").alias("settled_at"))
    late = steps.withColumn("before", F.coalesce("before", begin)).join(settles, ["lane", "v"]).filter(F.col("idx") > F.col("settled_at"))
    shorter, same = F.col("label.length") < F.col("before.length"), F.col("label.length") == F.col("before.length")
    klass = F.when(shorter, CLASSES[0]).when(same & (F.col("label") < F.col("before")), CLASSES[1]).when(F.col("label") == F.col("before"), CLASSES[2]).otherwise(CLASSES[3])
    return late.select("lane", "idx", "v", "settled_at", klass.alias("klass"))


def settled_once(trace: DataFrame) -> DataFrame:
    rows = running(trace.filter(is_kind(SETTLE)), ["lane", "vertex"], "idx", {"n": ("sum", F.lit(1))})
    return broken(rows.filter("n > 1"), "settled twice")


def batches(trace: DataFrame, n: int, m: int) -> DataFrame:
    """Batches that overlap or end without a start, and operands out of range."""
    rows = running(trace.filter(is_kind(BATCH)), LANE, "idx", {"open": ("sum", F.when(F.col("aux0") == 0, 1).otherwise(-1))})
    overlapping = broken(rows.filter("open < 0 or open > 1"), "batches overlap")
    return overlapping.unionByName(broken(trace.filter(out_of_range(n, m)), "operand out of range"))


def out_of_range(n: int, m: int) -> Column:
    bad_edge = F.col("kind").isin(RELAX, FOREST) & ~F.col("edge").between(0, m - 1)
    bad_vertex = F.col("kind").isin(SETTLE, PIVOT) & ~F.col("vertex").between(0, n - 1)
    return bad_edge | bad_vertex | (is_kind(PIVOT) & (F.col("aux0") < 0)) | (is_kind(FOREST) & (F.col("aux1") < 0))


def cut_groups(trace: DataFrame) -> DataFrame:
    """Edges cut into more than one tree of a call: lane, idx, what. A call's trees are edge-disjoint."""
    inward = is_kind(RECURSE) & (F.col("aux0") == 0)
    rows = running(trace.filter(is_kind(FOREST) | inward), LANE, "idx", {"call": ("sum", F.when(inward, 1).otherwise(0))})
    cuts = rows.filter(is_kind(FOREST) & (F.col("aux0") == 1)).groupBy("lane", "call", "edge").agg(F.min("idx").alias("idx"), F.count_distinct("aux1").alias("trees"))
    return broken(cuts.filter("trees > 1"), "an edge in two trees")


def label_shapes(dist: DataFrame, labels: DataFrame) -> DataFrame:
    """dist(lane, v, dist, pred) against the least labels (lane, v, label): lane, v and both where they differ."""
    wanted = labels.select("lane", "v", F.col("label.length").cast("double").alias("length"), F.col("label.pred").alias("want"))
    met = dist.join(wanted, ["lane", "v"], "full")
    return met.filter(~F.col("dist").eqNullSafe(F.col("length")) | ~F.col("pred").eqNullSafe(F.col("want"))).select("lane", "v", "dist", "pred", "length", "want")
