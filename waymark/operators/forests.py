"""Forests as tables of (v, parent), roots with a null parent: sizes of subtrees, roots worth keeping, connected groups.

Nothing here goes level by level or gathers a vertex's children. The walk around each tree that enters and leaves every
vertex once is a linked list of steps, a row each with one successor; ranking the list by doubling takes as many rounds
as its length has binary digits, and every join is on keys that are unique on both sides, however many children a vertex
has. Children are in ascending order; next ones are found by their numbers in a sort by range.

Groups of s to 3s vertices come from a running count that each vertex passes upward. A vertex and its next child
make a node of a binary tree: left is the count after the child before, right what the child's own subtree passes on.
The binary tree is contracted: nodes with both values are done, nodes with one become functions of the other, a list of s - 1
numbers, and functions of functions are composed, which halves the chains of a round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.sssp import tight_predecessors
from waymark.sources.graphs import ordered
from waymark.staging import dealt, discard, stage

#: Doublings in one job.
JUMPS = 2


def numbered(forest: DataFrame) -> DataFrame:
    """v, parent, nth (dense from 0 in the order of parent, v, roots first), up (the parent's nth), before and after (the
    nth of the siblings beside it), first and last (the nth of its first and last child)."""
    rows = ordered(forest.select(F.col("v").cast("long").alias("v"), F.col("parent").cast("long").alias("parent")), ["parent", "v"], "nth")
    ends = rows.filter("parent is not null").groupBy(F.col("parent").alias("v")).agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    with_ends = stage(rows.join(ends, "v", "left"), "ends")
    of = with_ends.select(F.col("v").alias("parent"), F.col("nth").alias("up"), F.col("first").alias("low"), F.col("last").alias("high"))
    met = with_ends.filter("parent is not null").join(of, "parent", "left")
    inner = met.select("v", "parent", "nth", "up", F.when(F.col("nth") > F.col("low"), F.col("nth") - 1).alias("before"), F.when(F.col("nth") < F.col("high"), F.col("nth") + 1).alias("after"), "first", "last")
    none = F.lit(None).cast("long")
    roots = with_ends.filter("parent is null").select("v", "parent", "nth", none.alias("up"), none.alias("before"), none.alias("after"), "first", "last")
    return stage(inner.unionByName(roots), "forest")


def followed(rows: DataFrame, most: int) -> DataFrame:
    """rows(node, next, steps) with how many steps lead to the end, and `last`, the node there. next is null at an end.

    Rows that have arrived only stand ready to be met. most: an upper bound of the steps, beyond which there is a circle."""
    rows = stage(rows.select("node", "next", "steps", F.when(F.col("next").isNull(), F.col("node")).alias("last")), "list")
    done = 0
    while rows.filter("next is not null").head(1):
        if 2**done > most:
            raise ValueError("a circle has no end")
        ahead = rows
        for _ in range(JUMPS):
            met = ahead.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("steps").alias("more"), F.col("last").alias("end"))
            moved = ahead.filter("next is not null").join(dealt(met), "next").select("node", F.col("then").alias("next"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("last"))
            ahead = moved.unionByName(ahead.filter("next is null"))
        before, rows = rows, stage(ahead, "list")
        discard(before)
        done += JUMPS
    return rows


def walked(tree: DataFrame) -> DataFrame:
    """numbered() with root (its nth), entered and left: steps from entering and from leaving the vertex to the end of its
    tree's walk."""
    enter, leave = 2 * F.col("nth"), 2 * F.col("nth") + 1
    one = F.lit(1).cast("long")
    into = tree.select(enter.alias("node"), F.coalesce(2 * F.col("first"), leave).alias("next"), one.alias("steps"))
    onward = F.coalesce(2 * F.col("after"), 2 * F.col("up") + 1)
    out = tree.select(leave.alias("node"), onward.alias("next"), F.when(onward.isNull(), 0).otherwise(1).cast("long").alias("steps"))
    ranks = followed(into.unionByName(out), 2 * tree.count() + 1)
    side, nth = F.col("node") % 2, F.shiftright("node", 1)
    found = ranks.groupBy(nth.alias("nth")).agg(F.max(F.when(side == 0, F.col("steps"))).alias("entered"), F.max(F.when(side == 1, F.col("steps"))).alias("left"), F.max(F.shiftright("last", 1)).alias("root"))
    return tree.join(found, "nth")


def subtrees(forest: DataFrame) -> DataFrame:
    """v, parent, root, size: every vertex's root and how many vertices stand in its subtree, itself included."""
    rows = stage(walked(numbered(forest)), "walked")
    tops = rows.filter("parent is null").select(F.col("nth").alias("root"), F.col("v").alias("top"))
    return rows.join(tops, "root").select("v", "parent", F.col("top").alias("root"), ((F.col("entered") - F.col("left") + 1) / 2).cast("long").alias("size"))


def pivots(forest: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """v, size: the sources(v) that are roots of trees of k vertices or more."""
    return subtrees(forest).filter((F.col("parent").isNull()) & (F.col("size") >= k)).join(sources.select("v").distinct(), "v", "left_semi").select("v", "size")


def near(edges: DataFrame, start: DataFrame, bound: float | None, k: int) -> DataFrame:
    """v, dist after k rounds from start(v, dist): every arc out of a layer is taken at once, candidates below the bound
    make the next layer. Only vertices that stood in a layer, with their least values."""
    kind = dict(edges.dtypes)["w"]
    found = stage(start.select("v", F.col("dist").cast(kind).alias("dist")).groupBy("v").agg(F.min("dist").alias("dist")), "near")
    layer = found
    for _ in range(k):
        made = edges.join(layer.withColumnRenamed("v", "src"), "src").select(F.col("dst").alias("v"), (F.col("dist") + F.col("w")).alias("new"))
        if bound is not None:
            made = made.filter(F.col("new") < F.lit(bound))
        least = made.groupBy("v").agg(F.min("new").alias("new"))
        layer = stage(least.join(found, "v", "left").filter(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("v", F.col("new").alias("dist")), "layer")
        if not layer.head(1):
            break
        found = stage(found.unionByName(layer).groupBy("v").agg(F.min("dist").alias("dist")), "near")
    return found


def find_pivots(edges: DataFrame, start: DataFrame, bound: float | None, k: int) -> tuple[DataFrame, DataFrame, bool]:
    """(pivots(v), reached(v, dist), whether the search was given up) of k rounds from start(v, dist) below the bound.

    If more than k vertices a source are reached, all sources are pivots; otherwise those that are roots, in the forest of
    tight arcs among the vertices reached, of k vertices or more."""
    if k < 1:
        raise ValueError("at least one round")
    reached = near(edges, start, bound, k)
    sources = start.select("v").distinct()
    if reached.count() > k * sources.count():
        return sources, reached, True
    parents = tight_predecessors(edges, reached)
    forest = reached.select("v").join(parents, "v", "left").select("v", F.col("pred").alias("parent"))
    return pivots(forest, sources, k).select("v"), reached, False


def stepped(left: Column, right: Column, s: int) -> Column:
    """The running count after a child: it starts anew at 1 when a group is full."""
    return F.when(left + right >= s, 1).otherwise(left + right).cast("int")


def contracted(nodes: DataFrame, s: int) -> DataFrame:
    """nodes(id, l, r) of a binary tree with value = stepped(l, r), null inputs being 1 -> id, val."""
    values = F.sequence(F.lit(1), F.lit(s - 1))
    one, none = F.lit(1), F.lit(None)
    rows = nodes.select("id", "l", "r", F.when(F.col("l").isNull(), one).cast("int").alias("lv"), F.when(F.col("r").isNull(), one).cast("int").alias("rv"), none.cast("array<int>").alias("f"), none.cast("long").alias("ptr"), none.cast("int").alias("val"))

    def settled(rows: DataFrame) -> DataFrame:
        """Nodes with both inputs get their value, nodes with one their function."""
        both, lone = F.col("lv").isNotNull() & F.col("rv").isNotNull(), F.col("f").isNull() & (F.col("lv").isNotNull() | F.col("rv").isNotNull())
        of_right, of_left = F.transform(values, lambda x: stepped(F.col("lv"), x, s)), F.transform(values, lambda x: stepped(x, F.col("rv"), s))
        val = F.coalesce("val", F.when(both & F.col("f").isNull(), stepped(F.col("lv"), F.col("rv"), s)))
        f = F.when(lone & ~both, F.when(F.col("lv").isNotNull(), of_right).otherwise(of_left)).otherwise(F.col("f"))
        ptr = F.when(lone & ~both, F.when(F.col("lv").isNotNull(), F.col("r")).otherwise(F.col("l"))).otherwise(F.col("ptr"))
        return rows.select("id", "l", "r", "lv", "rv", f.alias("f"), ptr.alias("ptr"), val.alias("val"))

    rows = stage(settled(rows), "nodes")
    while rows.filter("val is null").head(1):
        done, chains, pairs = rows.filter("val is not null"), rows.filter("val is null and f is not null"), rows.filter("val is null and f is null")
        told = rows.select(F.col("id").alias("ptr"), F.col("val").alias("v2"), F.col("f").alias("f2"), F.col("ptr").alias("p2"))
        met = chains.join(dealt(told), "ptr")
        at = lambda x: F.get(F.col("f"), x - 1)
        jumped = met.select("id", "l", "r", "lv", "rv", F.when(F.col("f2").isNotNull(), F.transform("f2", at)).otherwise(F.col("f")).alias("f"), F.when(F.col("f2").isNotNull(), F.col("p2")).otherwise(F.col("ptr")).alias("ptr"), at(F.col("v2")).alias("val"))
        for side in ("l", "r"):
            known = done.select(F.col("id").alias(side), F.col("val").alias("new"))
            pairs = pairs.join(dealt(known), side, "left").withColumn(f"{side}v", F.coalesce(f"{side}v", "new")).drop("new")
        before, rows = rows, stage(done.unionByName(jumped).unionByName(settled(pairs.select(*rows.columns))), "nodes")
        discard(before)
    return rows.select("id", "val")


def groups(forest: DataFrame, s: int) -> DataFrame:
    """v, parent, grp for every arc (parent, v) of the forest: arcs of one grp are connected, no arc is in two, and a group
    has s to 3s - 2 vertices; a tree of fewer than s is one group.

    Children are taken in ascending order; the count of a vertex and of what its children pass on makes a group when it
    comes to s, and starts anew from the vertex alone; what is left passes upward. What is left at a root joins the group
    of its tree that was made last. A group is named by the child whose arc filled it, a tree without one by its root."""
    if s < 2:
        raise ValueError("a group needs two vertices at least")
    tree = stage(walked(numbered(forest)), "walked")
    arcs = tree.filter("parent is not null")
    values = contracted(arcs.select(F.col("nth").alias("id"), F.col("before").alias("l"), F.col("last").alias("r")), s)
    left, right = values.select(F.col("id").alias("before"), F.col("val").alias("lv")), values.select(F.col("id").alias("last"), F.col("val").alias("rv"))
    met = arcs.join(left, "before", "left").join(right, "last", "left")
    full = F.coalesce("lv", F.lit(1)) + F.coalesce("rv", F.lit(1)) >= s
    top = F.col("up") == F.col("root")
    onward = F.when(full, None).when(F.col("after").isNotNull(), F.col("after")).when(~top, F.col("up"))
    marked = stage(met.select("v", "parent", "nth", "root", F.col("left").alias("late"), full.alias("full"), onward.alias("next")), "marked")
    ends = followed(marked.select(F.col("nth").alias("node"), "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps")), 4 * s)
    filled = marked.filter("full")
    latest = filled.groupBy("root").agg(F.min_by("nth", "late").alias("latest"))
    names = marked.select(F.col("nth").alias("grp_nth"), F.col("v").alias("grp"))
    tops = tree.filter("parent is null").select(F.col("nth").alias("root"), F.col("v").alias("top"))
    whole = marked.select("v", "parent", "nth", "root").join(ends.select(F.col("node").alias("nth"), "last"), "nth")
    whole = whole.join(filled.select(F.col("nth").alias("last"), F.lit(True).alias("is_full")), "last", "left").join(latest, "root", "left").join(tops, "root")
    whole = whole.withColumn("grp_nth", F.when(F.col("is_full"), F.col("last")).otherwise(F.col("latest")))
    return whole.join(names, "grp_nth", "left").select("v", "parent", F.coalesce("grp", "top").alias("grp"))


def rounds_for(n: int) -> int:
    """How many doublings a list of n steps takes."""
    return max(0, math.ceil(math.log2(max(1, n))))
