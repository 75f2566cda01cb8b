"""The drawing layer's computations as projections: cameras, shades and windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: billed operations for which a mark stays visible.
VISIBLE = 10_000


def in_window(now: Column, at: Column, span: int = VISIBLE) -> Column:
    return (now - at >= 0) & (now - at < span)


def shade(nth: Column, n: int, steps: int = 256) -> Column:
    """The place of the nth of n settled in a table of steps."""
    return F.floor(F.lit(float(steps - 1)) * nth / max(1, n - 1)).cast("long")


def camera(vertices: DataFrame, width: float, height: float) -> DataFrame:
    """One row: scale, left, top and dot radius that fit all vertices into width by height."""
    box = vertices.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    scale = F.least(F.lit(width) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9)), F.lit(height) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-9)))
    radius = F.greatest(F.lit(1.5), F.least(F.lit(4.0), F.lit(0.35 * min(width, height)) / F.sqrt("n")))
    return box.select(scale.alias("scale"), F.col("x0").alias("left"), F.col("y0").alias("top"), radius.alias("radius"))


def grid(vertices: DataFrame, cells: int) -> DataFrame:
    """gx, gy, n: vertices in each cell of a grid over their box."""
    box = vertices.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, a, b: F.least(F.floor((F.col(v) - F.col(a)) * cells / F.greatest(F.col(b) - F.col(a), F.lit(1e-9))), F.lit(cells - 1))
    return vertices.join(F.broadcast(box), F.lit(True)).groupBy(cell("x", "x0", "x1").alias("gx"), cell("y", "y0", "y1").alias("gy")).agg(F.count("*").alias("n"))


#: Fixed value: marks after which the whole canvas counts as changed.
MOST_HITS = 256


def dirty_box(marks: DataFrame, width: int, height: int) -> DataFrame:
    """marks(cx, cy, radius) -> one row: hits, whole, and the box around all marks, clipped to the canvas; no box (nulls)
    if none touches it, the canvas itself beyond MOST_HITS marks."""
    side = lambda c, r, most: (F.greatest(F.floor(F.col(c) - F.col(r)), F.lit(0)), F.least(F.ceil(F.col(c) + F.col(r)), F.lit(most - 1)))
    (x0, x1), (y0, y1) = side("cx", "radius", width), side("cy", "radius", height)
    rows = marks.select(x0.alias("a"), y0.alias("b"), x1.alias("c"), y1.alias("d"))
    seen = (F.col("a") <= F.col("c")) & (F.col("b") <= F.col("d"))
    of = lambda f, c: f(F.when(seen, F.col(c)))
    box = rows.agg(F.count("*").alias("hits"), of(F.min, "a").alias("a"), of(F.min, "b").alias("b"), of(F.max, "c").alias("c"), of(F.max, "d").alias("d"))
    whole = F.col("hits") > MOST_HITS
    pick = lambda all_, some: F.when(whole, F.lit(all_)).otherwise(some).cast("long")
    return box.select("hits", whole.alias("whole"), pick(0, F.col("a")).alias("x"), pick(0, F.col("b")).alias("y"), pick(width, F.col("c") - F.col("a") + 1).alias("w"), pick(height, F.col("d") - F.col("b") + 1).alias("h"))


#: Fixed value: the factor that spreads numbers of trees over the table of shades.
TREE_FACTOR = 2_654_435_761


def tree_shade(tree: Column, steps: int = 256) -> Column:
    """The place of a tree's number in a table of steps, neighbours far apart."""
    return F.pmod(F.pmod(tree.cast("long") * F.lit(TREE_FACTOR), F.lit(2**32)), F.lit(steps)).cast("long")
