"""Which vertex ends a race, and what is said about the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import sssp


def resolved(edges: DataFrame, vertices: DataFrame, source: int, target: str | int | None) -> tuple[int | None, str | None]:
    """(finish, status). "none": no finish. No target, the source itself, or none of the vertices: the farthest vertex
    reached, the latter two with a warning. A target out of reach stays, with a warning."""
    if target == "none":
        return None, None
    reached = sssp.reachable(edges, source)

    def farthest(status: str | None) -> tuple[int | None, str | None]:
        row = sssp.finish(reached, vertices, source).first()
        return (None, f"no vertex is reachable from source {source}") if row is None else (row["v"], status)

    if target is None:
        return farthest(None)
    if target == source:
        return farthest(f"target {target} is the source; using auto-pick")
    if not vertices.filter(F.col("v") == target).head(1):
        return farthest(f"target {target} is out of range; using auto-pick")
    if not reached.filter(F.col("v") == target).head(1):
        return target, f"target {target} unreachable from source"
    return target, None


def frozen(settles: DataFrame, finish: int) -> DataFrame:
    """settles(lane, v) -> lane, frozen: whether the lane has settled the finish."""
    return settles.groupBy("lane").agg(F.bool_or(F.col("v") == finish).alias("frozen"))
