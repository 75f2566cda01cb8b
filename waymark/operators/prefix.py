"""Running aggregates over an ordered trace without gathering a lane in one task.

Rows are cut into slabs of idx; each slab's total is aggregated, the few slab totals are accumulated, and a window
inside each slab adds what lies before it. Sums, maxima, minima and last values all split this way.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.schema import SLAB
from waymark.staging import dealt


def total_of(kind: str, value: Column, idx: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), idx))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def over(kind: str, value: Column, window) -> Column:  # noqa: ANN001
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def joined(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    if kind == "last":
        return F.coalesce(here, before)
    return F.greatest(before, here) if kind == "max" else F.least(before, here)


def running(rows: DataFrame, by: list[str], idx: str, wanted: Mapping[str, tuple[str, Column]], inclusive: bool = True, slab: int = SLAB) -> DataFrame:
    """rows with a column for each wanted name: (kind, value) accumulated over idx within `by`.

    kind is sum, max, min or last (the last that isn't null). inclusive: the row itself counts.
    """
    columns = rows.columns
    cut = rows.withColumns({f"_v_{n}": v for n, (_, v) in wanted.items()}).withColumn("_slab", F.floor(F.col(idx) / slab))
    totals = cut.groupBy(*by, "_slab").agg(*(total_of(kind, F.col(f"_v_{n}"), F.col(idx)).alias(f"_t_{n}") for n, (kind, _) in wanted.items()))
    ahead = Window.partitionBy(*by).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "_slab", *(over(kind, F.col(f"_t_{n}"), ahead).alias(f"_b_{n}") for n, (kind, _) in wanted.items()))
    inside = Window.partitionBy(*by, "_slab").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    cut = cut.withColumns({f"_w_{n}": over(kind, F.col(f"_v_{n}"), inside) for n, (kind, _) in wanted.items()})
    met = cut.join(dealt(bases), [*by, "_slab"])
    return met.select(*columns, *(joined(kind, F.col(f"_b_{n}"), F.col(f"_w_{n}")).alias(n) for n, (kind, _) in wanted.items()))
