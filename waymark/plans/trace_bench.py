"""The benches of traces: writing and scanning mixed rows, and seeking in a lane."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import trace
from waymark.operators.playback import Playback
from waymark.schema import KINDS


def mixed_events(spark: SparkSession, n: int) -> DataFrame:
    """n logical events, their kinds in turn, their operands by their number: a workload of every kind of row."""
    i = F.col("idx")
    of = lambda kind, value: F.when(i % 8 == kind, value)
    one = lambda *pairs: F.coalesce(*(of(k, v) for k, v in pairs))
    rows = spark.range(n).withColumnRenamed("id", "idx")
    return rows.select(
        F.lit("mixed").alias("run_id"), F.lit(0).alias("lane"), "idx", F.get(F.array(*(F.lit(k) for k in KINDS)), (i % 8).cast("int")).alias("type"),
        one((1, i % 1024), (3, i % 1024)).cast("int").alias("v"), one((0, i % 4096), (6, i % 4096)).cast("int").alias("e"), one((2, i % 3), (4, i % 2), (5, i % 2), (6, i % 2), (7, i % 4)).cast("int").alias("op"),
        one((3, i % 32), (4, i % 32), (5, i % 32)).cast("int").alias("level"), of(6, i % 64).cast("int").alias("tree"), of(7, i % 128 + 1).cast("int").alias("n"), one((2, i % 16), (7, i % 12)).cast("int").alias("cmps"),
        of(4, i % 256 + 1).cast("int").alias("size"), of(5, F.when(i % 100 == 0, F.lit(float("inf"))).otherwise((i % 1000).cast("double"))).alias("bound"), of(0, i % 2 == 0).alias("improved"), of(1, i % 512).cast("int").alias("nth"),
    )


def write_and_scan(spark: SparkSession, n: int = 1_000_000) -> tuple[DataFrame, float]:
    """The tally of n mixed events, encoded and scanned, and the milliseconds that this took."""
    began = time.perf_counter()
    found = trace.tally(trace.encode(mixed_events(spark, n)))
    found.collect()
    return found, 1000 * (time.perf_counter() - began)


def replay(rows: DataFrame) -> dict[str, float]:
    """Milliseconds of a seek to the end, one back to the middle, and a frame's worth of steps from there."""
    lane, out = Playback(rows), {}
    for name, act in (("end", lambda: lane.seek(lane.total_work)), ("back", lambda: lane.seek(lane.total_work / 2)), ("frame", lambda: lane.seek(min(lane.total_work, lane.clock.cursor + 20_000 * 8 / 60)))):
        began = time.perf_counter()
        act()
        out[name] = 1000 * (time.perf_counter() - began)
    return out
