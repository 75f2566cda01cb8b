"""A trace kept as a table that point queries read in part.

The rows of a lane lie in folders, one for SLABS slabs of idx in a row, each with the billed work after it. Beside them stands a
small index, a row a slab: its rows, and the work before and after it. A position on the clock is found in the index, and the one
folder of each lane that holds it is read: the index's rows prune the folders while the query runs. Keyframes lie
in folders by lane, FRAMES frames of billed work in each, and hold what a frame has changed, so that the frames up to a position
and the slabs of one frame restore the state there. Rows that are added rewrite a lane's last folders alone.

Folders are named and moved one by one where a write is committed, and listed where it is read. There is one for about a hundred
thousand rows, not for every slab.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.trace import snapshots_of, work_after
from waymark.schema import KEYFRAME_WORK, SLAB
from waymark.staging import stage

#: Slabs and frames in one folder.
SLABS, FRAMES = 256, 256
ROWS = ("idx", "kind", "vertex", "edge", "aux0", "aux1", "aux2", "aux_f", "cost", "work_after")


def put(df: DataFrame, path: str, *folders: str) -> None:
    """Write df under path in folders of its own; only the folders that it has rows for are replaced."""
    df.repartition(*folders).sortWithinPartitions(*folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def slabs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def index(spark: SparkSession, path: str) -> DataFrame:
    """lane, chunk, slab (the folder), n, work_before, work_after: a row a slab."""
    return spark.read.parquet(f"{path}/index").select("lane", "chunk", "slab", "n", "work_before", "work_after")


def frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/frames")


def kept(rows: DataFrame, base: DataFrame | None, path: str, slab: int, every: int, edges: DataFrame) -> None:
    """Write rows in whole slabs, the index rows and the frames for them. base(lane, chunk, work): each lane's first chunk
    among the rows and the work before it."""
    spark = rows.sparkSession
    met = work_after(rows.select("lane", *(c for c in ROWS if c != "work_after")))
    if base is not None:
        met = met.join(F.broadcast(base.select("lane", "work")), "lane", "left").withColumn("work_after", F.col("work_after") + F.coalesce("work", F.lit(0))).drop("work")  # a row a lane
    chunk = F.floor(F.col("idx") / slab)
    met = stage(met.select("lane", chunk.alias("chunk"), F.concat_ws("-", "lane", F.floor(chunk / SLABS)).alias("slab"), *ROWS), "slabs")
    put(met, f"{path}/rows", "slab")
    touched = met.groupBy("lane", "chunk", "slab").agg(F.count("*").alias("n"), (F.min("work_after") - F.min_by("cost", "idx")).alias("work_before"), F.max("work_after").alias("work_after"))
    if base is not None:
        old = index(spark, path).join(F.broadcast(base.select("lane", F.col("chunk").alias("last"))), "lane").filter("chunk < last").drop("last")
        touched_lanes = met.select("lane").distinct()
        touched = touched.unionByName(old.join(touched_lanes, "lane", "left_semi"))
    whole = stage(touched, "index")
    put(whole, f"{path}/index", "lane")
    low = met.groupBy("lane").agg((F.min(F.floor((F.col("work_after") - F.col("cost")) / (every * FRAMES))) * FRAMES).alias("low"))
    wanted = index(spark, path).join(F.broadcast(low), "lane").filter(F.floor(F.col("work_after") / every) >= F.col("low")).select("slab", "low").distinct()
    again = slabs(spark, path).join(F.broadcast(wanted), "slab").withColumn("frame", F.floor(F.col("work_after") / every)).filter("frame >= low")  # a row a folder
    put(changes(again, edges).withColumn("frames", F.floor(F.col("frame") / FRAMES)), f"{path}/frames", "lane", "frames")


def changes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """lane, frame, v, pred, settled that each frame's rows leave behind."""
    by_frame = rows.withColumn("lane", F.struct("lane", "frame"))
    return snapshots_of(by_frame, edges).select("lane.lane", "lane.frame", "v", "pred", "settled")


def store(trace: DataFrame, path: str, edges: DataFrame, slab: int = SLAB, every: int = KEYFRAME_WORK) -> None:
    """Keep the trace's lanes under path, which is new."""
    kept(trace, None, path, slab, every, edges)


def append(trace: DataFrame, path: str, edges: DataFrame, slab: int = SLAB, every: int = KEYFRAME_WORK) -> None:
    """Add rows that follow a lane's, or new lanes. What is read again is each lane's last folder, what is written the folders of
    slabs and of frames from there on."""
    spark = trace.sparkSession
    found = index(spark, path)
    starts = found.groupBy("lane", "slab").agg(F.min("chunk").alias("chunk"), F.min_by("work_before", "chunk").alias("work"))
    last = starts.groupBy("lane").agg(F.max_by(F.struct("chunk", "slab", "work"), "chunk").alias("at")).select("lane", "at.chunk", "at.slab", "at.work")
    last = stage(last.join(trace.select("lane").distinct(), "lane", "left_semi"), "last")
    tail = slabs(spark, path).join(F.broadcast(last.select("slab")), "slab")  # a row a lane
    columns = ["lane", *(c for c in ROWS if c != "work_after")]
    rows = stage(tail.select(*columns).unionByName(trace.select(*columns)), "tail")
    kept(rows, last, path, slab, every, edges)


def seek(spark: SparkSession, path: str, t: float) -> DataFrame:
    """lane, position: how many rows have work_after of at most t; one folder a lane is read."""
    if not 0 <= t < float("inf"):
        raise ValueError("the clock's position must be finite and not negative")
    found = index(spark, path)
    full = found.groupBy("lane").agg(F.coalesce(F.sum(F.when(F.col("work_after") <= t, F.col("n"))), F.lit(0)).alias("full"))
    cut = found.filter((F.col("work_before") <= t) & (F.col("work_after") > t)).select("slab", "chunk")
    inside = slabs(spark, path).join(F.broadcast(cut), ["slab", "chunk"]).groupBy("lane").agg(F.count_if(F.col("work_after") <= t).alias("part"))  # a row a lane
    return full.join(inside, "lane", "left").select("lane", (F.col("full") + F.coalesce("part", F.lit(0))).cast("long").alias("position"))


def next_boundary(spark: SparkSession, path: str, t: float) -> DataFrame:
    """lane, next_work: the least work_after beyond t, null where the lane has ended; one folder a lane is read."""
    found = index(spark, path)
    ahead = found.filter((F.col("work_before") <= t) & (F.col("work_after") > t)).select("slab", "chunk")
    inside = slabs(spark, path).join(F.broadcast(ahead), ["slab", "chunk"]).filter(F.col("work_after") > t).groupBy("lane").agg(F.min("work_after").alias("next_work"))
    return found.select("lane").distinct().join(inside, "lane", "left")


def restored(spark: SparkSession, path: str, edges: DataFrame, t: float, every: int = KEYFRAME_WORK) -> DataFrame:
    """lane, v, pred, settled at clock position t: from the frames before t's and the slabs that hold rows of that frame."""
    frame = int(t // every)
    cut = index(spark, path).filter((F.col("work_before") <= t) & (F.col("work_after") >= frame * every)).select("slab", "chunk")
    tail = slabs(spark, path).join(F.broadcast(cut), ["slab", "chunk"]).filter((F.col("work_after") <= t) & (F.col("work_after") >= frame * every))
    late = snapshots_of(tail, edges).withColumn("frame", F.lit(frame).cast("long"))
    stored = frames(spark, path).filter((F.col("frames") <= frame // FRAMES) & (F.col("frame") < frame)).select("lane", F.col("frame").cast("long").alias("frame"), "v", "pred", "settled")
    both = stored.unionByName(late)
    return both.groupBy("lane", "v").agg(F.max_by("pred", F.when(F.col("pred").isNotNull(), F.col("frame"))).alias("pred"), F.bool_or("settled").alias("settled"))


