"""Queries over traces: billing, clock positions, and the state that a prefix of a trace leaves behind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.prefix import running
from waymark.schema import BATCH, DSTRUCT, FOREST, HEAP, KEYFRAME_WORK, KINDS, NONE, PIVOT, RECURSE, RELAX, SETTLE, SLAB

LANE = ["lane"]


def is_kind(kind: int) -> Column:
    return F.col("kind") == kind


def cost(kind: Column, aux1: Column, aux2: Column) -> Column:
    """A comparison, relaxation or settling costs 1; heap and list operations what they compared; the rest nothing."""
    return F.when(kind.isin(RELAX, SETTLE), 1).when(kind == HEAP, aux1).when(kind == DSTRUCT, aux2).otherwise(0).cast("long")


def encode(events: DataFrame) -> DataFrame:
    """Logical events (run_id, lane, idx, type, v, e, op, level, tree, n, cmps, size, bound, improved, nth) packed into trace rows."""
    kind = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("type")).cast("int") - 1
    pick = lambda *pairs: F.coalesce(*(F.when(F.col("type").isin(*k), c) for k, c in pairs), F.lit(NONE)).cast("int")
    one = lambda name, c: ((name,), F.col(c))
    rows = events.withColumn("kind", F.when(kind >= 0, kind).otherwise(F.raise_error(F.concat(F.lit("unknown event type "), F.col("type")))))
    return rows.select(
        "run_id", "lane", "idx", (F.floor(F.col("idx") / SLAB)).cast("int").alias("chunk"), (F.col("idx") % SLAB).cast("int").alias("row"), "kind",
        pick((("settle", "pivot"), F.col("v"))).alias("vertex"), pick((("relax", "forest"), F.col("e"))).alias("edge"),
        pick((("relax",), F.col("improved").cast("int")), one("settle", "nth"), (("pivot",), F.col("level")), (("heap", "batch", "recurse", "forest", "dstruct"), F.col("op"))).alias("aux0"),
        pick(one("heap", "cmps"), (("batch", "recurse"), F.col("level")), one("forest", "tree"), one("dstruct", "n")).alias("aux1"),
        pick(one("batch", "size"), one("dstruct", "cmps")).alias("aux2"),
        F.when(F.col("type") == "recurse", F.col("bound")).otherwise(0.0).alias("aux_f"),
        F.when(F.col("type").isin("relax", "settle"), 1).when(F.col("type").isin("heap", "dstruct"), F.col("cmps")).otherwise(0).cast("long").alias("cost"),
    )


def decode(trace: DataFrame) -> DataFrame:
    """Trace rows with the type's name and the operands by their meaning; unknown codes raise an error."""
    when = lambda kinds, c: F.when(F.col("kind").isin(*kinds), F.col(c))
    name = F.get(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    return trace.select(
        "run_id", "lane", "idx", F.when(name.isNotNull() & (F.col("kind") >= 0), name).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.col("kind").cast("string")))).alias("type"),
        when((SETTLE, PIVOT), "vertex").alias("v"), when((RELAX, FOREST), "edge").alias("e"), when((HEAP, BATCH, RECURSE, FOREST, DSTRUCT), "aux0").alias("op"),
        F.coalesce(when((PIVOT,), "aux0"), when((BATCH, RECURSE), "aux1")).alias("level"), when((FOREST,), "aux1").alias("tree"), when((DSTRUCT,), "aux1").alias("n"),
        F.coalesce(when((HEAP,), "aux1"), when((DSTRUCT,), "aux2")).alias("cmps"), when((BATCH,), "aux2").alias("size"), when((RECURSE,), "aux_f").alias("bound"),
        (F.when(is_kind(RELAX), F.col("aux0") == 1)).alias("improved"), when((SETTLE,), "aux0").alias("nth"),
    )


def tally(trace: DataFrame) -> DataFrame:
    """lane, work, and how many rows there are of each kind."""
    return trace.groupBy(*LANE).agg(F.sum("cost").cast("long").alias("work"), *(F.count_if(is_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)))


def work_after(trace: DataFrame) -> DataFrame:
    """trace with work_after: the lane's billed work up to and including the row."""
    return running(trace, LANE, "idx", {"work_after": ("sum", F.col("cost"))})


def seek(trace: DataFrame, t: float) -> DataFrame:
    """lane, position: how many rows have work_after of at most t (rows of no cost at t included)."""
    if not 0 <= t < float("inf"):
        raise ValueError("the clock's position must be finite and not negative")
    return work_after(trace).groupBy(*LANE).agg(F.count_if(F.col("work_after") <= t).cast("long").alias("position"))


def next_boundary(trace: DataFrame, t: float) -> DataFrame:
    """lane, next_work: the least work_after beyond t; null where the lane has ended."""
    return work_after(trace).groupBy(*LANE).agg(F.min(F.when(F.col("work_after") > t, F.col("work_after"))).alias("next_work"))


def shared_steps(trace: DataFrame, t: float) -> DataFrame:
    """lane, sought, stepped_op, stepped_event: rows applied in every lane when the shared clock is sought at t, then moved by
    one billed operation, then to the next row of any lane behind that."""
    rows = work_after(trace).select("lane", "work_after")
    ahead = rows.filter(F.col("work_after") > t + 1).agg(F.coalesce(F.min("work_after"), F.lit(t + 1)).alias("next"))
    applied = lambda upto, name: F.count_if(F.col("work_after") <= upto).cast("long").alias(name)
    return rows.join(F.broadcast(ahead), F.lit(True)).groupBy("lane").agg(applied(t, "sought"), applied(t + 1, "stepped_op"), applied(F.col("next"), "stepped_event"))  # one row


def until(trace: DataFrame, t: float) -> DataFrame:
    """The rows applied at clock position t, with work_after."""
    return work_after(trace).filter(F.col("work_after") <= t)


def settle_records(trace: DataFrame) -> DataFrame:
    """lane, vertex, nth, settle_work; raises if a vertex settles twice."""
    rows = work_after(trace).filter(is_kind(SETTLE)).groupBy("lane", "vertex").agg(F.count("*").alias("n"), F.min("aux0").alias("nth"), F.min("work_after").alias("settle_work"))
    return rows.select("lane", "vertex", F.when(F.col("n") == 1, F.col("nth")).otherwise(F.raise_error(F.lit("a vertex settles twice"))).alias("nth"), "settle_work")


def out_of_order(settles: DataFrame) -> DataFrame:
    """settles(lane, idx, vertex, dist): those whose dist lies below the greatest settled before."""
    found = running(settles, LANE, "idx", {"before": ("max", F.col("dist"))}, inclusive=False)
    return found.filter(F.col("dist") < F.col("before")).select("lane", "idx", "vertex", "dist", "before")


def replayed(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """lane, v, pred: the tail of the latest improving relaxation into each vertex."""
    hits = trace.filter(is_kind(RELAX) & (F.col("aux0") == 1)).join(edges.select(F.col("e").alias("edge"), "src", "dst"), "edge")
    return hits.groupBy("lane", F.col("dst").alias("v")).agg(F.max_by("src", "idx").alias("pred"))


def frontier(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """lane, v: improved and not settled."""
    improved = trace.filter(is_kind(RELAX) & (F.col("aux0") == 1)).join(edges.select(F.col("e").alias("edge"), F.col("dst").alias("v")), "edge").select("lane", "v").distinct()
    settled = trace.filter(is_kind(SETTLE)).select("lane", F.col("vertex").cast("long").alias("v"))
    return improved.join(settled, ["lane", "v"], "left_anti")


def last_relax_work(trace: DataFrame) -> DataFrame:
    """lane, edge, work: the clock after the latest improving relaxation of each edge."""
    return work_after(trace).filter(is_kind(RELAX) & (F.col("aux0") == 1)).groupBy("lane", "edge").agg(F.max("work_after").alias("work"))


def pivot_flares(trace: DataFrame) -> DataFrame:
    """lane, vertex, work: the clock at the latest pivot on each vertex."""
    return work_after(trace).filter(is_kind(PIVOT)).groupBy("lane", "vertex").agg(F.max("work_after").alias("work"))


def pivots_since(trace: DataFrame) -> DataFrame:
    """lane, idx, since: pivots since the last recursion inward, at each pivot."""
    inward = is_kind(RECURSE) & (F.col("aux0") == 0)
    rows = trace.filter(is_kind(PIVOT) | inward)
    pivots = F.when(is_kind(PIVOT), 1).otherwise(0)
    rows = running(rows, LANE, "idx", {"n": ("sum", pivots)})
    rows = running(rows, LANE, "idx", {"mark": ("last", F.when(inward, F.col("n")))})
    return rows.filter(is_kind(PIVOT)).select("lane", "idx", (F.col("n") - F.coalesce("mark", F.lit(0))).cast("long").alias("since"))


def recursion(trace: DataFrame, strict: bool = True) -> DataFrame:
    """lane, idx, depth, bound after each recursion row: inward adds 1, outward takes 1; strict: raises below 0."""
    rows = trace.filter(is_kind(RECURSE))
    inward = F.col("aux0") == 0
    found = running(rows, LANE, "idx", {"depth": ("sum", F.when(inward, 1).otherwise(-1)), "bound": ("last", F.when(inward, F.col("aux_f")))})
    depth = F.col("depth").cast("long")
    if strict:
        depth = F.when(depth < 0, F.raise_error(F.lit("recursion out without in")).cast("long")).otherwise(depth)
    return found.select("lane", "idx", depth.alias("depth"), "bound")


def batch_rounds(trace: DataFrame) -> DataFrame:
    """lane, idx, round at each start of a batch: starts since the last recursion inward or list operation."""
    reset = is_kind(DSTRUCT) | (is_kind(RECURSE) & (F.col("aux0") == 0))
    started = is_kind(BATCH) & (F.col("aux0") == 0)
    rows = trace.filter(reset | started)
    rows = running(rows, LANE, "idx", {"n": ("sum", F.when(started, 1).otherwise(0))})
    rows = running(rows, LANE, "idx", {"mark": ("last", F.when(reset, F.col("n")))})
    return rows.filter(started).select("lane", "idx", (F.col("n") - F.coalesce("mark", F.lit(0))).cast("long").alias("round"))


def region_sizes(trace: DataFrame) -> DataFrame:
    """lane, idx, size after each list operation: inserts and merges add n, pulls take n, never below 0.

    The clamped sum is the free sum less its least prefix, if that is negative.
    """
    change = F.when(F.col("aux0").isin(0, 3), F.col("aux1")).when(F.col("aux0") == 2, -F.col("aux1")).otherwise(0)
    rows = running(trace.filter(is_kind(DSTRUCT)), LANE, "idx", {"p": ("sum", change)})
    rows = running(rows, LANE, "idx", {"low": ("min", F.col("p"))})
    return rows.select("lane", "idx", (F.col("p") - F.least(F.lit(0), F.col("low"))).cast("long").alias("size"))


def batch_state(trace: DataFrame) -> DataFrame:
    """lane, idx, open, level, size, round after each batch row: whether a batch is open, its level, what its last row
    counted, and starts since the last recursion inward or list operation."""
    reset = is_kind(DSTRUCT) | (is_kind(RECURSE) & (F.col("aux0") == 0))
    started = is_kind(BATCH) & (F.col("aux0") == 0)
    rows = running(trace.filter(reset | is_kind(BATCH)), LANE, "idx", {"n": ("sum", F.when(started, 1).otherwise(0))})
    rows = running(rows, LANE, "idx", {"mark": ("last", F.when(reset, F.col("n")))})
    round_ = (F.col("n") - F.coalesce("mark", F.lit(0))).cast("long")
    return rows.filter(is_kind(BATCH)).select("lane", "idx", (F.col("aux0") == 0).alias("open"), F.col("aux1").alias("level"), F.col("aux2").alias("size"), round_.alias("round"))


#: Fixed value: subtrees told apart in one call.
MOST_SUBTREES = 1024


def forest_counts(trace: DataFrame) -> DataFrame:
    """lane, call, grown, cut, subtrees: forest rows since the last recursion inward, and their distinct cut trees up to
    MOST_SUBTREES; a row for each call that has any."""
    inward = is_kind(RECURSE) & (F.col("aux0") == 0)
    rows = running(trace.filter(is_kind(FOREST) | inward), LANE, "idx", {"call": ("sum", F.when(inward, 1).otherwise(0))}).filter(is_kind(FOREST))
    trees = rows.filter("aux0 = 1").groupBy("lane", "call", "aux1").agg(F.count("*").alias("n"))
    cut = trees.groupBy("lane", "call").agg(F.sum("n").alias("cut"), F.least(F.count("*"), F.lit(MOST_SUBTREES)).alias("subtrees"))
    grown = rows.groupBy("lane", "call").agg(F.count_if(F.col("aux0") == 0).alias("grown"))
    return grown.join(cut, ["lane", "call"], "left").select("lane", F.col("call").cast("long").alias("call"), "grown", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), F.coalesce("subtrees", F.lit(0)).cast("long").alias("subtrees"))


def forest_overlay(trace: DataFrame, heads: DataFrame) -> DataFrame:
    """lane, edge, op: the standing of each edge: its last grow or cut, unless a later grow of the same head took its place.

    heads(edge, head). Of a head's grows only the last can stand: an edge grown before it is cleared, even if it was cut
    between, and comes back only by a row of its own behind the clearing.
    """
    rows = trace.filter(is_kind(FOREST)).join(heads, "edge").select("lane", "idx", "edge", "head", F.col("aux0").alias("op"))
    grows = running(rows.filter("op = 0"), ["lane", "head"], "idx", {"old": ("last", F.col("edge"))}, inclusive=False)
    clears = grows.filter("old is not null and old != edge").select("lane", "idx", F.col("old").alias("edge"), F.lit(-1).alias("op"))
    last = rows.select("lane", "idx", "edge", "op").unionByName(clears).groupBy("lane", "edge").agg(F.max_by("op", F.struct("idx", F.col("op") >= 0)).alias("op"))
    return last.filter("op >= 0")


def schematic(trace: DataFrame, slots: int = 64, slab: int = SLAB) -> DataFrame:
    """lane, strip: the last state of a list of `slots` sizes: inserts append (the oldest falls out), prepends go ahead
    (the tail falls out), pulls take from the front as many as they name.

    What a slab of rows does to any list is: drop some from the front, keep some of what was there, and stand a few
    sizes before and behind. Each slab is folded to that alone, in its own task; the few slabs are applied in turn."""
    rows = trace.filter(is_kind(DSTRUCT)).groupBy("lane", F.floor(F.col("idx") / slab).alias("slab")).agg(F.sort_array(F.collect_list(F.struct("idx", "aux0", "aux1"))).alias("ops"))

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.itertuples(index=False):
            # the slots that were there before are -1, -2, ...; a list never holds more than `slots`
            for held in range(slots + 1):
                strip = [-1 - i for i in range(held)]
                for op in r.ops:
                    strip = changed(strip, int(op["aux0"]), int(op["aux1"]), slots)
                out.append((r.lane, r.slab, held, strip))
        return pd.DataFrame(out, columns=["lane", "slab", "held", "strip"])

    def applied(frame: pd.DataFrame) -> pd.DataFrame:
        strip: list[int] = []
        for _, part in frame.sort_values("slab").groupby("slab"):
            strip = [strip[-1 - x] if x < 0 else x for x in part.loc[part["held"] == len(strip), "strip"].iloc[0]]
        return pd.DataFrame({"lane": [frame["lane"].iloc[0]], "strip": [strip]})

    slabs = rows.mapInPandas(lambda frames: (folded(f) for f in frames), "lane int, slab long, held int, strip array<int>")
    return slabs.groupBy("lane").applyInPandas(lambda frame: applied(frame), "lane int, strip array<int>")


def changed(strip: list[int], op: int, n: int, slots: int) -> list[int]:
    """The strip after an operation."""
    if op in (0, 3):
        return [*strip, n][-slots:]
    return [n, *strip][:slots] if op == 1 else strip[n:]


def keyframes(trace: DataFrame, every: int = KEYFRAME_WORK) -> DataFrame:
    """lane, frame, idx, work: the last row of each span of `every` billed operations."""
    rows = work_after(trace).withColumn("frame", F.floor(F.col("work_after") / every))
    return rows.groupBy("lane", "frame").agg(F.max("idx").alias("idx"), F.max("work_after").alias("work"))


def keyframe_for(frames: DataFrame, t: float) -> DataFrame:
    """lane, frame, idx, work: the latest keyframe at or before t."""
    return frames.filter(F.col("work") <= t).groupBy("lane").agg(F.max_by(F.struct("frame", "idx", "work"), "work").alias("k")).select("lane", "k.frame", "k.idx", "k.work")


def snapshots(trace: DataFrame, edges: DataFrame, every: int = KEYFRAME_WORK) -> DataFrame:
    """lane, frame, v, pred, settled: what a keyframe stores for each vertex it has touched; rows of a frame hold the
    changes since the frame before, so that all frames together are no longer than the trace."""
    rows = work_after(trace).withColumn("frame", F.floor(F.col("work_after") / every))
    hits = rows.filter(is_kind(RELAX) & (F.col("aux0") == 1)).join(edges.select(F.col("e").alias("edge"), "src", "dst"), "edge")
    preds = hits.groupBy("lane", "frame", F.col("dst").cast("long").alias("v")).agg(F.max_by("src", "idx").alias("pred"))
    settles = rows.filter(is_kind(SETTLE)).select("lane", "frame", F.col("vertex").cast("long").alias("v"), F.lit(True).alias("settled"))
    return preds.join(settles, ["lane", "frame", "v"], "full").select("lane", "frame", "v", "pred", F.coalesce("settled", F.lit(False)).alias("settled"))


def restored(trace: DataFrame, stored: DataFrame, edges: DataFrame, t: float, every: int = KEYFRAME_WORK) -> DataFrame:
    """lane, v, pred, settled at clock position t: from the snapshots before t's frame and the rows of that frame alone."""
    frame = int(t // every)
    tail = work_after(trace).filter((F.col("work_after") <= t) & (F.floor(F.col("work_after") / every) == frame))
    late = snapshots_of(tail, edges).withColumn("frame", F.lit(frame).cast("long"))
    both = stored.filter(F.col("frame") < frame).unionByName(late)
    return both.groupBy("lane", "v").agg(F.max_by("pred", F.when(F.col("pred").isNotNull(), F.col("frame"))).alias("pred"), F.bool_or("settled").alias("settled"))


def snapshots_of(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """lane, v, pred, settled that these rows alone leave behind."""
    preds = replayed(rows, edges).select("lane", F.col("v").cast("long").alias("v"), "pred")
    settles = rows.filter(is_kind(SETTLE)).select("lane", F.col("vertex").cast("long").alias("v"), F.lit(True).alias("settled"))
    return preds.join(settles, ["lane", "v"], "full").select("lane", "v", "pred", F.coalesce("settled", F.lit(False)).alias("settled"))


def located(trace: DataFrame, position: int) -> DataFrame:
    """lane, chunk, row: where the row at this position stands; none beyond the end."""
    return trace.filter(F.col("idx") == position).select("lane", F.floor(F.col("idx") / SLAB).cast("int").alias("chunk"), (F.col("idx") % SLAB).cast("int").alias("row"))


def stepped(trace: DataFrame, position: int) -> DataFrame:
    """lane, idx, work: the one row that a step from this position applies, and the clock after it."""
    return work_after(trace).filter(F.col("idx") == position).select("lane", "idx", F.col("work_after").alias("work"))


def counters(trace: DataFrame) -> DataFrame:
    """lane, relaxations, heap_ops, dstruct_ops, settled."""
    names = {RELAX: "relaxations", HEAP: "heap_ops", DSTRUCT: "dstruct_ops", SETTLE: "settled"}
    return trace.groupBy("lane").agg(*(F.count_if(is_kind(k)).cast("long").alias(n) for k, n in names.items()))


def race_counters(trace: DataFrame, dist: DataFrame, n: int) -> DataFrame:
    """lane, comparisons, heap_ops, dstruct_ops, relaxations, out_of_order, settled, n. dist(lane, v, dist)."""
    settles = trace.filter(is_kind(SETTLE)).select("lane", "idx", F.col("vertex").cast("long").alias("v")).join(dist, ["lane", "v"]).withColumnRenamed("v", "vertex")
    late = out_of_order(settles).groupBy("lane").agg(F.count("*").alias("out_of_order"))
    work = trace.groupBy("lane").agg(F.sum("cost").cast("long").alias("comparisons"))
    met = counters(trace).join(work, "lane").join(late, "lane", "left")
    return met.select("lane", "comparisons", "heap_ops", "dstruct_ops", "relaxations", F.coalesce("out_of_order", F.lit(0)).cast("long").alias("out_of_order"), "settled", F.lit(n).cast("long").alias("n"))


def bloom_boxes(trace: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """lane, batch, n, and the box around the vertices improved while that batch was open."""
    started, ended = is_kind(BATCH) & (F.col("aux0") == 0), is_kind(BATCH) & (F.col("aux0") == 1)
    rows = trace.filter(is_kind(BATCH) | (is_kind(RELAX) & (F.col("aux0") == 1)))
    rows = running(rows, LANE, "idx", {"batch": ("sum", F.when(started, 1).otherwise(0)), "open": ("last", F.when(started, 1).when(ended, 0))})
    hits = rows.filter(is_kind(RELAX) & (F.col("open") == 1)).join(edges.select(F.col("e").alias("edge"), F.col("dst").alias("v")), "edge").select("lane", "batch", "v").distinct()
    return hits.join(vertices, "v").groupBy("lane", "batch").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
