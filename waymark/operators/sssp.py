"""Shortest paths as delta iterations over DataFrames.

A round joins only the vertices improved in the round before with their arcs and keeps the least candidate per head (a
partial aggregate before the exchange). Arcs are stored once, as lists of up to CHUNK per tail, in a table bucketed by
tail, so that a round exchanges its candidates and the least values alone: rows of the state carry themselves through the
same exchange as the candidates, which makes a round one stage. HOPS rounds are one statement and one job, whose result is staged in the
shared folder: lineage stays short, and a lost executor costs one job's rounds. The same plan runs at every size.

A tail with more than CHUNK arcs is cut into copies, told apart by `part`, with lists of their own, spread over the
buckets; arcs of weight 0 lead from part 0 to the others. No task holds a hub's arcs.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import regions
from waymark.staging import discard, forget, keep, shared_dir, stage

#: Arcs in one list, about 16 bytes each; a tail with more is cut.
CHUNK = 4096
#: Rounds in the first job, and in each that follows, where a round is short: a job of several rounds takes about JOB_S
#: seconds, or is one round, so that few rounds are run behind the last that changes a value.
HOPS, MORE_HOPS, JOB_S = 8, 16, 5.0
#: With more arcs than this the first jobs have one round each, until it is known how long one takes; a search without a
#: bound goes over the lightest LIGHT of the arcs first.
MANY_ARCS, LIGHT = 5_000_000, 0.1
#: Rounds after which a search is long: what is left of it goes region by region.
LONG = 16
#: Tails that are cut, counted up to this many (16 bytes each), are broadcast to the arcs.
MOST_BROADCAST = 200_000


def bucketed(df: DataFrame, *keys: str) -> tuple[DataFrame, str]:
    """df as a table dealt by the keys into as many buckets as an exchange has partitions, and the table's name."""
    spark, name = df.sparkSession, f"waymark_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def dropped(df: DataFrame, name: str) -> None:
    discard(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def listed(edges: DataFrame) -> DataFrame:
    """tail, part, arcs(v, part, w): the arcs of every tail, in lists of about CHUNK at most."""
    w = dict(edges.dtypes)["w"]
    arcs = edges.select(F.col("src").cast("long").alias("tail"), F.col("dst").cast("long").alias("v"), "w")
    hubs = stage(arcs.groupBy("tail").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK), "hubs")
    hubs = hubs.select("tail", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    n = hubs.count()
    if n:
        arcs = arcs.join(F.broadcast(hubs) if n <= MOST_BROADCAST else hubs, "tail", "left")
        onward = hubs.filter("parts > 1").select("tail", F.lit(0).alias("part"), F.col("tail").alias("v"), F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("to"), F.lit(0).cast(w).alias("w"))
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts").cast("long"))).cast("int")
        arcs = arcs.select("tail", part.alias("part"), "v", F.lit(0).alias("to"), "w").unionByName(onward)
    else:
        arcs = arcs.select("tail", F.lit(0).alias("part"), "v", F.lit(0).alias("to"), "w")
    return arcs.groupBy("tail", "part").agg(F.collect_list(F.struct("v", F.col("to").alias("part"), "w")).alias("arcs"))


def rounds(state: str, lists: str, n: int, bound: str | None = None, within: tuple[int, int] | None = None) -> str:
    """SQL for state(v, part, best, changed) after n rounds: the least of each vertex's own value and the candidates over the
    arcs of vertices that changed; candidates not below the bound are left out. state and lists are names of tables. within:
    the least and largest vertex that changed before, so that the first round reads the lists between these alone.

    All rounds are one statement, so that the plan is analysed once."""
    made = "transform(l.arcs, a -> struct(a.v AS v, a.part AS part, s.best + a.w AS best, false AS own))"
    if bound is not None:
        made = f"filter({made}, c -> c.best < {bound})"
    own = "array(struct(s.v AS v, s.part AS part, s.best AS best, true AS own))"
    one = f"""(SELECT v, part, best, old IS NULL OR best < old AS changed FROM (SELECT v, part, min(best) AS best, min(CASE WHEN own THEN best END) AS old FROM
(SELECT inline(CASE WHEN l.arcs IS NULL THEN {own} ELSE concat({own}, {made}) END) FROM s{{i}} s LEFT JOIN {{lists}} l ON s.v = l.tail AND s.part = l.part AND s.changed) GROUP BY v, part))"""
    near = lists if within is None else f"(SELECT * FROM {lists} WHERE tail BETWEEN {within[0]} AND {within[1]})"
    steps = [f"s0 AS (SELECT v, part, best, changed FROM {state})", *(f"s{i + 1} AS {one.format(i=i, lists=lists if i else near)}" for i in range(n))]
    return f"WITH {', '.join(steps)} SELECT * FROM s{n}"


def fixed_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose plans are settled before they run: rounds are dealt by the buckets, and planning
    anew after every round would take longer than a small round does."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.analyzer.maxIterations", "1000")  # a statement of many rounds is resolved from its first on
    return own


def relaxed(edges: DataFrame, start: DataFrame, bound: float | None = None, long: int = LONG) -> DataFrame:
    """The fixpoint of best(v): rows (v, best) of start, improved by best(src) + w over arcs; of least values below the
    bound, if there is one. Neither weights nor values of start may be negative.

    An arc whose weight is not below the bound makes no candidate below it. Of many arcs without a bound, the lightest are
    relaxed first, if one leaves the start; the values found are lengths of ways, so that an arc not lighter than its head's value improves nothing. The
    others, those to heads not found yet among them, are then relaxed from these values on, to the same fixpoint."""
    if bound is not None:
        return fixpoint(edges.filter(F.col("w") < F.lit(bound)), start, bound, long)
    n, low, high = edges.agg(F.count("*"), F.percentile_approx("w", F.lit(LIGHT)), F.max("w")).first()
    light = edges.filter(F.col("w") <= F.lit(low))
    if n <= MANY_ARCS or low == high or 2 * light.count() > n or not light.join(start.select(F.col("v").alias("src")), "src", "left_semi").head(1):
        return fixpoint(edges, start, long=long)
    found = fixpoint(light, start, long=long)
    heads = found.select(F.col("v").alias("dst"), F.col("best").alias("known"))
    rest = edges.join(heads, "dst", "left").filter(F.col("known").isNull() | (F.col("w") < F.col("known"))).select("src", "dst", "w")
    return fixpoint(stage(rest, "rest"), found, long=long)


def fixpoint(edges: DataFrame, start: DataFrame, bound: float | None = None, long: int = LONG) -> DataFrame:
    """relaxed() over all the arcs at once, region by region behind `long` rounds."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["w"]
    lists, name = bucketed(listed(edges), "tail", "part")
    limit = None if bound is None else f"CAST('{bound}' AS {kind if bound == int(bound) else 'double'})"
    first = start.select(F.col("v").cast("long").alias("v"), F.lit(0).alias("part"), F.col("best").cast(kind).alias("best"), F.lit(True).alias("changed"))
    path, own = keep(first, "state"), fixed_session(spark)
    many = lists.select(F.sum(F.size("arcs"))).first()[0] or 0
    n, taken = 1 if many > MANY_ARCS else HOPS, 0
    while True:
        state = spark.read.parquet(path)
        within = tuple(state.filter("changed").agg(F.min("v"), F.max("v")).first())
        if within[0] is None:
            break
        if taken >= long and kind in regions.KINDS:
            firsts = regions.bounds(lists, many)
            arcs, of_regions = bucketed(regions.flat(lists, firsts), "region")
            state = regions.finished(own, state, of_regions, firsts, bound)
            dropped(arcs, of_regions)
            forget(spark, path)
            break
        begun, before, path = time.monotonic(), path, keep(own.sql(rounds(f"parquet.`{path}`", name, n, limit, within)), "state")
        each = (time.monotonic() - begun) / n
        forget(spark, before)
        taken += n
        n = max(1, min(MORE_HOPS, int(JOB_S / max(each, 1e-3))))
    dropped(lists, name)
    return state.filter("part = 0").select("v", "best")


def from_one(edges: DataFrame, source: int) -> DataFrame:
    """(v, best): the source at 0."""
    return edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("v"), F.lit(0).cast(dict(edges.dtypes)["w"]).alias("best"))


def distances(edges: DataFrame, source: int, bound: float | None = None) -> DataFrame:
    """(v, dist) of every vertex reached; with a bound, only over candidates below it."""
    return relaxed(edges, from_one(edges, source), bound).withColumnRenamed("best", "dist")


def label(length: Column, n_edges: Column, curr: Column, pred: Column) -> Column:
    return F.struct(length.alias("length"), n_edges.cast("long").alias("n_edges"), curr.cast("long").alias("curr"), pred.cast("long").alias("pred"))


def labels(edges: DataFrame, source: int, shortcuts: DataFrame | None = None) -> DataFrame:
    """(v, label) by the order of (length, number of arcs, vertex, predecessor); -1 stands for no predecessor.

    shortcuts(src, dst, n) stand for n arcs of weight 0 in a row, which edges holds too: they change no label and are no one's
    predecessor's arc, but spare the rounds of walking these arcs one by one.

    Lengths and numbers of arcs are one fixpoint over whole numbers, length times more than there are arcs plus the arcs,
    where such numbers fit; otherwise least lengths come first, and over the arcs that are tight by them the least numbers of
    arcs. Over the arcs that are tight by both, the least tail is the predecessor."""
    if dict(edges.dtypes)["w"] in ("bigint", "int", "smallint", "tinyint"):
        n, most = edges.agg(F.count("*"), F.max("w")).first()
        scale = n + 1
        if n and (most * scale + 1) * scale < 2**62:
            arcs = edges.select("src", "dst", (F.col("w").cast("long") * scale + 1).alias("w"))
            walked = arcs if shortcuts is None else arcs.unionByName(shortcuts.select("src", "dst", F.col("n").cast("long").alias("w")))
            both = stage(relaxed(walked, from_one(arcs, source), long=LONG if shortcuts is None else 0).withColumnRenamed("best", "dist"), "both")
            preds = tight(arcs, both).groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("pred"))
            length, count = F.expr(f"dist div {scale}").cast(dict(edges.dtypes)["w"]), F.col("dist") % scale
            return both.join(preds, "v", "left").select("v", label(length, count, F.col("v"), F.coalesce("pred", F.lit(-1))).alias("label"))
    flat = None if shortcuts is None else shortcuts.select("src", "dst", F.lit(0).cast(dict(edges.dtypes)["w"]).alias("w"), F.col("n").cast("long").alias("n"))
    dist = stage(distances(edges if flat is None else edges.select("src", "dst", "w").unionByName(flat.drop("n")), source), "dist")
    arcs = stage(tight(edges, dist).select("src", "dst", F.lit(1).cast("long").alias("w")), "arcs")
    walked = arcs if flat is None else arcs.unionByName(flat.join(dist.select(F.col("v").alias("src")), "src", "left_semi").select("src", "dst", F.col("n").alias("w")))
    hops = stage(relaxed(walked, from_one(arcs, source), long=LONG if shortcuts is None else 0), "hops")
    count = hops.withColumnRenamed("best", "n_edges")
    tails, heads = count.withColumnsRenamed({"v": "src", "n_edges": "before"}), count.withColumnsRenamed({"v": "dst"})
    preds = arcs.join(tails, "src").join(heads, "dst").filter("before + 1 = n_edges").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("pred"))
    met = dist.join(count, "v").join(preds, "v", "left")
    return met.select("v", label(F.col("dist"), F.col("n_edges"), F.col("v"), F.coalesce("pred", F.lit(-1))).alias("label"))


def reachable(edges: DataFrame, source: int) -> DataFrame:
    """(v, hops) of every vertex reached: its least number of arcs."""
    steps = edges.select("src", "dst", F.lit(1).cast("long").alias("w"))
    return relaxed(steps, from_one(steps, source)).withColumnRenamed("best", "hops")


def tight(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """src, dst, w, du, dv of the arcs between vertices of dist(v, dist) with dist(src) + w = dist(dst)."""
    tails = dist.select(F.col("v").alias("src"), F.col("dist").alias("du"))
    heads = dist.select(F.col("v").alias("dst"), F.col("dist").alias("dv"))
    near = edges.select("src", "dst", "w").join(heads, "dst").filter(F.col("w") <= F.col("dv"))  # heavier ones are not tight
    return near.join(tails, "src").filter(F.col("du") + F.col("w") == F.col("dv")).select("src", "dst", "w", "du", "dv")


def tight_predecessors(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(v, pred): the least u with dist(u) + w = dist(v); across weight 0, u is before v in (dist, id)."""
    met = tight(edges, dist).filter((F.col("du") < F.col("dv")) | (F.col("src") < F.col("dst")))
    return met.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("pred"))


def finish(reached: DataFrame, vertices: DataFrame, source: int) -> DataFrame:
    """One row: the vertex reached that lies farthest from the source, ties to the least; no row if none."""
    at = vertices.filter(F.col("v") == source).select(F.col("x").alias("x0"), F.col("y").alias("y0"))
    far = (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0"))
    others = vertices.join(reached.select("v"), "v").filter(F.col("v") != source).join(F.broadcast(at), F.lit(True))  # at is one row
    return others.agg(F.max_by(F.struct("v", far.alias("d2")), F.struct(far, -F.col("v"))).alias("f")).select("f.v", "f.d2").filter("v is not null")


def path_tree(preds: DataFrame, source: int, target: int) -> DataFrame:
    """(step, v) from source to target by predecessors, counted from the target; no rows if they don't meet.

    Doubling: after k rounds every vertex knows its ancestor 2^k steps up, and the part of the path found so far
    doubles with each; a path of a million steps takes twenty rounds, and only the path's own rows are kept."""
    up = stage(preds.filter("pred >= 0").select("v", F.col("pred").alias("a")), "up")
    path = preds.sparkSession.createDataFrame([(0, target)], "step long, v long")
    size = 1
    while not path.filter(F.col("v") == source).head(1):
        ahead = path.join(up, "v").select((F.col("step") + size).alias("step"), F.col("a").alias("v"))
        found = stage(path.unionByName(ahead), "path")
        if found.count() < 2 * path.count() and not found.filter(F.col("v") == source).head(1):
            return found.limit(0)
        if found.groupBy("v").count().filter("count > 1").head(1):
            raise ValueError("predecessors run in a circle")
        path, size = found, 2 * size
        up = stage(up.alias("x").join(up.alias("y"), F.col("x.a") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.a").alias("a")), "up")
    end = path.filter(F.col("v") == source).agg(F.min("step")).first()[0]
    return path.filter(F.col("step") <= end).select((F.lit(end) - F.col("step")).alias("step"), "v")


def gold_path(preds: DataFrame, source: int, target: int) -> list[int]:
    """Vertices from source to target by predecessors; empty if they don't meet."""
    return [r["v"] for r in path_tree(preds, source, target).orderBy("step").collect()]


def path_table(edges: DataFrame, source: int, target: int) -> DataFrame:
    """(step, v, dist) along the least-label path."""
    found = stage(labels(edges, source), "labels")
    steps = path_tree(found.select("v", F.col("label.pred").alias("pred")), source, target)
    return steps.join(found.select("v", F.col("label.length").alias("dist")), "v").select("step", "v", "dist")
