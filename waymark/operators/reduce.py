"""Degree reduction: a vertex becomes a ring of copies with a few neighbours each, and the ways back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.parameters import degree_bound
from waymark.operators.prefix import running
from waymark.operators.sssp import distances
from waymark.sources.graphs import ordered, prefix_sums
from waymark.staging import dealt, discard, stage


def neighbours(edges: DataFrame) -> DataFrame:
    """(v, u): the distinct vertices u joined to v by an arc either way."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("u")).union(edges.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return neighbours(edges).groupBy("v").agg(F.count("*").alias("neighbours"))


def reduced(edges: DataFrame, delta: int) -> tuple[DataFrame, DataFrame]:
    """(arcs between copies, owners), by delta of at least 3: vertex v has ceil(neighbours / (delta - 2)) copies in a ring of weight 0; its
    kth neighbour's arcs meet copy k div (delta - 2)."""
    if delta < 3:
        raise ValueError("a ring's copies need a neighbour each")
    each = delta - 2
    near = stage(neighbours(edges), "neighbours")
    count = near.groupBy("v").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / each)).alias("copies"))
    base = prefix_sums(count, "v", "copies").withColumnRenamed("before", "first")
    sorted_ = ordered(near, ["v", "u"], "nth")
    starts = sorted_.groupBy("v").agg(F.min("nth").alias("start"))
    slots = sorted_.join(dealt(base.join(dealt(starts), "v")), "v").select("v", "u", (F.col("first") + F.floor((F.col("nth") - F.col("start")) / each)).alias("at"))
    tail, head = dealt(slots.alias("a")), dealt(slots.alias("b"))
    met = edges.join(tail, (F.col("a.v") == F.col("src")) & (F.col("a.u") == F.col("dst"))).join(head, (F.col("b.v") == F.col("dst")) & (F.col("b.u") == F.col("src")))
    owners = base.select("v", "copies", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("copy"), "first")
    ring = owners.filter("copies > 1").select(F.col("copy").alias("src"), (F.col("first") + (F.col("copy") - F.col("first") + 1) % F.col("copies")).alias("dst"), F.lit(0).cast(dict(edges.dtypes)["w"]).alias("w"))
    return met.select(F.col("a.at").alias("src"), F.col("b.at").alias("dst"), "w").unionByName(ring), owners.select("copy", "v")


def reduced_if_dense(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int | None]:
    """(arcs, owners, delta) by the degree that the size asks for; the graph as it is, every vertex its own copy, and
    None where it is sparse enough."""
    delta = degree_bound(n, edges.count())
    if delta is not None:
        return *reduced(edges, delta), delta
    vertices = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    return edges.select("src", "dst", "w"), vertices.select(F.col("v").alias("copy"), "v"), None


def ring_shortcuts(owners: DataFrame) -> DataFrame:
    """(src, dst, n): from every copy to the one n = 2, 4, 8... arcs on along its ring, so that a ring of c copies is crossed in
    log2(c) arcs and not in c."""
    rings = owners.groupBy("v").agg(F.min("copy").alias("first"), F.count("*").alias("copies")).filter("copies > 2")
    spans = rings.select("v", "first", "copies", F.explode(F.expr("filter(transform(sequence(1, 62), k -> shiftleft(1L, k)), n -> n < copies)")).alias("n"))
    return owners.join(spans, "v").select(F.col("copy").alias("src"), (F.col("first") + (F.col("copy") - F.col("first") + F.col("n")) % F.col("copies")).alias("dst"), "n")


def reduced_source(owners: DataFrame, source: int) -> int | None:
    """The lowest copy of the source; None if it has no arc."""
    return owners.filter(F.col("v") == source).agg(F.min("copy")).first()[0]


def mapped_back(dist: DataFrame, owners: DataFrame) -> DataFrame:
    """(v, dist): the least of the copies' distances."""
    return dist.withColumnRenamed("v", "copy").join(dealt(owners), "copy").groupBy("v").agg(F.min("dist").alias("dist"))


def mapped_back_predecessors(labels: DataFrame, owners: DataFrame, most_rounds: int = 64) -> DataFrame:
    """labels(v, label) of copies -> (v, dist, pred): each original's copy of least label, and the owner of the first
    copy up its predecessors that belongs to another vertex (-1 if there is none)."""
    owned = owners.withColumnsRenamed({"copy": "c", "v": "owner"})
    known = stage(labels.select(F.col("v").alias("c"), "label").join(owned, "c"), "copies")
    best = known.groupBy("owner").agg(F.min_by(F.struct("c", "label"), "label").alias("b")).select("owner", F.col("b.label.length").alias("dist"), F.col("b.label.pred").alias("up"))
    done, open_ = None, stage(best, "open")
    upward = known.select(F.col("c").alias("up"), F.col("owner").alias("of"), F.col("label.pred").alias("next"))
    for _ in range(most_rounds):
        met = open_.join(upward, "up", "left")
        left = F.col("of").isNull() | (F.col("of") != F.col("owner"))
        found = met.filter(left).select(F.col("owner").alias("v"), "dist", F.coalesce("of", F.lit(-1)).cast("long").alias("pred"))
        done = stage(found if done is None else done.unionByName(found), "done")
        open_ = stage(met.filter(~left).select("owner", "dist", F.col("next").alias("up")), "open")
        if not open_.head(1):
            return done
    raise ValueError("predecessors stay inside a ring")


def distances_by_reduction(edges: DataFrame, source: int, delta: int) -> DataFrame:
    """Distances through the reduced form. All copies in a ring are at distance 0 from each other, so rounds run over
    rings as wholes: arcs between copies, joined to their rings."""
    arcs, owners = reduced(edges, delta)
    owned = stage(owners, "owners")
    tails, heads = owned.withColumnsRenamed({"copy": "src", "v": "a"}), owned.withColumnsRenamed({"copy": "dst", "v": "b"})
    rings = arcs.join(dealt(tails), "src").join(dealt(heads), "dst").filter("a != b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("w").alias("w"))
    of_ring = distances(rings, source)
    copies = owned.join(dealt(of_ring), "v").select(F.col("copy").alias("v"), "dist")
    return mapped_back(copies, owned)


def unmapped(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Trace rows on copies (vertex = copy) turned to originals: the first of each lane, kind and original stays; rows
    that name no vertex pass."""
    named = rows.filter(F.col("vertex") >= 0)
    met = named.join(owners.withColumnRenamed("copy", "vertex"), "vertex")
    first = met.groupBy("lane", "kind", "orig").agg(F.min("idx").alias("idx"))
    kept = met.join(first, ["lane", "kind", "orig", "idx"])
    rest = rows.filter(F.col("vertex") < 0).withColumn("orig", F.lit(-1).cast(dict(owners.dtypes)["orig"]))
    return kept.unionByName(rest.select(*kept.columns))


def unmapped_arcs(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Trace rows on reduced arcs with the original arc's number: origins(edge, orig_edge), null for a ring's arc, whose
    rows go; rows that name no arc pass."""
    named = rows.filter(F.col("edge") >= 0).join(origins, "edge").filter("orig_edge is not null")
    named = named.withColumn("edge", F.col("orig_edge").cast(dict(rows.dtypes)["edge"])).drop("orig_edge")
    return named.select(*rows.columns).unionByName(rows.filter(F.col("edge") < 0))


def told_anew(rows: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """lane, idx, edge, improved of the relaxations rows(lane, idx, edge) over edges(e, src, dst, w), told by distances on
    these arcs alone: a row's candidate is its weight and the least candidate that came into its tail before it, and it
    improves if no candidate into its head before it was as small.

    The least candidates before a row are a running minimum of a value that itself depends on them; it is taken again until no
    row changes, once for every arc of the longest chain of improvements, over slabs of a lane. Weights must not be negative."""
    hits = stage(rows.join(dealt(edges.select(F.col("e").alias("edge"), "src", "dst", "w")), "edge").select("lane", "idx", "edge", "src", "dst", "w"), "hits")
    kind = dict(hits.dtypes)["w"]

    def before(found: DataFrame) -> DataFrame:
        """found with `tail` and `head`: the least candidates into both before the row."""
        into = found.select("lane", F.col("dst").alias("vertex"), "idx", F.col("made").alias("value"), F.lit("write").alias("what"))
        asked = [found.select("lane", F.col(c).alias("vertex"), "idx", F.lit(None).cast(kind).alias("value"), F.lit(c).alias("what")) for c in ("src", "dst")]
        rows = into.unionByName(asked[0]).unionByName(asked[1]).withColumn("at", 2 * F.col("idx") + (F.col("what") == "write").cast("int"))  # a row asks before it writes
        seen = running(rows, ["lane", "vertex"], "at", {"least": ("min", F.col("value"))}, inclusive=False)
        told = seen.filter("what != 'write'").groupBy("lane", "idx").agg(F.max(F.when(F.col("what") == "src", F.col("least"))).alias("tail"), F.max(F.when(F.col("what") == "dst", F.col("least"))).alias("head"))
        return found.join(dealt(told), ["lane", "idx"])

    found = stage(hits.withColumn("made", F.when(F.col("src") == source, F.col("w"))), "candidates")
    while True:
        again = stage(before(found).withColumn("new", F.when(F.col("src") == source, F.col("w")).otherwise(F.col("tail") + F.col("w"))), "candidates")
        if not again.filter("not (new <=> made)").head(1):
            break
        old, found = found, again.select(*hits.columns, F.col("new").alias("made"))
        discard(old)
    better = F.col("made").isNotNull() & (F.col("dst") != source) & (F.col("head").isNull() | (F.col("made") < F.col("head")))
    return again.select("lane", "idx", "edge", better.alias("improved"))
