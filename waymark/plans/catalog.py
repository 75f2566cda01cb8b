"""The library's queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it.

The stand-in trace is made of the events table: its rows exercise every trace operator, but are no run of an algorithm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import parameters, prng
from waymark.operators import lists, race, reduce, sssp, trace
from waymark.schema import KINDS
from waymark.session import table
from waymark.sources import generators, graphs
from waymark.sources.generators import KINDS as KINDS_OF_GRAPHS
from waymark.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ stand-ins

FV = "CAST(floor(value) AS BIGINT)"
KIND = f"((event_id + {FV}) % 8)"
TRACE_SQL = {
    "run_id": "'events'", "lane": "CAST(user_id % 3 AS INT)", "idx": "event_id", "chunk": "0", "row": "CAST(event_id AS INT)", "kind": f"CAST({KIND} AS INT)",
    "vertex": f"CAST(CASE {KIND} WHEN 1 THEN event_id WHEN 3 THEN event_id % 97 ELSE -1 END AS INT)", "edge": f"CAST(CASE WHEN {KIND} IN (0, 6) THEN event_id % 389 ELSE -1 END AS INT)",
    "aux0": f"CAST(CASE {KIND} WHEN 0 THEN {FV} % 2 WHEN 1 THEN event_id WHEN 2 THEN {FV} % 3 WHEN 7 THEN {FV} % 4 ELSE {FV} % 2 END AS INT)",
    "aux1": f"CAST(CASE WHEN {KIND} IN (2, 4, 5, 6, 7) THEN {FV} % 17 ELSE -1 END AS INT)", "aux2": f"CAST(CASE WHEN {KIND} IN (4, 7) THEN {FV} % 13 ELSE -1 END AS INT)",
    "aux_f": f"CAST(CASE WHEN {KIND} = 5 THEN value ELSE 0 END AS DOUBLE)", "cost": f"CAST(CASE {KIND} WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN {FV} % 17 WHEN 7 THEN {FV} % 13 ELSE 0 END AS BIGINT)",
}
EVENT_TRACE = "tr AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in TRACE_SQL.items()) + " FROM events)"
WORK = "wk AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS work_after FROM tr)"
ARCS = "arcs AS (SELECT CAST(i AS INT) AS edge, i % 97 AS src, (i * 31 + 7) % 97 AS dst FROM range(389) AS r(i))"
PLACES = "CAST(v * 7919 % 1000 AS DOUBLE) / 1000 AS x, CAST(v * 104729 % 1000 AS DOUBLE) / 1000 AS y"
T_MARK = 5000


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {c}" for c, e in TRACE_SQL.items()))


def stand_in_arcs(spark: SparkSession) -> DataFrame:
    return spark.range(389).select(F.col("id").cast("int").alias("e"), (F.col("id") % 97).alias("src"), ((F.col("id") * 31 + 7) % 97).alias("dst"))


def placed(vertices: DataFrame) -> DataFrame:
    return vertices.selectExpr("v", *PLACES.split(", "))


def first_vertex(edges: DataFrame) -> int:
    return edges.agg(F.min("src")).first()[0]


def with_tr(body: str) -> str:
    return f"WITH {EVENT_TRACE}, {WORK} {body}"


# ------------------------------------------------------------------ shortest paths

SSSP = "r(v, d) USING KEY (v) AS (SELECT (SELECT min(src) FROM ed), CAST(0 AS BIGINT) UNION SELECT ed.dst, min(r.d + ed.w) FROM r JOIN ed ON ed.src = r.v LEFT JOIN recurring.r k ON k.v = ed.dst WHERE {admit}(k.d IS NULL OR r.d + ed.w < k.d) GROUP BY ed.dst)"
FULL = SSSP.format(admit="")
LABELS = """l(v, lab) USING KEY (v) AS (SELECT (SELECT min(src) FROM ed), {'length': CAST(0 AS BIGINT), 'n_edges': CAST(0 AS BIGINT), 'curr': (SELECT min(src) FROM ed), 'pred': CAST(-1 AS BIGINT)} UNION
SELECT dst, min(c) FROM (SELECT ed.dst, {'length': l.lab.length + ed.w, 'n_edges': l.lab.n_edges + 1, 'curr': ed.dst, 'pred': ed.src} AS c, k.lab AS old FROM l JOIN ed ON ed.src = l.v LEFT JOIN recurring.l k ON k.v = ed.dst) WHERE old IS NULL OR c < old GROUP BY dst)"""


@query(f"WITH RECURSIVE {graphs.PURCHASES_SQL}, {FULL} SELECT v, d AS dist FROM r")
def sssp_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    return sssp.distances(edges, first_vertex(edges))


@query(f"WITH RECURSIVE {graphs.PURCHASES_SQL}, {SSSP.format(admit='r.d + ed.w < 4 AND ')} SELECT v, d AS dist FROM r")
def sssp_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    return sssp.distances(edges, first_vertex(edges), 4)


@query(f"WITH RECURSIVE {graphs.PURCHASES_SQL}, {LABELS} SELECT v, lab.length AS length, lab.n_edges AS n_edges, lab.pred AS pred FROM l")
def sssp_labels4(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    return sssp.labels(edges, first_vertex(edges)).select("v", "label.length", "label.n_edges", "label.pred")


@query(f"WITH RECURSIVE {graphs.PURCHASES_SQL}, {FULL} SELECT ed.dst AS v, min(ed.src) AS pred FROM ed JOIN r a ON a.v = ed.src JOIN r b ON b.v = ed.dst WHERE a.d + ed.w = b.d AND (a.d < b.d OR ed.src < ed.dst) GROUP BY ed.dst")
def sssp_pred_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    return sssp.tight_predecessors(edges, sssp.distances(edges, first_vertex(edges)))


@query(f"WITH RECURSIVE ed0 AS (SELECT * FROM (WITH {graphs.SUCCESSIONS_SQL} SELECT * FROM ed)), ed AS (SELECT src, dst, CAST(1 AS BIGINT) AS w FROM ed0), {FULL} SELECT v, d AS hops FROM r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.successions(spark, sf_dir), "arcs")
    return sssp.reachable(edges, first_vertex(edges))


@query(f"""WITH RECURSIVE {graphs.PURCHASES_SQL}, {FULL}, p AS (SELECT v, {PLACES} FROM r), q AS (SELECT p.v, (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) AS d2 FROM p, (SELECT * FROM p ORDER BY v LIMIT 1) o WHERE p.v <> o.v)
SELECT v, d2 FROM q ORDER BY d2 DESC, v LIMIT 1""")
def finish_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    source = first_vertex(edges)
    reached = sssp.reachable(edges, source)
    return sssp.finish(reached, placed(reached.select("v")), source)


@query(f"""WITH RECURSIVE {graphs.PURCHASES_SQL}, {LABELS}, walk(v, up) AS (SELECT max(v), CAST(0 AS BIGINT) FROM l UNION ALL SELECT l.lab.pred, walk.up + 1 FROM walk JOIN l ON l.v = walk.v WHERE l.lab.pred >= 0)
SELECT (SELECT max(up) FROM walk) - up AS step, walk.v AS v, l.lab.length AS dist FROM walk JOIN l ON l.v = walk.v""")
def gold_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    return sssp.path_table(edges, first_vertex(edges), edges.agg(F.max("src")).first()[0])


# ------------------------------------------------------------------ graphs


@query(f"WITH {graphs.PURCHASES_SQL} SELECT src AS v, CAST(sum(count(*)) OVER (ORDER BY src) - count(*) AS BIGINT) AS first, count(*) AS degree FROM ed GROUP BY src")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.purchases(spark, sf_dir)
    return graphs.offsets(edges.select(F.col("src").alias("v")).distinct(), edges)


@query(f"WITH {graphs.PURCHASES_SQL} SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS e, src, dst, w FROM ed")
def csr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.packed(graphs.purchases(spark, sf_dir))


@query("""WITH raw AS (SELECT o_custkey % 50 AS src, o_orderkey % 60 AS dst, CASE WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE o_totalprice END AS w FROM orders)
SELECT count(*) AS arcs, count(*) FILTER (src = dst) AS loops, count(*) FILTER (w < 0) AS bad_weights, (SELECT count(*) FROM (SELECT src AS v FROM raw UNION ALL SELECT dst FROM raw) WHERE v >= 50) AS loose_ends,
(SELECT count(*) FROM (SELECT src, dst FROM raw GROUP BY src, dst HAVING count(*) > 1)) AS doubled, 0 AS unplaced FROM raw""")
def csr_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_violations(spark, table(spark, sf_dir, "orders"))


def order_violations(spark: SparkSession, orders: DataFrame) -> DataFrame:
    raw = orders.select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 60).alias("dst"), F.when(F.col("o_orderkey") % 11 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("w"))
    return graphs.violations(spark.range(50).select(F.col("id").alias("v")), raw)


NEIGHBOURS = "nb AS (SELECT DISTINCT src AS v, dst AS u FROM ed UNION SELECT dst, src FROM ed)"


@query(f"WITH {graphs.SUCCESSIONS_SQL}, {NEIGHBOURS} SELECT v, count(*) AS neighbours FROM nb GROUP BY v")
def degree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.degrees(graphs.successions(spark, sf_dir))


COPIES = f"""{graphs.SUCCESSIONS_SQL}, {NEIGHBOURS}, deg AS (SELECT v, greatest(1, (count(*) + 5) // 6) AS copies FROM nb GROUP BY v), base AS (SELECT v, copies, CAST(sum(copies) OVER (ORDER BY v) - copies AS BIGINT) AS first FROM deg),
slot AS (SELECT v, u, first + (row_number() OVER (PARTITION BY v ORDER BY u) - 1) // 6 AS at FROM nb JOIN base USING (v))"""


@query(f"""WITH {COPIES} SELECT a.at AS src, b.at AS dst, ed.w AS w FROM ed JOIN slot a ON a.v = ed.src AND a.u = ed.dst JOIN slot b ON b.v = ed.dst AND b.u = ed.src
UNION ALL SELECT first + k, first + (k + 1) % copies, 0 FROM base, range(0, 10000) AS q(k) WHERE k < copies AND copies > 1""")
def degree_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduced(graphs.successions(spark, sf_dir), 8)[0]


@query(f"WITH {COPIES} SELECT first + k AS copy, v FROM base, range(0, 10000) AS q(k) WHERE k < copies")
def degree_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduced(graphs.successions(spark, sf_dir), 8)[1]


@query(f"WITH RECURSIVE {graphs.SUCCESSIONS_SQL}, {FULL} SELECT v, d AS dist FROM r")
def mapback_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.successions(spark, sf_dir), "arcs")
    return reduce.distances_by_reduction(edges, first_vertex(edges), 8)


@query(with_tr("SELECT lane, orig, idx FROM (SELECT lane, idx, vertex // 3 AS orig, row_number() OVER (PARTITION BY lane, kind, vertex // 3 ORDER BY idx) AS n FROM tr WHERE kind = 1) WHERE n = 1"))
def unmap_first_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("copy"), F.expr("CAST(event_id AS INT) div 3").cast("int").alias("orig"))
    found = reduce.unmapped(event_trace(spark, sf_dir).filter("kind = 1"), owners)
    return found.select("lane", "orig", "idx")


# ------------------------------------------------------------------ partial sorting


PAIRS = "pr AS (SELECT user_id AS key, CAST(floor(value * 100) AS BIGINT) AS value, event_id FROM events)"


def value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.floor(F.col("value") * 100).cast("long").alias("value"), "event_id")


@query(f"WITH {PAIRS}, best AS (SELECT key, min(value) AS value FROM pr GROUP BY key) SELECT key, value, (SELECT min(value) FROM (SELECT value FROM best ORDER BY value, key OFFSET 16)) AS bound FROM best ORDER BY value, key LIMIT 16")
def pull_m_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.pull(lists.insert(value_pairs(spark, sf_dir)), 16)


@query(f"WITH {PAIRS} SELECT key, min(value) AS value FROM pr GROUP BY key")
def merge_keep_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = value_pairs(spark, sf_dir)
    return lists.merge(lists.insert(pairs.filter("event_id % 2 = 0")), lists.insert(pairs.filter("event_id % 2 = 1")))


@query(f"WITH {PAIRS}, old AS (SELECT key, min(value) AS value FROM pr GROUP BY key), new AS (SELECT key, min(value) - 100000 AS value FROM pr WHERE event_id % 3 = 0 GROUP BY key) SELECT key, coalesce(new.value, old.value) AS value FROM old FULL JOIN new USING (key)")
def batch_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = value_pairs(spark, sf_dir)
    ahead = pairs.filter("event_id % 3 = 0").select("key", (F.col("value") - 100000).alias("value"))
    return lists.prepend(lists.insert(pairs), ahead)


@query(f"WITH {PAIRS} SELECT key % 10 AS grp, arg_min(key, (value, key)) AS pivot FROM pr GROUP BY ALL")
def group_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.pivots(value_pairs(spark, sf_dir).select((F.col("key") % 10).alias("grp"), "key", "value"))


@query(f"WITH {PAIRS} SELECT band, count(*) AS n FROM (SELECT CASE WHEN value >= 10000 AND value < 30000 THEN 'insert' WHEN value >= 5000 AND value < 10000 THEN 'prepend' WHEN value < 30000 THEN 'rescue' ELSE 'beyond' END AS band FROM pr) GROUP BY band")
def band_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_pairs(spark, sf_dir).select(lists.band(F.col("value"), 5000, 10000, 30000).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {graphs.PURCHASES_SQL}, {FULL}
SELECT ed.dst AS v, min(ed.src) AS parent FROM ed JOIN r a ON a.v = ed.src JOIN r b ON b.v = ed.dst WHERE a.d + ed.w = b.d AND (a.d < b.d OR ed.src < ed.dst) GROUP BY ed.dst""")
def tight_forest_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    reached = sssp.distances(edges, first_vertex(edges))
    return sssp.tight_predecessors(edges, reached).withColumnRenamed("pred", "parent")


@query(f"WITH {PAIRS}, best AS (SELECT key, min(value) AS value FROM pr GROUP BY key), cut AS (SELECT value AS b FROM best ORDER BY value, key LIMIT 1 OFFSET 16) SELECT max(key) + 1 AS separator FROM best, cut WHERE value = b")
def pull_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lists.insert(value_pairs(spark, sf_dir))
    return lists.separator(best, lists.pull(best, 16).agg(F.max("bound").alias("bound")))


# ------------------------------------------------------------------ traces


@query(with_tr("SELECT lane, CAST(sum(cost) AS BIGINT) AS work, " + ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(KINDS)) + " FROM tr GROUP BY lane"))
def trace_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.tally(event_trace(spark, sf_dir))


@query(with_tr("SELECT kind, count(*) AS n, CAST(sum(cost) AS BIGINT) AS cost FROM tr GROUP BY kind"))
def trace_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir).withColumn("cost", trace.cost(F.col("kind"), F.col("aux1"), F.col("aux2")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query(with_tr("SELECT idx, lane, kind, vertex, edge, aux0, aux1, aux2, aux_f, cost FROM tr"))
def trace_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.encode(trace.decode(event_trace(spark, sf_dir))).select("idx", "lane", "kind", "vertex", "edge", "aux0", "aux1", "aux2", "aux_f", "cost")


@query(with_tr("SELECT lane, idx, work_after FROM wk"))
def work_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.work_after(event_trace(spark, sf_dir)).select("lane", "idx", "work_after")


@query(with_tr(f"SELECT lane, count(*) FILTER (work_after <= {T_MARK}) AS position FROM wk GROUP BY lane"))
def seek_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.seek(event_trace(spark, sf_dir), T_MARK)


@query(with_tr(f"SELECT lane, min(work_after) FILTER (work_after > {T_MARK}) AS next_work FROM wk GROUP BY lane"))
def next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.next_boundary(event_trace(spark, sf_dir), T_MARK)


@query(with_tr("SELECT lane, vertex, aux0 AS nth, work_after AS settle_work FROM wk WHERE kind = 1"))
def settle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.settle_records(event_trace(spark, sf_dir))


@query("SELECT * FROM (SELECT CAST(user_id % 3 AS INT) AS lane, event_id AS idx, event_id AS vertex, value AS dist, max(value) OVER (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE dist < before")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    settles = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("lane"), F.col("event_id").alias("idx"), F.col("event_id").alias("vertex"), F.col("value").alias("dist"))
    return trace.out_of_order(settles)


@query(with_tr("SELECT lane, idx, CAST(sum(CASE WHEN aux0 = 0 THEN 1 ELSE -1 END) OVER w AS BIGINT) AS depth, last_value(CASE WHEN aux0 = 0 THEN aux_f END IGNORE NULLS) OVER w AS bound FROM tr WHERE kind = 5 WINDOW w AS (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING)"))
def recursion_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.recursion(event_trace(spark, sf_dir), strict=False)


@query(with_tr(""", g AS (SELECT *, kind = 4 AND aux0 = 0 AS s, sum(CASE WHEN kind = 7 OR (kind = 5 AND aux0 = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS grp FROM tr)
SELECT lane, idx, row_number() OVER (PARTITION BY lane, grp ORDER BY idx) AS round FROM g WHERE s"""))
def batch_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.batch_rounds(event_trace(spark, sf_dir))


@query(with_tr(""", g AS (SELECT *, sum(CASE WHEN kind = 5 AND aux0 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS grp FROM tr)
SELECT lane, idx, row_number() OVER (PARTITION BY lane, grp ORDER BY idx) AS since FROM g WHERE kind = 3"""))
def pivots_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.pivots_since(event_trace(spark, sf_dir))


@query(with_tr(""", p AS (SELECT lane, idx, sum(CASE WHEN aux0 IN (0, 3) THEN aux1 WHEN aux0 = 2 THEN -aux1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS p FROM tr WHERE kind = 7)
SELECT lane, idx, CAST(p - least(0, min(p) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS size FROM p"""))
def region_size_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.region_sizes(event_trace(spark, sf_dir))


@query(f"""WITH {EVENT_TRACE}, {ARCS}, f AS (SELECT lane, idx, edge, dst AS head, aux0 AS op FROM tr JOIN arcs USING (edge) WHERE kind = 6), g AS (SELECT *, lag(edge) OVER (PARTITION BY lane, head ORDER BY idx) AS old FROM f WHERE op = 0),
o AS (SELECT lane, idx, edge, op FROM f UNION ALL SELECT lane, idx, old, -1 FROM g WHERE old <> edge) SELECT lane, edge, op FROM (SELECT *, row_number() OVER (PARTITION BY lane, edge ORDER BY idx DESC, op DESC) AS n FROM o) WHERE n = 1 AND op >= 0""")
def forest_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = stand_in_arcs(spark).select(F.col("e").alias("edge"), F.col("dst").alias("head"))
    return trace.forest_overlay(event_trace(spark, sf_dir), heads)


@query(f"WITH {EVENT_TRACE}, {ARCS} SELECT DISTINCT lane, dst AS v FROM tr JOIN arcs USING (edge) WHERE kind = 0 AND aux0 = 1 AND NOT EXISTS (SELECT 1 FROM tr s WHERE s.lane = tr.lane AND s.kind = 1 AND s.vertex = dst)")
def frontier_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.frontier(event_trace(spark, sf_dir), stand_in_arcs(spark))


@query(f"WITH {EVENT_TRACE}, {ARCS} SELECT lane, dst AS v, arg_max(src, idx) AS pred FROM tr JOIN arcs USING (edge) WHERE kind = 0 AND aux0 = 1 GROUP BY ALL")
def replay_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.replayed(event_trace(spark, sf_dir), stand_in_arcs(spark))


@query(with_tr("SELECT lane, edge, max(work_after) AS work FROM wk WHERE kind = 0 AND aux0 = 1 GROUP BY ALL"))
def last_relax_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.last_relax_work(event_trace(spark, sf_dir))


@query(with_tr("SELECT lane, vertex, max(work_after) AS work FROM wk WHERE kind = 3 GROUP BY ALL"))
def pivot_flares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.pivot_flares(event_trace(spark, sf_dir))


@query(with_tr(f", k AS (SELECT lane, work_after // 1000 AS frame, max(idx) AS idx, max(work_after) AS work FROM wk GROUP BY ALL) SELECT lane, arg_max(frame, work) AS frame, arg_max(idx, work) AS idx, max(work) AS work FROM k WHERE work <= {T_MARK} GROUP BY lane"))
def keyframe_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.keyframe_for(trace.keyframes(event_trace(spark, sf_dir), 1000), T_MARK)


@query(with_tr("SELECT lane, count(*) FILTER (kind = 0) AS relaxations, count(*) FILTER (kind = 2) AS heap_ops, count(*) FILTER (kind = 7) AS dstruct_ops, count(*) FILTER (kind = 1) AS settled FROM tr GROUP BY lane"))
def lane_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.counters(event_trace(spark, sf_dir))


@query(f"""WITH {EVENT_TRACE}, {ARCS}, b AS (SELECT *, sum(CASE WHEN kind = 4 AND aux0 = 0 THEN 1 ELSE 0 END) OVER w AS batch, last_value(CASE WHEN kind = 4 THEN 1 - aux0 END IGNORE NULLS) OVER w AS open FROM tr WINDOW w AS (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING)),
h AS (SELECT DISTINCT lane, batch, dst AS v FROM b JOIN arcs USING (edge) WHERE kind = 0 AND aux0 = 1 AND open = 1), p AS (SELECT v, {PLACES} FROM (SELECT CAST(i AS BIGINT) AS v FROM range(97) AS r(i)))
SELECT lane, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM h JOIN p USING (v) GROUP BY ALL""")
def bloom_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.bloom_boxes(event_trace(spark, sf_dir), stand_in_arcs(spark), placed(spark.range(97).select(F.col("id").alias("v"))))


@query(with_tr("""SELECT lane, array_to_string(list_reduce(list([aux0, aux1] ORDER BY idx), lambda s, x: CASE WHEN x[1] IN (0, 3) THEN list_append(s, x[2])[-64:] WHEN x[1] = 1 THEN list_prepend(x[2], s)[:64] ELSE s[x[2] + 1:] END, CAST([] AS INTEGER[])), ',') AS strip
FROM tr WHERE kind = 7 GROUP BY lane"""))
def schematic_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.schematic(event_trace(spark, sf_dir)).select("lane", F.array_join(F.col("strip").cast("array<string>"), ",").alias("strip"))


# ------------------------------------------------------------------ races

LANES = "ln AS (SELECT lane, 'lane ' || lane AS label, CAST(sum(cost) AS BIGINT) AS work, count(*) FILTER (kind = 1) AS settled, count(*) FILTER (kind = 0) AS relaxations, count(*) FILTER (kind = 2) AS heap_ops, lane = 2 AS complete FROM tr GROUP BY lane)"


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace.tally(event_trace(spark, sf_dir))
    return t.select("lane", F.concat(F.lit("lane "), F.col("lane")).alias("label"), "work", F.col("n_settle").alias("settled"), F.col("n_relax").alias("relaxations"), F.col("n_heap").alias("heap_ops"), (F.col("lane") == 2).alias("complete"))


@query(with_tr(f", {LANES} SELECT min(work) FILTER (NOT complete) AS cap FROM ln"))
def stream_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.stream_cap(lanes(spark, sf_dir).withColumnRenamed("work", "total"))


@query(with_tr(", s AS (SELECT lane, max(work_after) AS total, min(work_after) FILTER (kind = 1 AND vertex % 100 >= 90) AS settle_work FROM wk GROUP BY lane) SELECT lane, least(4000, total, settle_work) AS target FROM s"))
def photo_finish_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace.work_after(event_trace(spark, sf_dir))
    ends = rows.groupBy("lane").agg(F.max("work_after").alias("total"), F.min(F.when((F.col("kind") == 1) & (F.col("vertex") % 100 >= 90), F.col("work_after"))).alias("settle_work"))
    return race.photo_cap(ends, 4000)


@query(with_tr(f", {LANES} SELECT lane, CAST(row_number() OVER (ORDER BY work, lane) AS INT) AS place FROM ln"))
def lane_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.ranked(lanes(spark, sf_dir))


@query(with_tr(f", {LANES} SELECT lane, " + ", ".join(f"{c} = min({c}) OVER () AND count(*) OVER () > 1 AS best_{c}" for c in ("work", "relaxations", "heap_ops")) + " FROM ln"))
def best_in_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.best_in_class(lanes(spark, sf_dir), ("work", "relaxations", "heap_ops"))


@query(with_tr(f", {LANES}, t AS (SELECT lane, settled, lead(settled) OVER (ORDER BY settled DESC, lane) AS next, row_number() OVER (ORDER BY settled DESC, lane) AS n FROM ln) SELECT lane AS leader, settled - next AS margin FROM t WHERE n = 1 AND settled > next"))
def settle_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.settle_lead(lanes(spark, sf_dir))


@query("WITH s AS (SELECT DISTINCT user_id AS v, event_type FROM events) SELECT v, CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) AS BIGINT) AS side FROM s GROUP BY v")
def settle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("v"), "event_type").distinct()
    return race.settle_diff(events.filter("event_type = 'click'"), events.filter("event_type = 'error'"), events.select("v").distinct())


COUNTS = ", ".join(f"count(*) FILTER (kind = {i}) AS n{i}" for i in range(8))
BOUND = "CASE WHEN n0 % 7 = 0 THEN '\u221e' ELSE CAST(n0 AS VARCHAR) END"


@query(with_tr(f"""SELECT lane, CASE WHEN n5 % 3 > 0 AND (n4 % 2 = 1 OR n4 % 5 > 0) THEN 'FindPivots round ' || n4 % 5 || CASE WHEN n1 % 2 = 1 THEN '/' || 4 ELSE '' END || ': ' || n6 || ' vertices relaxed, ' || n3 || ' pivots found'
WHEN n5 % 3 > 0 AND n7 % 3 > 0 THEN 'BMSSP level ' || n5 % 3 || ': bound ' || {BOUND} || ', pulled ' || n7 % 3 WHEN n5 % 3 > 0 THEN 'BMSSP level ' || n5 % 3 || ': bound ' || {BOUND} ELSE 'BMSSP idle' END AS text FROM (SELECT lane, {COUNTS} FROM tr GROUP BY lane, idx // 500)"""))
def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stretches(spark, sf_dir)
    bound = F.when(F.col("n0") % 7 == 0, float("inf")).otherwise(F.col("n0").cast("double"))
    state = c.select("lane", (F.col("n5") % 3).alias("depth"), (F.col("n4") % 2 == 1).alias("batch_open"), (F.col("n4") % 5).alias("round"), F.when(F.col("n1") % 2 == 1, 4).otherwise(0).alias("rounds"), F.col("n6").alias("size"), F.col("n3").alias("pivots"), bound.alias("bound"), (F.col("n7") % 3).alias("pulled"))
    return race.narration(state)


@query(with_tr(f"""SELECT lane, CASE WHEN n6 % 3 + n4 % 2 + n7 % 2 > 0 THEN 'Forest ' || n6 % 3 || ' edges, ' || n7 % 2 || ' subtrees cut, ' || n3 || ' pivots, D occupancy ' || n2
WHEN n5 % 3 > 0 THEN 'DMSY level ' || n5 % 3 || ': bound ' || {BOUND} ELSE 'DMSY idle' END AS text FROM (SELECT lane, {COUNTS} FROM tr GROUP BY lane, idx // 500)"""))
def forest_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stretches(spark, sf_dir)
    bound = F.when(F.col("n0") % 7 == 0, float("inf")).otherwise(F.col("n0").cast("double"))
    return race.forest_narration(c.select("lane", (F.col("n5") % 3).alias("depth"), (F.col("n6") % 3).alias("grown"), (F.col("n4") % 2).alias("cut"), (F.col("n7") % 2).alias("subtrees"), F.col("n3").alias("pivots"), bound.alias("bound"), F.col("n2").alias("region")))


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of kinds in stretches of the stand-in trace, as states to narrate."""
    return event_trace(spark, sf_dir).groupBy("lane", F.floor(F.col("idx") / 500)).agg(*(F.count_if(F.col("kind") == i).alias(f"n{i}") for i in range(8)))


def banner_sql(ending: str) -> str:
    """The published sentence: the winner, the second, their distance, and all totals in the lanes' order."""
    return with_tr(f", {LANES}, o AS (SELECT *, row_number() OVER (ORDER BY work, lane) AS n FROM ln) SELECT (SELECT label FROM o WHERE n = 1) || ' beat ' || (SELECT label FROM o WHERE n = 2) || ' by ' || format('{{:,}}', (SELECT work FROM o WHERE n = 2) - (SELECT work FROM o WHERE n = 1)) || ' {ending} (' || string_agg(label || ': ' || format('{{:,}}', work), '; ' ORDER BY lane) || ')' AS text FROM o")


@query(banner_sql("comparisons on this graph."))
def race_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.banner(lanes(spark, sf_dir))


@query(banner_sql("comparisons on the settle-all work clock."))
def settle_all_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.banner(lanes(spark, sf_dir), settle_all=True)


# ------------------------------------------------------------------ formulas, draws, sweeps


@query("SELECT n, CAST(greatest(floor(pow(log2(n), 1.0 / 3)), 1) AS BIGINT) AS k, CAST(greatest(floor(pow(log2(n), CAST(2 AS DOUBLE) / 3)), 1) AS BIGINT) AS t, CAST(greatest(floor(pow(log2(n), 1.0 / 3)), 4) AS BIGINT) AS demo_k, CAST(greatest(ceil(log2(n) / greatest(floor(pow(log2(n), CAST(2 AS DOUBLE) / 3)), 1)), 1) AS BIGINT) AS levels FROM (SELECT DISTINCT p_partkey * 37 + 5 AS n FROM part)")
def param_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") * 37 + 5).alias("n")).distinct()
    return n.select("n", *(c.alias(k) for k, c in parameters.bounded_columns(F.col("n")).items()))


M = "% 4294967296"
PRNG = f"""s AS (SELECT c_custkey, CAST((CAST(c_nationkey AS HUGEINT) + CAST(c_custkey AS HUGEINT) * 1831565813) {M} AS BIGINT) AS s FROM customer),
t1 AS (SELECT c_custkey, CAST((CAST(xor(s, s >> 15) AS HUGEINT) * (s | 1)) {M} AS BIGINT) AS t FROM s),
t2 AS (SELECT c_custkey, xor(t, CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) {M}) {M} AS BIGINT)) AS t FROM t1)"""


@query(f"WITH {PRNG} SELECT c_custkey, xor(t, t >> 14) AS u32 FROM t2")
def prng_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", prng.draw_u32(F.col("c_nationkey"), F.col("c_custkey")).alias("u32"))


SEED_N, SEED = 400, 3
DRAWS = f"""i AS (SELECT CAST(i AS BIGINT) AS i, CAST(({SEED} + CAST(i + 1 AS HUGEINT) * 1831565813) {M} AS BIGINT) AS s FROM range({SEED_N - 20}) AS r(i)),
t1 AS (SELECT i, CAST((CAST(xor(s, s >> 15) AS HUGEINT) * (s | 1)) {M} AS BIGINT) AS t FROM i), t2 AS (SELECT i, xor(t, CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) {M}) {M} AS BIGINT)) AS t FROM t1), u AS (SELECT i, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM t2)"""


LONG_DRAWS = DRAWS.replace(f"range({SEED_N - 20})", "range((SELECT n - c FROM size))")


@query(f"""WITH size AS (SELECT n, CAST(greatest(2, floor(sqrt(n))) AS BIGINT) AS c FROM (SELECT count(*) AS n FROM customer)), {LONG_DRAWS}, a AS (SELECT CAST(i AS BIGINT) AS p, CAST(i + 1 AS BIGINT) AS q, 1.0::DOUBLE AS w FROM range((SELECT c - 1 FROM size)) AS r(i) UNION ALL SELECT i % (c - 1), i + c, c + u FROM u, size)
SELECT p AS src, q AS dst, w FROM a UNION ALL SELECT q, p, w FROM a""")
def adversarial_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family's graph with as many vertices as there are customers."""
    return generators.adversarial_arcs(spark, table(spark, sf_dir, "customer").count(), SEED)


@query("SELECT l_returnflag AS family, l_linestatus AS size, bool_and(l_extendedprice < 104000) AS passed, count(*) FILTER (l_extendedprice >= 104000) AS losses FROM lineitem GROUP BY ALL")
def family_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import sweeps

    cells = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("size"), F.col("l_extendedprice").alias("bounded_work"), F.lit(104000).alias("dijkstra_work"))
    return sweeps.family_gate(cells)


@query("SELECT v, CAST(CASE WHEN work - mark >= 0 AND work - mark < 10000 THEN 1 ELSE 0 END AS BIGINT) AS shown, CAST(floor(255.0 * nth / greatest(1, n - 1)) AS BIGINT) AS shade FROM (SELECT event_id AS v, event_id * 3 AS mark, 20000 AS work, row_number() OVER (ORDER BY event_id) - 1 AS nth, count(*) OVER () AS n FROM events)")
def ghost_shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.operators import scene

    clicks = graphs.prefix_sums(table(spark, sf_dir, "events").select(F.col("event_id").alias("v"), F.lit(1).alias("one")), "v", "one")
    n = clicks.count()
    return clicks.select("v", scene.in_window(F.lit(20000), F.col("v") * 3).cast("long").alias("shown"), scene.shade(F.col("before"), n).alias("shade"))


# ------------------------------------------------------------------ kernels: rows only


@query()
def dijkstra_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import lanes as lane_plans

    return lane_plans.run_lanes(lane_plans.specs(spark, [("sparse", 500, s, "dijkstra") for s in range(3)]))


@query()
def bmssp_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import lanes as lane_plans

    return lane_plans.run_lanes(lane_plans.specs(spark, [("sparse", 500, s, "bounded") for s in range(3)]))


@query()
def dmsy_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import lanes as lane_plans

    return lane_plans.run_lanes(lane_plans.specs(spark, [("sparse", 500, s, "forest") for s in range(3)]))


#: Published work of the classic lane, by kind and size, for seeds 0, 1 and 2.
PUBLISHED = {
    ("maze", 500): (2430, 1922, 2279), ("maze", 5000): (28853, 28383, 29404), ("sparse", 500): (5767, 5768, 3), ("sparse", 5000): (84824, 85289, 84482), ("clusters", 500): (24546, 24574, 24129),
    ("clusters", 5000): (286318, 283088, 285506), ("adversarial", 500): (8562, 8568, 8568), ("adversarial", 5000): (118508, 118461, 118526), ("city", 500): (10075, 10180, 10490),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}, {seed}, {work})" for (k, n), works in PUBLISHED.items() for seed, work in enumerate(works)) + ") AS p(kind, n, seed, work)")
def dijkstra_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import sweeps

    four = sweeps.work_grid(spark, ("maze", "sparse", "clusters", "adversarial"), (500, 5000), (0, 1, 2))
    return four.unionByName(sweeps.work_grid(spark, ("city",), (500,), (0, 1, 2)))


@query()
def kt_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import sweeps

    return sweeps.kt_sweep(spark, KINDS_OF_GRAPHS, (500,), (0, 1, 2), sweeps.KS, sweeps.VARIANTS)


@query()
def kt_sweep_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import sweeps

    return sweeps.kt_sweep(spark, ("maze", "sparse", "adversarial"), (500,), (0, 1), (2, 6, 12), sweeps.VARIANTS, "forest")


from waymark.plans import lane_queries, table_queries  # noqa: E402, F401  they register their queries here
