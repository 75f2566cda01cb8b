"""Queries over lanes that were run, and the operators around them. The lanes run on the adversarial family, whose arcs
SQL can make too, so that what a trace leaves behind can be held against shortest paths in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import parameters
from waymark.operators import lists, race, reduce, scene, sssp, trace
from waymark.plans import catalog, finish, specs
from waymark.plans import lanes as lane_plans
from waymark.plans.catalog import ARCS, DRAWS, EVENT_TRACE, FULL, LANES, PLACES, SEED, SEED_N, T_MARK, event_trace, first_vertex, lanes, placed, query, stand_in_arcs, with_tr
from waymark.session import table
from waymark.sources import generators, graphs
from waymark.staging import stage

RACERS = ("dijkstra", "bmssp", "dmsy")
ADVERSARIAL = f"""{DRAWS}, half AS (SELECT CAST(i AS BIGINT) AS p, CAST(i + 1 AS BIGINT) AS q, 1.0::DOUBLE AS w FROM range(19) AS r(i) UNION ALL SELECT i % 19, i + 20, 20 + u FROM u),
ed AS (SELECT p AS src, q AS dst, w FROM half UNION ALL SELECT q, p, w FROM half),
r(v, d) USING KEY (v) AS (SELECT CAST(0 AS BIGINT), 0.0::DOUBLE UNION SELECT ed.dst, min(r.d + ed.w) FROM r JOIN ed ON ed.src = r.v LEFT JOIN recurring.r k ON k.v = ed.dst WHERE k.d IS NULL OR r.d + ed.w < k.d GROUP BY ed.dst)"""
UP = "up AS (SELECT ed.dst AS v, min(ed.src) AS pred FROM ed JOIN r a ON a.v = ed.src JOIN r b ON b.v = ed.dst WHERE a.d + ed.w = b.d AND a.d < b.d GROUP BY ed.dst)"


def run_specs(spark: SparkSession) -> DataFrame:
    return lane_plans.specs(spark, [("adversarial", SEED_N, SEED, name) for name in RACERS])


def run_rows(spark: SparkSession) -> DataFrame:
    return stage(lane_plans.run_lanes(run_specs(spark)), "lanes")


def run_results(spark: SparkSession) -> DataFrame:
    return lane_plans.run_results(run_specs(spark)).drop("run_id")


def run_edges(spark: SparkSession) -> DataFrame:
    return stage(graphs.packed(generators.adversarial_arcs(spark, SEED_N, SEED)), "arcs")


@query(f"WITH RECURSIVE {ADVERSARIAL}, {UP} SELECT CAST(lane AS INT) AS lane, v, d AS dist, coalesce(pred, -1) AS pred FROM r LEFT JOIN up USING (v), range(3) AS l(lane)")
def lane_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_results(spark)


@query(f"WITH RECURSIVE {ADVERSARIAL} SELECT v, row_number() OVER (ORDER BY d, v) - 1 AS nth FROM r")
def settle_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(spark).filter("lane = 0 and kind = 1")
    return rows.select(F.col("vertex").cast("long").alias("v"), F.col("aux0").cast("long").alias("nth"))


@query(with_tr(""", g AS (SELECT *, kind = 4 AND aux0 = 0 AS s, sum(CASE WHEN kind = 7 OR (kind = 5 AND aux0 = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS grp FROM tr)
SELECT lane, idx, aux0 = 0 AS open, aux1 AS level, aux2 AS size, n AS round FROM (SELECT *, count(*) FILTER (s) OVER (PARTITION BY lane, grp ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n FROM g) WHERE kind = 4"""))
def batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.batch_state(event_trace(spark, sf_dir))


@query(with_tr(""", g AS (SELECT *, sum(CASE WHEN kind = 5 AND aux0 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS call FROM tr)
SELECT lane, CAST(call AS BIGINT) AS call, count(*) FILTER (aux0 = 0) AS grown, count(*) FILTER (aux0 = 1) AS cut, least(count(DISTINCT aux1) FILTER (aux0 = 1), 1024) AS subtrees FROM g WHERE kind = 6 GROUP BY lane, call"""))
def forest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.forest_counts(event_trace(spark, sf_dir))


@query(f"""WITH {EVENT_TRACE}, {ARCS}, wk AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS work_after FROM tr), a AS (SELECT * FROM wk WHERE work_after <= {T_MARK}),
p AS (SELECT lane, dst AS v, arg_max(src, idx) AS pred FROM a JOIN arcs USING (edge) WHERE kind = 0 AND aux0 = 1 GROUP BY ALL), s AS (SELECT lane, CAST(vertex AS BIGINT) AS v, true AS settled FROM a WHERE kind = 1)
SELECT lane, v, pred, coalesce(settled, false) AS settled FROM p FULL JOIN s USING (lane, v)""")
def keyframe_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, arcs = event_trace(spark, sf_dir), stand_in_arcs(spark)
    return trace.restored(rows, stage(trace.snapshots(rows, arcs, 1000), "snapshots"), arcs, T_MARK, 1000)


@query("SELECT CAST(user_id % 3 AS INT) AS lane, CAST(event_id // 65536 AS INT) AS chunk, CAST(event_id % 65536 AS INT) AS row FROM events WHERE event_id = 77")
def locate_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.located(event_trace(spark, sf_dir), 77)


@query(with_tr("SELECT lane, idx, work_after AS work FROM wk WHERE idx = 77"))
def step_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.stepped(event_trace(spark, sf_dir), 77)


@query(with_tr(""", s AS (SELECT lane, idx, CAST(vertex * 37 % 1009 AS DOUBLE) AS dist FROM tr WHERE kind = 1), o AS (SELECT *, max(dist) OVER (PARTITION BY lane ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT lane, CAST(sum(cost) AS BIGINT) AS comparisons, count(*) FILTER (kind = 2) AS heap_ops, count(*) FILTER (kind = 7) AS dstruct_ops, count(*) FILTER (kind = 0) AS relaxations, (SELECT count(*) FROM o WHERE o.lane = tr.lane AND dist < before) AS out_of_order, count(*) FILTER (kind = 1) AS settled, 1000 AS n FROM tr GROUP BY lane"""))
def race_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir)
    dist = rows.filter("kind = 1").select("lane", F.col("vertex").cast("long").alias("v"), (F.col("vertex") * 37 % 1009).cast("double").alias("dist")).distinct()
    return trace.race_counters(rows, dist, 1000)


# ------------------------------------------------------------------ races and playback


@query("""SELECT n_regionkey AS run_id, CAST(n_nationkey AS INT) AS lane, algo, CASE WHEN nth > 1 AND algo <> 'dmsy' THEN algo || '-b' ELSE algo END AS id,
CASE algo WHEN 'dijkstra' THEN CASE WHEN nth = 1 THEN 'Dijkstra' ELSE 'Dijkstra B' END WHEN 'bmssp' THEN CASE WHEN nth = 1 THEN 'BMSSP ''25' ELSE 'BMSSP B' END ELSE 'DMSY ''26' END AS label,
CASE algo WHEN 'dijkstra' THEN CASE WHEN nth = 1 THEN 'marble' ELSE 'stub' END WHEN 'bmssp' THEN 'ember' ELSE 'moss' END AS persona
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey, algo ORDER BY n_nationkey) AS nth FROM (SELECT *, ['dijkstra', 'bmssp', 'dmsy'][n_nationkey % 3 + 1] AS algo FROM nation))""")
def named_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    algo = F.get(F.array(*(F.lit(x) for x in RACERS)), (F.col("n_nationkey") % 3).cast("int"))
    return race.named_lanes(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").cast("int").alias("lane"), algo.alias("algo")))


FINISHES = "fin AS (SELECT lane, work AS total, complete, (SELECT min(work_after) FROM wk WHERE wk.lane = ln.lane AND kind = 1 AND vertex % 100 >= 90) AS finish_work FROM ln), cap AS (SELECT coalesce(min(total) FILTER (NOT complete), max(total)) AS cap FROM fin)"


def with_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace.work_after(event_trace(spark, sf_dir))
    ends = rows.groupBy("lane").agg(F.min(F.when((F.col("kind") == 1) & (F.col("vertex") % 100 >= 90), F.col("work_after"))).alias("finish_work"))
    return lanes(spark, sf_dir).withColumnRenamed("work", "total").select("lane", "total", "complete").join(ends, "lane")


@query(with_tr(f", {LANES}, {FINISHES}, a AS (SELECT *, least({T_MARK}.0, cap, coalesce(finish_work, cap)) AS pos FROM fin, cap) SELECT lane, complete AND (pos >= total OR coalesce(finish_work <= pos, false)) AS finished, coalesce(finish_work <= pos, false) AS frozen FROM a"))
def lane_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.lane_states(with_finish(spark, sf_dir), T_MARK)


@query(with_tr(f", {LANES}, {FINISHES}, a AS (SELECT *, least({T_MARK}.0, cap, coalesce(finish_work, cap)) AS pos FROM fin, cap) SELECT bool_and(complete) AS all_complete, bool_and(coalesce(finish_work <= pos, false)) AS all_frozen, bool_and(complete) AND least({T_MARK}.0, max(cap)) >= max(total) AS settle_all_finished FROM a"))
def race_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.race_states(with_finish(spark, sf_dir), T_MARK)


@query(with_tr(f", {LANES} SELECT least({T_MARK}.5, CAST(coalesce(min(work) FILTER (NOT complete), max(work)) AS DOUBLE)) AS applied FROM ln"))
def applied_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.applied_cursor(lanes(spark, sf_dir).withColumnRenamed("work", "total"), T_MARK + 0.5)


@query(with_tr(f", {LANES}, b(beat, s, e) AS (VALUES ('wavefront', 0.0, 0.85), ('sorting', 1.0, 1.0), ('pivots', 0.0, 0.7)) SELECT CAST(sum(e * work - s * work) / (0.0458 * 20000) AS DOUBLE) AS seconds FROM ln, b"))
def story_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = spark.createDataFrame([("wavefront", 0.0, 0.85), ("sorting", 1.0, 1.0), ("pivots", 0.0, 0.7)], "beat string, start double, end double")
    return race.story_seconds(race.story_windows(beats, lanes(spark, sf_dir).select("lane", F.col("work").alias("total"))))


@query(f"""WITH {EVENT_TRACE}, wk AS (SELECT lane, CAST(sum(cost) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS w FROM tr), t AS (SELECT min(w) AS at FROM wk WHERE w > {T_MARK})
SELECT lane, count(*) FILTER (w <= {T_MARK}) AS sought, count(*) FILTER (w <= {T_MARK} + 1) AS stepped_op, count(*) FILTER (w <= greatest((SELECT min(w) FROM wk WHERE w > {T_MARK} + 1), {T_MARK} + 1)) AS stepped_event FROM wk GROUP BY lane""")
def scheduler_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.shared_steps(event_trace(spark, sf_dir), T_MARK)


FINISH_SQL = catalog.ORACLES["finish_vertex"]


@query(f"""WITH RECURSIVE best AS ({FINISH_SQL}), src AS (SELECT * FROM (WITH {graphs.PURCHASES_SQL} SELECT min(src) AS s, max(dst) AS far FROM ed))
SELECT 'automatic' AS target, v AS finish, CAST(NULL AS VARCHAR) AS status FROM best UNION ALL SELECT 'none', NULL, NULL UNION ALL SELECT 'source', v, 'target ' || s || ' is the source; using auto-pick' FROM best, src
UNION ALL SELECT 'beyond', v, 'target 999999999 is out of range; using auto-pick' FROM best UNION ALL SELECT 'given', far, NULL FROM src UNION ALL SELECT 'lonely', 999999998, 'target 999999998 unreachable from source'""")
def finish_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(graphs.purchases(spark, sf_dir), "arcs")
    source, far = edges.agg(F.min("src"), F.max("dst")).first()
    vertices = placed(edges.select(F.col("src").alias("v")).distinct().unionByName(spark.createDataFrame([(999999998,)], "v long")))
    asked = {"automatic": None, "none": "none", "source": source, "beyond": 999999999, "given": far, "lonely": 999999998}
    return spark.createDataFrame([(k, *finish.resolved(edges, vertices, source, x)) for k, x in asked.items()], "target string, finish long, status string")


URLS = {
    "race": [("?g=maze&n=5000&seed=7", "?g=maze&n=5000&seed=7&race=dijkstra,bmssp"), ("?g=none&n=-1", "?g=sparse&n=25000&seed=4&race=dijkstra,bmssp"), ("?race=dijkstra,bmssp&t=12.5&bk=4", "?g=sparse&n=25000&seed=4&race=dijkstra,bmssp&t=12.5&bk=4"), ("", "?g=sparse&n=25000&seed=4&race=dijkstra,bmssp")],
    "lens": [("?g=city&n=500&seed=1&algo=bmssp", "?g=city&n=500&seed=1&algo=bmssp"), ("?algo=x&bmssp=paper&bk=0&bt=5&n=5e2", "?g=sparse&n=500&seed=4&algo=bmssp&bmssp=paper&bt=5"), ("?dmsy=paper&dk=3&seed=-2&algo=dmsy", "?g=sparse&n=25000&seed=-2&algo=dmsy&dmsy=paper&dk=3")],
    "story": [("?mode=story&step=pivots&g=city&n=500&seed=1729&t=123", "?mode=story&step=pivots&g=city&n=500&seed=1729&t=123"), ("?mode=story&step=none&t=-1", "?mode=story&step=wavefront&g=sparse&n=25000&seed=4")],
}
CODECS = {"race": lambda s: specs.write(specs.read(s)), "lens": lambda s: specs.write_lens(specs.read_lens(s)), "story": lambda s: specs.write_story(specs.read_story(s))}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, pairs in URLS.items() for a, b in pairs) + ") AS u(codec, given, written)")
def url_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, a, CODECS[k](a)) for k, pairs in URLS.items() for a, _ in pairs], "codec string, given string, written string")


# ------------------------------------------------------------------ formulas, lists, ways back, scenes

BITS = "log2(CAST(n AS DOUBLE))"
FOREST_T = f"greatest(ceil(sqrt({BITS} * log2({BITS}) / 3)), 1)"


@query(f"""SELECT n, CAST(t AS BIGINT) AS t, CAST(k AS BIGINT) AS k, CAST(greatest(k, 6) AS BIGINT) AS demo_k, CAST(ceil({BITS} / t) AS BIGINT) AS levels, CASE WHEN m >= 3 * n THEN CAST(greatest(3, least(floor(log2(greatest(1.0, {BITS})) / 4), m // n)) AS BIGINT) END AS delta
FROM (SELECT *, CASE WHEN t >= 2 THEN ceil(t / log2(t)) ELSE 1 END AS k FROM (SELECT n, n * (n % 7) AS m, {FOREST_T} AS t FROM (SELECT DISTINCT p_partkey * 37 + 5 AS n FROM part)))""")
def forest_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") * 37 + 5).alias("n")).distinct()
    columns = parameters.forest_columns(F.col("n"))
    return n.select("n", *(c.alias(k) for k, c in columns.items()), parameters.degree_bound_column(F.col("n"), F.col("n") * (F.col("n") % 7)).alias("delta"))


@query("SELECT event_id, value < 100 OR (value = 100 AND event_type = 'click' AND user_id < 50) AS below, CASE WHEN user_id % 5 > 0 THEN CAST(event_id % 9 AS DOUBLE) / (user_id % 5) ELSE 0 END AS share FROM (SELECT event_id, event_type, user_id, least(floor(value), 100) AS value FROM events)")
def bounded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.least(F.floor("value"), F.lit(100)))
    key = F.when(F.col("event_type") == "click", F.lit(50))
    return e.select("event_id", lists.less_pair(F.col("value"), F.col("user_id"), F.lit(100), key).alias("below"), lists.region_fraction((F.col("event_id") % 9).cast("double"), F.col("user_id") % 5).alias("share"))


@query(f"WITH RECURSIVE {graphs.SUCCESSIONS_SQL}, {FULL} SELECT v, d AS dist, true AS tight FROM r")
def mapback_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from the reduced graph: the distance, and whether the predecessor stands on a shortest path."""
    edges = stage(graphs.successions(spark, sf_dir), "arcs")
    source = first_vertex(edges)
    arcs, owners = reduce.reduced(edges, 8)
    owners = stage(owners, "owners")
    start = owners.filter(F.col("v") == source).agg(F.min("copy")).first()[0]
    back = stage(reduce.mapped_back_predecessors(sssp.labels(stage(arcs, "copies"), start, reduce.ring_shortcuts(owners)), owners), "back")
    up = back.select(F.col("v").alias("pred"), F.col("dist").alias("before"))
    met = back.join(up, "pred", "left").join(edges.select(F.col("src").alias("pred"), F.col("dst").alias("v"), "w"), ["pred", "v"], "left")
    return met.select("v", "dist", F.when(F.col("v") == source, F.col("pred") == -1).otherwise(F.coalesce(F.col("before") + F.col("w") == F.col("dist"), F.lit(False))).alias("tight"))


@query(with_tr("SELECT lane, idx, CASE WHEN edge >= 0 THEN edge // 2 ELSE edge END AS edge FROM tr WHERE edge < 0 OR edge % 5 > 0"))
def unmap_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = stand_in_arcs(spark).select(F.col("e").alias("edge"), F.when(F.col("e") % 5 > 0, F.expr("e div 2")).alias("orig_edge"))
    return reduce.unmapped_arcs(event_trace(spark, sf_dir), origins).select("lane", "idx", "edge")


MARKS = "m AS (SELECT c_custkey * 31 % 700 - 20 AS cx, c_custkey * 17 % 500 - 20 AS cy, 1.5 + c_custkey % 3 AS radius, c_custkey % 40 AS frame FROM customer)"


@query(f"""WITH {MARKS}, b AS (SELECT greatest(floor(cx - radius), 0) AS a, greatest(floor(cy - radius), 0) AS b, least(ceil(cx + radius), 639) AS c, least(ceil(cy + radius), 399) AS d FROM m), q AS (SELECT count(*) AS hits, min(a) FILTER (a <= c AND b <= d) AS a, min(b) FILTER (a <= c AND b <= d) AS b, max(c) FILTER (a <= c AND b <= d) AS c, max(d) FILTER (a <= c AND b <= d) AS d FROM b)
SELECT hits, hits > 256 AS whole, CAST(CASE WHEN hits > 256 THEN 0 ELSE a END AS BIGINT) AS x, CAST(CASE WHEN hits > 256 THEN 0 ELSE b END AS BIGINT) AS y, CAST(CASE WHEN hits > 256 THEN 640 ELSE c - a + 1 END AS BIGINT) AS w, CAST(CASE WHEN hits > 256 THEN 400 ELSE d - b + 1 END AS BIGINT) AS h FROM q""")
def dirty_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return scene.dirty_box(table(spark, sf_dir, "customer").select((key * 31 % 700 - 20).alias("cx"), (key * 17 % 500 - 20).alias("cy"), (key % 3 + 1.5).alias("radius")), 640, 400)


@query("SELECT p_partkey AS tree, CAST(CAST(p_partkey AS HUGEINT) * 2654435761 % 4294967296 % 256 AS BIGINT) AS shade FROM part")
def tree_shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tree"), scene.tree_shade(F.col("p_partkey")).alias("shade"))


@query(f"""WITH p AS (SELECT {PLACES} FROM (SELECT c_custkey AS v FROM customer)), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM p)
SELECT least(640.0::DOUBLE / greatest(x1 - x0, 1e-9), 400.0::DOUBLE / greatest(y1 - y0, 1e-9)) AS scale, x0 AS "left", y0 AS top, greatest(1.5, least(4.0, 140.0::DOUBLE / sqrt(n))) AS radius FROM b""")
def fit_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.camera(placed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"))), 640.0, 400.0)


@query(f"""WITH p AS (SELECT {PLACES} FROM (SELECT c_custkey AS v FROM customer)), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT CAST(least(floor((x - x0) * 24 / greatest(x1 - x0, 1e-9)), 23) AS BIGINT) AS gx, CAST(least(floor((y - y0) * 24 / greatest(y1 - y0, 1e-9)), 23) AS BIGINT) AS gy, count(*) AS n FROM p, b GROUP BY ALL""")
def vertex_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.grid(placed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"))), 24)


@query("SELECT 0 AS lane, CAST(sum(CASE i % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN i % 16 WHEN 7 THEN i % 12 ELSE 0 END) AS BIGINT) AS work, " + ", ".join(f"count(*) FILTER (i % 8 = {i}) AS n_{k}" for i, k in enumerate(catalog.KINDS)) + " FROM range((SELECT count(*) FROM lineitem)) AS r(i)")
def mixed_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import trace_bench

    return trace.tally(trace.encode(trace_bench.mixed_events(spark, table(spark, sf_dir, "lineitem").count())))


@query("SELECT * FROM (VALUES ('S', 500), ('M', 5000), ('L', 25000), ('XL', 100000)) AS s(name, n)")
def size_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(specs.SIZES.items()), "name string, n long")


@query()
def candidate_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.plans import sweeps

    return sweeps.candidate_bench(spark, ("cascade3", "cascadeAll", "cascadeHub", "wideFrontier"), (500,), (0, 1))
