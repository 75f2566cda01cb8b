"""Queries over graphs and traces that the driver's tables hold: forests, searches from many sources, selection, stored
traces, replayed distances, and audits that find what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import audits, bands, forests, lists, reduce, replay, sssp, stored, trace
from waymark.plans import finish
from waymark.plans.catalog import ARCS, EVENT_TRACE, LABELS, T_MARK, event_trace, query, stand_in_arcs, value_pairs, with_tr
from waymark.schema import KINDS, RELAX
from waymark.session import table
from waymark.sources import graphs, slabs
from waymark.staging import shared_folder, stage
from waymark.streaming import lanes

# ------------------------------------------------------------------ forests over purchases

#: The sources: suppliers of a region's nations, as vertices of the graph of purchases.
REGION = "EUROPE"
SOURCES = f"st AS (SELECT 2 * s_suppkey + 1 AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{REGION}')"
FROM_SOURCES = "r(v, d) USING KEY (v) AS (SELECT v, CAST(0 AS BIGINT) FROM st UNION SELECT ed.dst, min(r.d + ed.w) FROM r JOIN ed ON ed.src = r.v LEFT JOIN recurring.r k ON k.v = ed.dst WHERE k.d IS NULL OR r.d + ed.w < k.d GROUP BY ed.dst)"
TIGHT = "tf AS (SELECT r.v, t.parent FROM r LEFT JOIN (SELECT ed.dst AS v, min(ed.src) AS parent FROM ed JOIN r a ON a.v = ed.src JOIN r b ON b.v = ed.dst WHERE a.d + ed.w = b.d AND (a.d < b.d OR ed.src < ed.dst) GROUP BY ed.dst) t USING (v))"
UPWARD = "up(v, a, k) AS (SELECT v, v, 0 FROM tf UNION ALL SELECT up.v, tf.parent, k + 1 FROM up JOIN tf ON tf.v = up.a WHERE tf.parent IS NOT NULL), sz AS (SELECT a AS v, count(*) AS size, max(k) AS h FROM up GROUP BY a), rt AS (SELECT up.v, a AS root FROM up JOIN tf ON tf.v = up.a WHERE tf.parent IS NULL)"
FOREST = f"{graphs.PURCHASES_SQL}, {SOURCES}, {FROM_SOURCES}, {TIGHT}, {UPWARD}"
LEAST, GROUP = 50, 6


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter(F.col("r_name") == REGION), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select((2 * F.col("s_suppkey") + 1).alias("v"))


def purchase_forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(forest of tight arcs from the sources, the sources)."""
    edges, start = stage(graphs.purchases(spark, sf_dir), "arcs"), stage(sources(spark, sf_dir), "sources")
    dist = sssp.relaxed(edges, start.withColumn("best", F.lit(0).cast("long"))).withColumnRenamed("best", "dist")
    parents = sssp.tight_predecessors(edges, dist)
    return stage(dist.select("v").join(parents, "v", "left").select("v", F.col("pred").alias("parent")), "forest"), start


@query(f"WITH RECURSIVE {FOREST} SELECT tf.v, tf.parent, root, size FROM tf JOIN sz USING (v) JOIN rt USING (v)")
def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forests.subtrees(purchase_forest(spark, sf_dir)[0])


@query(f"WITH RECURSIVE {FOREST} SELECT v, size FROM tf JOIN sz USING (v) WHERE parent IS NULL AND size >= {LEAST}")
def pivot_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, start = purchase_forest(spark, sf_dir)
    return forests.pivots(forest, start, LEAST)


ROUNDS, NEAR = 16, 2


@query(f"""WITH RECURSIVE {graphs.PURCHASES_SQL}, {SOURCES}, r(v, d, n) USING KEY (v) AS (SELECT v, CAST(0 AS BIGINT), 0 FROM st UNION SELECT ed.dst, min(r.d + ed.w), max(r.n) + 1 FROM r JOIN ed ON ed.src = r.v LEFT JOIN recurring.r k ON k.v = ed.dst WHERE r.n < {ROUNDS} AND r.d + ed.w < {NEAR} AND (k.d IS NULL OR r.d + ed.w < k.d) GROUP BY ed.dst),
{TIGHT}, {UPWARD}, much AS (SELECT (SELECT count(*) FROM r) > {ROUNDS} * (SELECT count(*) FROM st) AS much)
SELECT v, (SELECT much FROM much) AS given_up, (SELECT count(*) FROM r) AS reached FROM st LEFT JOIN sz USING (v) LEFT JOIN tf USING (v) WHERE (SELECT much FROM much) OR (parent IS NULL AND size >= {ROUNDS})""")
def find_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, start = stage(graphs.purchases(spark, sf_dir), "arcs"), stage(sources(spark, sf_dir), "sources")
    found, reached, given_up = forests.find_pivots(edges, start.withColumn("dist", F.lit(0)), NEAR, ROUNDS)
    return found.select("v", F.lit(given_up).alias("given_up"), F.lit(reached.count()).cast("long").alias("reached"))


GROUPED = f"""kid AS (SELECT v, parent, row_number() OVER (PARTITION BY parent ORDER BY v) AS i FROM tf WHERE parent IS NOT NULL),
res(v, r, lvl) USING KEY (v) AS (SELECT v, 1, CAST(0 AS INT) FROM sz WHERE h = 0 UNION SELECT sz.v, list_reduce(list_prepend(1, list(k.r ORDER BY kid.i)), lambda a, x: CASE WHEN a + x >= {GROUP} THEN 1 ELSE a + x END), max(sz.h) FROM sz JOIN kid ON kid.parent = sz.v JOIN recurring.res k ON k.v = kid.v WHERE sz.h = (SELECT max(lvl) + 1 FROM res) GROUP BY sz.v),
pre AS (SELECT kid.v, parent, i, r, list_reduce(list_prepend(1, list(r) OVER (PARTITION BY parent ORDER BY i ROWS UNBOUNDED PRECEDING)), lambda a, x: CASE WHEN a + x >= {GROUP} THEN 1 ELSE a + x END) AS a FROM kid JOIN res USING (v)),
e AS (SELECT *, coalesce(lag(a) OVER o, 1) + r >= {GROUP} AS whole, lead(v) OVER o AS after FROM pre WINDOW o AS (PARTITION BY parent ORDER BY i)),
nx AS (SELECT e.v, e.parent, whole, CASE WHEN whole THEN NULL WHEN after IS NOT NULL THEN after WHEN tf.parent IS NOT NULL THEN e.parent END AS next FROM e JOIN tf ON tf.v = e.parent),
go(v, x) AS (SELECT v, v FROM nx UNION ALL SELECT go.v, nx.next FROM go JOIN nx ON nx.v = go.x WHERE nx.next IS NOT NULL),
path(v, p) AS (SELECT v, [v] FROM tf WHERE parent IS NULL UNION ALL SELECT tf.v, list_append(p, tf.v) FROM path JOIN tf ON tf.parent = path.v),
late AS (SELECT root, arg_max(nx.v, list_append(p, 9223372036854775807)) AS latest FROM nx JOIN path ON path.v = nx.v JOIN rt ON rt.v = nx.v WHERE whole GROUP BY root),
grp AS (SELECT go.v, nx0.parent, CASE WHEN t.whole THEN x ELSE coalesce(latest, rt.root) END AS grp FROM go JOIN nx t ON t.v = go.x JOIN nx nx0 ON nx0.v = go.v JOIN rt ON rt.v = go.v LEFT JOIN late ON late.root = rt.root WHERE t.next IS NULL)"""


@query(f"WITH RECURSIVE {FOREST}, {GROUPED} SELECT v, parent, grp FROM grp")
def forest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forests.groups(purchase_forest(spark, sf_dir)[0], GROUP)


@query(f"""WITH RECURSIVE {FOREST}, {GROUPED}, ends AS (SELECT grp, v AS x FROM grp UNION SELECT grp, parent FROM grp), m AS (SELECT grp, count(*) AS arcs FROM grp GROUP BY grp), n AS (SELECT grp, count(*) AS vertices FROM ends GROUP BY grp)
SELECT grp, arcs, vertices, vertices = arcs + 1 AS connected, vertices BETWEEN {GROUP} AND 3 * {GROUP} OR EXISTS (SELECT 1 FROM tf JOIN sz USING (v) WHERE parent IS NULL AND v = grp AND size < {GROUP}) AS sized FROM m JOIN n USING (grp)""")
def forest_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every group: arcs, vertices, whether it is connected (a forest's part with one vertex more than arcs) and of the
    size asked for, or a small tree as a whole."""
    forest = purchase_forest(spark, sf_dir)[0]
    found = stage(forests.groups(forest, GROUP), "groups")
    arcs = found.groupBy("grp").agg(F.count("*").alias("arcs"))
    ends = found.select("grp", F.col("v").alias("x")).union(found.select("grp", "parent")).distinct().groupBy("grp").agg(F.count("*").alias("vertices"))
    roots = forest.filter("parent is null").select(F.col("v").alias("grp"), F.lit(True).alias("whole"))
    met = arcs.join(ends, "grp").join(roots, "grp", "left")
    n = F.col("vertices")
    return met.select("grp", "arcs", "vertices", (n == F.col("arcs") + 1).alias("connected"), (n.between(GROUP, 3 * GROUP) | (F.coalesce("whole", F.lit(False)) & (n < GROUP))).alias("sized"))


# ------------------------------------------------------------------ many sources

REACH, BAND = 6, 2
OWN = "st AS (SELECT 2 * s_suppkey + 1 AS v FROM supplier WHERE s_nationkey = (SELECT arg_min(s_nationkey, s_suppkey) FROM supplier))"


@query(f"""WITH RECURSIVE {graphs.PURCHASES_SQL}, {OWN}, r(s, v, d) USING KEY (s, v) AS (SELECT v, v, CAST(0 AS BIGINT) FROM st UNION SELECT r.s, ed.dst, min(r.d + ed.w) FROM r JOIN ed ON ed.src = r.v LEFT JOIN recurring.r k ON k.s = r.s AND k.v = ed.dst WHERE r.d + ed.w < {REACH} AND (k.d IS NULL OR r.d + ed.w < k.d) GROUP BY r.s, ed.dst)
SELECT s AS source, v, d AS dist FROM r""")
def distances_from_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier of one nation (that of the first supplier), to what lies below a bound."""
    edges, supplier = stage(graphs.purchases(spark, sf_dir), "arcs"), table(spark, sf_dir, "supplier")
    nation = supplier.agg(F.min_by("s_nationkey", "s_suppkey")).first()[0]
    start = supplier.filter(F.col("s_nationkey") == nation).select((2 * F.col("s_suppkey") + 1).alias("source"), (2 * F.col("s_suppkey") + 1).alias("v"))
    return bands.distances(edges, start, REACH, BAND).select("source", "v", "dist")


# ------------------------------------------------------------------ selection

KTH = 100


@query(f"SELECT event_type, value, key FROM (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS value, user_id AS key, row_number() OVER (PARTITION BY event_type ORDER BY floor(value * 100), user_id) AS n FROM events) WHERE n = {KTH}")
def kth_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = value_pairs(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return lists.kth(pairs, "event_type", KTH)


@query("SELECT lane, key, value, bound FROM (SELECT *, max(CASE WHEN n = 9 THEN value END) OVER (PARTITION BY lane) AS bound FROM (SELECT lane, vertex AS key, value, row_number() OVER (PARTITION BY lane ORDER BY value, vertex) AS n FROM (SELECT CAST(user_id % 3 AS INT) AS lane, event_id AS vertex, CAST(floor(value * 100) AS BIGINT) AS value FROM events))) WHERE n <= 8")
def pull_of_each_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = value_pairs(spark, sf_dir).select((F.col("key") % 3).cast("int").alias("lane"), F.col("event_id").alias("key"), "value")
    return lists.pull_each(rows, ["lane"], 8).select("lane", "key", "value", "bound")


LABELLED = "(SELECT CAST(user_id % 3 AS INT) AS lane, floor(value) AS length, event_id % 7 AS n_edges, event_id AS curr, user_id AS pred FROM events)"


@query(f"SELECT lane, curr, length, n_edges, pred, b_length, b_curr FROM (SELECT *, max(CASE WHEN n = 6 THEN length END) OVER (PARTITION BY lane) AS b_length, max(CASE WHEN n = 6 THEN curr END) OVER (PARTITION BY lane) AS b_curr FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY length, n_edges, curr, pred) AS n FROM {LABELLED})) WHERE n <= 5")
def pull_labels_of_each_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    label = sssp.label(F.floor("value").cast("double"), F.col("event_id") % 7, F.col("event_id"), F.col("user_id"))
    rows = e.select((F.col("user_id") % 3).cast("int").alias("lane"), label.alias("label"))
    return lists.pull_each(rows, ["lane"], 5, ["label"]).select("lane", "label.curr", "label.length", "label.n_edges", "label.pred", F.col("bound.length").alias("b_length"), F.col("bound.curr").alias("b_curr"))


# ------------------------------------------------------------------ stored traces

SLAB, EVERY = 1024, 1000


def stored_events(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the events trace, kept in two goes, each half of the ids."""
    rows, arcs, path = event_trace(spark, sf_dir), stand_in_arcs(spark), shared_folder(spark, "trace")
    half = rows.agg(F.max("idx")).first()[0] // 2
    stored.store(rows.filter(F.col("idx") <= half), path, arcs, SLAB, EVERY)
    stored.append(rows.filter(F.col("idx") > half), path, arcs, SLAB, EVERY)
    return path


@query(with_tr(f"SELECT lane, count(*) FILTER (work_after <= {T_MARK}) AS position, min(work_after) FILTER (work_after > {T_MARK}) AS next_work FROM wk GROUP BY lane"))
def seek_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_events(spark, sf_dir)
    return stored.seek(spark, path, T_MARK).join(stored.next_boundary(spark, path, T_MARK), "lane")


@query(f"""WITH {EVENT_TRACE}, {ARCS}, wk AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS work_after FROM tr), a AS (SELECT * FROM wk WHERE work_after <= {T_MARK}),
p AS (SELECT lane, dst AS v, arg_max(src, idx) AS pred FROM a JOIN arcs USING (edge) WHERE kind = 0 AND aux0 = 1 GROUP BY ALL), s AS (SELECT lane, CAST(vertex AS BIGINT) AS v, true AS settled FROM a WHERE kind = 1)
SELECT lane, v, pred, coalesce(settled, false) AS settled FROM p FULL JOIN s USING (lane, v)""")
def restore_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.restored(spark, stored_events(spark, sf_dir), stand_in_arcs(spark), T_MARK, EVERY)


@query(with_tr("SELECT lane, idx, kind, vertex, edge, aux0, aux1, aux2, aux_f, cost FROM tr"))
def slab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events trace written as slabs in two commits and read again."""
    rows, path = event_trace(spark, sf_dir), shared_folder(spark, "slabs")
    for part in ("idx % 2 = 0", "idx % 2 = 1"):
        slabs.write(rows.filter(part), path, SLAB)
    return slabs.read(spark, path).select("lane", "idx", "kind", "vertex", "edge", "aux0", "aux1", "aux2", "aux_f", "cost")


# ------------------------------------------------------------------ replay over the events trace and a table's arcs

#: Arcs between nations, one a customer, by the whole part of the balance.
NATIONS = "ca AS (SELECT CAST(c_custkey - 1 AS INT) AS edge, CAST(c_nationkey AS BIGINT) AS src, CAST((c_nationkey + 1 + c_custkey % 24) % 25 AS BIGINT) AS dst, CAST(floor(abs(c_acctbal)) AS BIGINT) AS w FROM customer)"
HITS = f"""{EVENT_TRACE}, {NATIONS}, hits AS (SELECT lane, idx, src, dst, w FROM tr JOIN ca USING (edge) WHERE kind = 0 AND aux0 = 1),
chain AS (SELECT h.*, p.idx AS prev FROM hits h ASOF LEFT JOIN hits p ON p.lane = h.lane AND p.dst = h.src AND h.idx > p.idx),
lab(lane, idx, v, dist, n_edges, pred) AS (SELECT lane, idx, dst, CASE WHEN src = 0 THEN w END, CAST(1 AS BIGINT), src FROM chain WHERE prev IS NULL UNION ALL SELECT c.lane, c.idx, c.dst, lab.dist + c.w, lab.n_edges + 1, c.src FROM lab JOIN chain c ON c.lane = lab.lane AND c.prev = lab.idx)"""


def nation_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e, src, dst, w: an arc a customer between 25 nations."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select((key - 1).cast("int").alias("e"), nation.cast("long").alias("src"), ((nation + 1 + key % 24) % 25).cast("long").alias("dst"), F.floor(F.abs("c_acctbal")).cast("long").alias("w"))


def settling_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events trace with settled vertices among the nations."""
    return event_trace(spark, sf_dir).withColumn("vertex", F.when(F.col("kind") == 1, F.col("vertex") % 25).otherwise(F.col("vertex")).cast("int"))


SETTLING = "ts AS (SELECT * REPLACE (CAST(CASE WHEN kind = 1 THEN vertex % 25 ELSE vertex END AS INT) AS vertex) FROM tr)"


@query(f"WITH RECURSIVE {HITS} SELECT lane, idx, v, dist, n_edges, pred FROM lab")
def replayed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.labels_over_time(event_trace(spark, sf_dir), nation_arcs(spark, sf_dir), 0)


@query(f"""WITH RECURSIVE {HITS}, l AS (SELECT DISTINCT lane FROM tr), z AS (SELECT lane, v, arg_max(coalesce(dist, -1), idx) AS dist FROM lab WHERE v <> 0 GROUP BY lane, v)
SELECT lane, v, nullif(dist, -1) AS dist FROM z UNION ALL SELECT lane, 0, 0 FROM l""")
def replay_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.distances(event_trace(spark, sf_dir), nation_arcs(spark, sf_dir), 0)


#: Lanes 3 to 5: every line of an order relaxes the arc from its supplier to its customer, and improves it where the quantity is odd.
LINES = "CAST(3 + l_linenumber % 3 AS INT) AS lane, (l_orderkey * 8 + l_linenumber) * 2147483648 + l_suppkey AS idx"


@query(f"""WITH {EVENT_TRACE}, {NATIONS}, pt AS (SELECT {LINES}, 2 * l_suppkey + 1 AS src, 2 * o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(floor(l_quantity) AS BIGINT) % 2 = 1)
SELECT lane, dst AS v, arg_max(src, idx) AS pred FROM tr JOIN ca USING (edge) WHERE kind = 0 AND aux0 = 1 GROUP BY ALL UNION ALL SELECT lane, dst, arg_max(src, idx) FROM pt GROUP BY ALL""")
def replay_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the events trace leaves behind between the nations, and the trace of all lines in the graph of purchases."""
    nations = trace.replayed(event_trace(spark, sf_dir), nation_arcs(spark, sf_dir))
    customer, supplier = (F.col("dst") / 2).cast("long"), ((F.col("src") - 1) / 2).cast("long")
    number = lambda customer, supplier: F.shiftleft(customer.cast("long"), 31) + supplier
    arcs = graphs.purchases(spark, sf_dir).filter("src % 2 = 1").select(number(customer, supplier).alias("e"), "src", "dst")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.selectExpr(*LINES.split(", ", 1), f"{RELAX} AS kind", "CAST(floor(l_quantity) AS BIGINT) % 2 AS aux0", "shiftleft(o_custkey, 31) + l_suppkey AS edge")
    return nations.unionByName(trace.replayed(rows, arcs))


@query(f"""WITH {EVENT_TRACE}, {NATIONS}, x AS (SELECT lane, idx, src, dst, w FROM tr JOIN ca USING (edge) WHERE kind = 0),
f AS (SELECT lane, list(idx ORDER BY idx) AS ids, list_reduce(list_prepend(list_transform(range(26), lambda v: CASE WHEN v = 0 THEN CAST(0 AS BIGINT) ELSE 1000000000 END), list([src, dst, w] ORDER BY idx)),
 lambda a, e: list_append(list_transform(a, lambda d, i: CASE WHEN i = e[2] + 1 THEN least(d, a[e[1] + 1] + e[3]) ELSE d END), CASE WHEN a[e[1] + 1] + e[3] < least(a[e[2] + 1], 1000000000) THEN CAST(1 AS BIGINT) ELSE 0 END)) AS a FROM x GROUP BY lane)
SELECT lane, unnest(ids) AS idx, CAST(unnest(ids) % 389 AS INT) AS edge, unnest(a[27:]) = 1 AS improved FROM f""")
def improved_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir).filter("kind = 0").select("lane", "idx", "edge")
    return reduce.told_anew(rows, nation_arcs(spark, sf_dir), 0)


# ------------------------------------------------------------------ streams

STREAM_SLAB, STREAM_LANE = 512, 4096


@query(f"""WITH {EVENT_TRACE}, s AS (SELECT run_id, CAST(idx // {STREAM_LANE} AS INT) AS lane, count(*) AS applied, CAST(sum(cost) AS BIGINT) AS total, """ + ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(KINDS)) + """ FROM tr GROUP BY ALL)
SELECT *, 0 AS waiting, true AS complete, false AS stalled, (SELECT max(total) FROM s) AS cap FROM s""")
def streamed_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events trace, cut into lanes of consecutive rows, as a stream of slabs that arrive in no order."""
    rows, path = event_trace(spark, sf_dir), shared_folder(spark, "slabs")
    rows = rows.withColumn("lane", F.floor(F.col("idx") / STREAM_LANE).cast("int")).withColumn("idx", F.col("idx") % STREAM_LANE)
    lanes.write_slabs(rows, path, STREAM_SLAB)
    return lanes.streamed(spark, path, 3)


# ------------------------------------------------------------------ audits of the events trace, which breaks every rule

CALLS = """c0 AS (SELECT *, sum(CASE WHEN kind = 5 AND aux0 = 0 THEN 1 WHEN kind = 5 AND aux0 = 1 THEN -1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM tr),
c1 AS (SELECT *, CASE WHEN kind = 5 AND aux0 = 1 THEN s + 1 ELSE s END AS depth FROM c0),
cl AS (SELECT *, last_value(CASE WHEN kind = 5 AND aux0 = 0 THEN aux1 END IGNORE NULLS) OVER w AS call_level, last_value(CASE WHEN kind = 5 AND aux0 = 0 THEN aux_f END IGNORE NULLS) OVER w AS call_bound, last_value(CASE WHEN kind = 5 AND aux0 = 0 THEN idx END IGNORE NULLS) OVER w AS entered FROM c1 WINDOW w AS (PARTITION BY lane, depth ORDER BY idx ROWS UNBOUNDED PRECEDING))"""
VALUES = "ev AS (SELECT event_id, value FROM events)"


def audit(body: str) -> str:
    """SQL: violations by lane, of all lanes; body selects the lane of each."""
    return f"WITH {EVENT_TRACE}, {CALLS}, {VALUES}, {SETTLING}, bad AS ({body}) SELECT lane, (SELECT count(*) FROM bad WHERE bad.lane = l.lane) AS violations FROM (SELECT DISTINCT lane FROM tr) l"


def per_lane(rows: DataFrame, broken: DataFrame) -> DataFrame:
    """lane, violations, for every lane of rows."""
    counted = broken.groupBy("lane").agg(F.count("*").alias("n"))
    return rows.select("lane").distinct().join(counted, "lane", "left").select("lane", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


def settled_values(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """lane, v, dist: of every settled vertex the value of the event that it is."""
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("v"), F.col("value").alias("dist"))
    return rows.filter("kind = 1").select("lane", F.col("vertex").cast("long").alias("v")).distinct().join(values, "v")


FINISH = 7


@query(with_tr(f", {SETTLING} SELECT lane, bool_or(vertex = {FINISH}) AS frozen FROM ts WHERE kind = 1 GROUP BY lane"))
def frozen_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each lane has settled the finish, and so stands still."""
    settles = settling_trace(spark, sf_dir).filter("kind = 1").select("lane", F.col("vertex").cast("long").alias("v"))
    return finish.frozen(settles, FINISH)


@query(audit("SELECT lane FROM (SELECT lane, value, max(value) OVER (PARTITION BY lane ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tr JOIN ev ON event_id = vertex WHERE kind = 1) WHERE value < before"))
def audit_settle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir)
    return per_lane(rows, audits.settle_order(rows, settled_values(spark, sf_dir, rows)))


@query(audit("SELECT lane FROM cl JOIN ev ON event_id = vertex WHERE kind = 1 AND (call_bound IS NULL OR value > call_bound)"))
def audit_bounded_settles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir)
    return per_lane(rows, audits.bounded_settles(rows, settled_values(spark, sf_dir, rows)))


@query(audit("SELECT lane FROM cl WHERE kind = 2 AND coalesce(call_level <> 0, true)"))
def audit_heap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir)
    return per_lane(rows, audits.heap_levels(rows))


@query(audit("SELECT lane FROM cl WHERE kind = 7 AND aux0 = 2 AND (call_level IS NULL OR call_level < 1 OR aux1 > pow(2.0, (call_level - 1) * 2))"))
def audit_pull_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir)
    return per_lane(rows, audits.pull_sizes(rows, 2))


@query(audit("SELECT lane FROM (SELECT lane, row_number() OVER (PARTITION BY lane, vertex ORDER BY idx) AS n FROM ts WHERE kind = 1) WHERE n > 1"))
def audit_settled_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settling_trace(spark, sf_dir)
    return per_lane(rows, audits.settled_once(rows))


@query(audit("SELECT i.lane FROM cl i WHERE kind = 5 AND aux0 = 0 AND NOT EXISTS (SELECT 1 FROM cl o WHERE o.lane = i.lane AND o.depth = i.depth AND o.kind = 5 AND o.aux0 = 1 AND o.entered = i.idx) UNION ALL SELECT lane FROM cl WHERE kind = 5 AND depth < 1"))
def audit_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir)
    return per_lane(rows, audits.nesting(rows))


MOST_VERTICES, MOST_EDGES = 5000, 300


@query(audit(f"""SELECT lane FROM (SELECT lane, sum(CASE WHEN aux0 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS open FROM tr WHERE kind = 4) WHERE open NOT BETWEEN 0 AND 1
UNION ALL SELECT lane FROM tr WHERE (kind IN (0, 6) AND edge NOT BETWEEN 0 AND {MOST_EDGES - 1}) OR (kind IN (1, 3) AND vertex NOT BETWEEN 0 AND {MOST_VERTICES - 1}) OR (kind = 3 AND aux0 < 0) OR (kind = 6 AND aux1 < 0)"""))
def audit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_trace(spark, sf_dir)
    return per_lane(rows, audits.batches(rows, MOST_VERTICES, MOST_EDGES))


@query(audit("SELECT lane FROM (SELECT lane, edge, aux0, aux1, sum(CASE WHEN kind = 5 AND aux0 = 0 AND aux1 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY idx ROWS UNBOUNDED PRECEDING) AS call, kind FROM tr) WHERE kind = 6 AND aux0 = 1 GROUP BY lane, call, edge HAVING count(DISTINCT aux1) > 1"))
def audit_cut_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the calls, those of level 0 alone count as such, so that a call is long enough to cut an edge twice."""
    rows = event_trace(spark, sf_dir)
    return per_lane(rows, audits.cut_groups(rows.filter("kind != 5 or aux1 = 0")))


@query(f"""WITH RECURSIVE {HITS}, {SETTLING}, st AS (SELECT lane, CAST(vertex AS BIGINT) AS v, min(idx) AS settled_at FROM ts WHERE kind = 1 GROUP BY ALL), x AS (SELECT *, coalesce(CAST(dist AS DOUBLE), 'inf'::DOUBLE) AS len FROM lab),
y AS (SELECT *, coalesce(lag(len) OVER w, CASE WHEN v = 0 THEN 0 ELSE 'inf'::DOUBLE END) AS b_len, coalesce(lag(n_edges) OVER w, 0) AS b_n, coalesce(lag(pred) OVER w, -1) AS b_pred FROM x WINDOW w AS (PARTITION BY lane, v ORDER BY idx))
SELECT lane, klass, count(*) AS n FROM (SELECT y.lane, CASE WHEN len < b_len THEN 'strict-length' WHEN len > b_len THEN 'no improvement' WHEN n_edges < b_n OR (n_edges = b_n AND y.pred < b_pred) THEN 'lex-only' WHEN n_edges = b_n AND y.pred = b_pred THEN 'equal-label' ELSE 'no improvement' END AS klass
FROM y JOIN st ON st.lane = y.lane AND st.v = y.v WHERE y.idx > settled_at) GROUP BY ALL""")
def audit_late_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.late_improvements(settling_trace(spark, sf_dir), nation_arcs(spark, sf_dir), 0)
    return found.groupBy("lane", "klass").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {HITS}, ed AS (SELECT src, dst, min(w) AS w FROM ca GROUP BY ALL), {LABELS}, z AS (SELECT lane, v, arg_max(coalesce(dist, -1), idx) AS dist, arg_max(pred, idx) AS pred FROM lab GROUP BY lane, v), k AS (SELECT DISTINCT lane FROM tr),
want AS (SELECT k.lane, l.v, CAST(lab.length AS DOUBLE) AS length, lab.pred AS want FROM l, k), got AS (SELECT lane, v, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE nullif(CAST(dist AS DOUBLE), -1) END AS dist, CASE WHEN v = 0 THEN -1 ELSE pred END AS pred FROM z)
SELECT lane, v, got.dist, got.pred, length, want FROM got FULL JOIN want USING (lane, v) WHERE got.dist IS DISTINCT FROM length OR got.pred IS DISTINCT FROM want""")
def audit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lanes leave behind, with the source's own label, where it differs from the least labels."""
    arcs, rows = nation_arcs(spark, sf_dir), event_trace(spark, sf_dir)
    left = replay.labels_over_time(rows, arcs, 0).groupBy("lane", F.col("v").cast("long").alias("v")).agg(F.max_by("dist", "idx").cast("double").alias("dist"), F.max_by("pred", "idx").alias("pred"))
    at_source = F.col("v") == 0
    got = left.select("lane", "v", F.when(at_source, 0.0).otherwise(F.col("dist")).alias("dist"), F.when(at_source, -1).otherwise(F.col("pred")).cast("long").alias("pred"))
    least = sssp.labels(stage(arcs.groupBy("src", "dst").agg(F.min("w").alias("w")), "arcs"), 0)
    return audits.label_shapes(got, least.withColumn("lane", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))))
