"""Forests, searches from many sources, selection, stored traces and replay against plain versions."""

import heapq
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.operators import bands, forests, lists, reduce, replay, sssp, stored, trace
from waymark.plans import catalog, table_queries
from waymark.sources import graphs, slabs
from waymark.staging import shared_folder


def random_forest(n, seed, shape):
    """(v, parent) with scattered ids: bushy, a path, a star, or several trees."""
    rng = random.Random(seed)
    ids = rng.sample(range(-1000, 100_000), n)
    up = {"bushy": lambda i: rng.randrange(i), "path": lambda i: i - 1, "star": lambda i: 0, "many": lambda i: None if rng.random() < 0.2 else rng.randrange(i)}[shape]
    return [(ids[i], None if i == 0 or (p := up(i)) is None else ids[p]) for i in range(n)]


def children_of(rows):
    kids = defaultdict(list)
    for v, p in rows:
        kids[p].append(v)
    return {p: sorted(c) for p, c in kids.items()}


SHAPES = [("bushy", 60), ("path", 40), ("star", 50), ("many", 50), ("bushy", 1)]


@pytest.mark.parametrize("shape, n", SHAPES)
def test_subtrees(spark, shape, n):
    rows = random_forest(n, 3, shape)
    kids = children_of(rows)

    def walk(v, root):
        size = 1 + sum(walk(c, root) for c in kids.get(v, []))
        want[v] = (root, size)
        return size

    want = {}
    for root in kids[None]:
        walk(root, root)
    got = {r["v"]: (r["root"], r["size"]) for r in forests.subtrees(spark.createDataFrame(rows, "v long, parent long")).collect()}
    assert got == want


def test_a_circle_is_told(spark):
    with pytest.raises(ValueError):
        forests.subtrees(spark.createDataFrame([(1, None), (2, 3), (3, 2)], "v long, parent long")).collect()


def cut(rows, s):
    """Groups by one walk over each tree, children ascending: {child: group}."""
    kids, out = children_of(rows), {}
    for root in kids.get(None, []):
        filled = []

        def walk(v):
            held, count = [], 1
            for c in kids.get(v, []):
                inner, n = walk(c)
                held, count = [*held, *inner, c], count + n
                if count >= s:
                    filled.append((c, held))
                    held, count = [], 1
            return held, count

        held, _ = walk(root)
        if filled:
            filled[-1][1].extend(held)
        else:
            filled.append((root, held))
        out |= {v: name for name, members in filled for v in members}
    return out


@pytest.mark.parametrize("s", [2, 3, 7])
@pytest.mark.parametrize("shape, n", SHAPES)
def test_groups(spark, shape, n, s):
    rows = random_forest(n, s, shape)
    found = forests.groups(spark.createDataFrame(rows, "v long, parent long"), s).collect()
    assert {r["v"]: r["grp"] for r in found} == cut(rows, s)
    members = defaultdict(set)
    for r in found:
        members[r["grp"]] |= {r["v"], r["parent"]}
    arcs = defaultdict(int)
    for r in found:
        arcs[r["grp"]] += 1
    roots = {v for v, p in rows if p is None}
    assert all(len(m) == arcs[g] + 1 and (g in roots or s <= len(m) <= 3 * s) for g, m in members.items())


def test_pivots(spark):
    chain = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "src long, dst long, w long")
    start = lambda *v: spark.createDataFrame([(x, 0) for x in v], "v long, dist long")
    found, reached, given_up = forests.find_pivots(chain, start(0), None, 3)
    assert [r["v"] for r in found.collect()] == [0] and sorted(map(tuple, reached.collect())) == [(0, 0), (1, 1), (2, 2)] and not given_up
    star = spark.createDataFrame([(0, i, 1) for i in range(1, 9)], "src long, dst long, w long")
    found, _, given_up = forests.find_pivots(star, start(0, 99), None, 2)
    assert given_up and sorted(r["v"] for r in found.collect()) == [0, 99]
    found, reached, given_up = forests.find_pivots(star, start(0), 1, 2)  # nothing lies below the bound
    assert not given_up and found.collect() == [] and reached.count() == 1


def random_arcs(n, m, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return [(a, b, rng.choice((0, 1, 1, 2, 5, 9))) for a, b in sorted(pairs) if a != b]


def heap_distances(arcs, source, bound):
    out, heap, by = {}, [(0, source)], defaultdict(list)
    for a, b, w in arcs:
        by[a].append((b, w))
    while heap:
        d, v = heapq.heappop(heap)
        if v not in out:
            out[v] = d
            for b, w in by[v]:
                if d + w < bound:
                    heapq.heappush(heap, (d + w, b))
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_bands(spark, monkeypatch, chunk):
    monkeypatch.setattr(sssp, "CHUNK", chunk)
    arcs = random_arcs(60, 400, 1)
    edges = spark.createDataFrame(arcs, "src long, dst long, w long")
    start = spark.createDataFrame([(s, s) for s in (0, 7, 7, 200)], "source long, v long")
    found = bands.distances(edges, start, 12, 3).collect()
    want = {(s, v): d for s in (0, 7, 200) for v, d in heap_distances(arcs, s, 12).items()}
    assert {(r["source"], r["v"]): r["dist"] for r in found} == want
    assert bands.distances(edges, start.limit(0), 12, 3).collect() == []


def test_bands_make_fewer_candidates_than_rounds(spark):
    """Detours of short arcs: plain rounds hand on every long arc's value first, and again whenever a better one comes."""
    arcs = [(i, j, 3 * (j - i) - 2) for i in range(40) for j in range(i + 1, min(40, i + 12))]
    edges = spark.createDataFrame(arcs, "src long, dst long, w long")
    start = spark.createDataFrame([(0, 0)], "source long, v long")
    near, rounds = (bands.distances(edges, start, 1000, delta) for delta in (2, 1000))
    assert sorted(map(tuple, near.select("v", "dist").collect())) == sorted(map(tuple, rounds.select("v", "dist").collect()))
    made = [df.agg(F.sum("tries")).first()[0] for df in (near, rounds)]
    assert made[0] == len(arcs) < made[1] / 2


@pytest.mark.parametrize("few, bins", [(4096, 1024), (3, 4), (0, 2)])
def test_kth(spark, monkeypatch, few, bins):
    monkeypatch.setattr(lists, "FEW", few)
    monkeypatch.setattr(lists, "BINS", bins)
    rng = random.Random(4)
    rows = [(g, rng.choice((0, 1, 5, 10**12)) if g % 2 else 7, rng.randrange(30)) for g in range(4) for _ in range(200)] + [(9, 1, 1), (None, 2, 3)]
    pairs = spark.createDataFrame(rows, "grp long, value long, key long")
    for k in (1, 2, 77, 200, 201):
        want = {g: sorted((v, x) for h, v, x in rows if h == g)[k - 1] for g in {r[0] for r in rows if r[0] is not None} if sum(h == g for h, _, _ in rows) >= k}
        assert {r["grp"]: (r["value"], r["key"]) for r in lists.kth(pairs, "grp", k).collect() if r["grp"] is not None} == want


def test_selection_sorts_no_table(spark, sf):
    rows = spark.range(100_000).selectExpr("id % 2 as grp", "id * 7919 % 100003 as value", "id as key")
    text = lists.kth(rows, "grp", 30_000)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "Sort " not in text


def test_pulls_are_limited_before_the_exchange(spark):
    rows = spark.range(1000).selectExpr("id % 3 as lane", "id as key", "id * 37 % 101 as value").repartition(5)
    found = lists.pull_each(rows, ["lane"], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and ", Partial" in plan
    for lane in range(3):
        own = sorted((i * 37 % 101, i) for i in range(1000) if i % 3 == lane)
        got = sorted((r["value"], r["key"], r["bound"]) for r in found.filter(F.col("lane") == lane).collect())
        assert got == [(*p, own[4][0]) for p in own[:4]]


def test_stored_traces(spark, sf, tmp_path):
    rows, arcs, path = catalog.event_trace(spark, sf), catalog.stand_in_arcs(spark), f"file://{tmp_path}/trace"
    most = rows.agg(F.max("idx")).first()[0]
    stored.store(rows.filter(F.col("idx") < most // 3), path, arcs, 64, 100)
    for low, high in ((most // 3, most // 2), (most // 2, most + 1)):
        stored.append(rows.filter((F.col("idx") >= low) & (F.col("idx") < high)), path, arcs, 64, 100)
    work = trace.work_after(rows)
    assert sorted(map(tuple, stored.slabs(spark, path).select("lane", "idx", "work_after").collect())) == sorted(map(tuple, work.select("lane", "idx", "work_after").collect()))
    total = rows.agg(F.sum("cost")).first()[0]
    for t in (0, 1, 99.5, 100, 333, 700, total, 10**9):
        assert sorted(map(tuple, stored.seek(spark, path, t).collect())) == sorted(map(tuple, trace.seek(rows, t).collect()))
        assert sorted(map(tuple, stored.next_boundary(spark, path, t).collect()), key=str) == sorted(map(tuple, trace.next_boundary(rows, t).collect()), key=str)
    snapshots = trace.snapshots(rows, arcs, 100)
    for t in (0, 100, 555, 10**9):
        want = trace.restored(rows, snapshots, arcs, t, 100)
        assert sorted(map(tuple, stored.restored(spark, path, arcs, t, 100).select("lane", "v", "pred", "settled").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_seek_reads_one_slab_of_a_lane(spark, sf, tmp_path):
    rows, arcs, path = catalog.event_trace(spark, sf), catalog.stand_in_arcs(spark), f"file://{tmp_path}/trace"
    stored.store(rows, path, arcs, 64, 100)
    found = stored.seek(spark, path, 333)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    slabs = stored.index(spark, path).filter("work_before <= 333 and work_after > 333").count()
    read = [int(x) for x in scanned(found, "/rows")]
    assert slabs == 3 and sum(read) == slabs < stored.index(spark, path).count()
    plan = stored.restored(spark, path, arcs, 333, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(frame" in plan


def scanned(df, folder):
    """How many partitions each scan of this folder has read."""
    out = []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name == "FileSourceScanExec" and folder in node.toString() + str(node.metadata()):
            out.append(node.metrics().apply("numPartitions").value() if node.metrics().contains("numPartitions") else 0)
        for i in range(node.children().length()):
            visit(node.children().apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return out


def replayed_plainly(hits, source):
    dist, n, out = {source: 0}, {source: 0}, []
    for idx, a, b, w in hits:
        dist[b], n[b] = None if dist.get(a) is None else dist[a] + w, n.get(a, 0) + 1
        out.append((0, idx, b, dist[b], n[b], a))
    return out


def test_replay_over_long_chains(spark):
    """A chain of 5 000 improvements takes a few jobs, as each doubles what is known."""
    arcs = spark.range(5000).selectExpr("cast(id as int) as e", "id as src", "id + 1 as dst", "id % 3 as w")
    rows = spark.range(5000).selectExpr("0 as lane", "id as idx", "0 as kind", "1 as aux0", "cast(id as int) as edge")
    found = replay.labels_over_time(rows, arcs, 0).orderBy(F.desc("idx")).first()
    assert (found["dist"], found["n_edges"]) == (sum(i % 3 for i in range(5000)), 5000)


def test_replay_against_a_plain_one(spark):
    rng = random.Random(8)
    arcs = [(e, a, (a + 1 + rng.randrange(7)) % 8, rng.randrange(5)) for e in range(40) for a in [rng.randrange(8)]]
    steps = [rng.randrange(40) for _ in range(300)]
    edges = spark.createDataFrame(arcs, "e int, src long, dst long, w long")
    rows = spark.createDataFrame([(0, i, 0, 1, e) for i, e in enumerate(steps)], "lane int, idx long, kind int, aux0 int, edge int")
    plain = replayed_plainly([(i, *arcs[e][1:]) for i, e in enumerate(steps)], 0)
    got = replay.labels_over_time(rows, edges, 0).select("lane", "idx", "v", "dist", "n_edges", "pred")
    assert sorted(map(tuple, got.collect())) == sorted(plain)
    doubles = replay.labels_over_time(rows, edges.withColumn("w", F.col("w") / 4), 0).select("idx", "dist", "n_edges")
    assert {r["idx"]: (r["dist"], r["n_edges"]) for r in doubles.collect()} == {x[1]: (float("inf") if x[3] is None else x[3] / 4, x[4]) for x in plain}


def test_improvements_told_anew(spark):
    rng = random.Random(2)
    arcs = [(e, a, (a + 1 + rng.randrange(11)) % 12, rng.randrange(9)) for e in range(60) for a in [rng.randrange(12)]]
    steps = [(lane, rng.randrange(60)) for _ in range(400) for lane in [rng.randrange(2)]]
    edges = spark.createDataFrame(arcs, "e int, src long, dst long, w long")
    rows = spark.createDataFrame([(lane, i, e) for i, (lane, e) in enumerate(steps)], "lane int, idx long, edge int")
    dist, want = {(0, 0): 0, (1, 0): 0}, {}
    for i, (lane, e) in enumerate(steps):
        _, a, b, w = arcs[e]
        made = dist.get((lane, a), float("inf")) + w
        want[i] = made < dist.get((lane, b), float("inf"))
        if want[i]:
            dist[lane, b] = made
    assert {r["idx"]: r["improved"] for r in reduce.told_anew(rows, edges, 0).collect()} == want


def test_violations_are_one_plan(spark):
    vertices = spark.createDataFrame([(0, 1.0, 2.0), (1, float("nan"), 0.0), (2, None, 1.0)], "v long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (1, 1, -1.0), (0, 9, float("inf")), (8, 9, None)], "src long, dst long, w double")
    found = graphs.violations(vertices, edges)
    assert found.first().asDict() == {"arcs": 5, "loops": 1, "bad_weights": 3, "loose_ends": 3, "doubled": 1, "unplaced": 2}
    assert graphs.violations(vertices, edges.limit(0)).first()["arcs"] == 0
    scans = spark.read.parquet(stage_of(edges)).transform(lambda e: graphs.violations(vertices, e))
    assert scans._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def stage_of(df):
    path = shared_folder(df.sparkSession, "edges")
    df.write.parquet(path)
    return path


def test_audits_find_what_is_there(spark, sf):
    for name in ("audit_settle_order", "audit_bounded_settles", "audit_heap_levels", "audit_pull_sizes", "audit_settled_once", "audit_nesting", "audit_batches"):
        assert sum(r["violations"] for r in getattr(table_queries, name)(spark, sf).collect()) > 0, name


def test_slabs_as_a_data_source(spark, sf, tmp_path):
    rows, path = catalog.event_trace(spark, sf), f"file://{tmp_path}/slabs"
    slabs.write(rows.filter("idx < 500"), path, 64)
    slabs.write(rows.filter("idx >= 500"), path, 64)
    (tmp_path / "slabs" / "slab-0-0-stray.arrow").write_bytes(b"of a task that failed")
    both = slabs.read(spark, path)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, rows.select(*slabs.COLUMNS).collect()))
    found = slabs.manifests(path)
    assert sum(s.rows for s in found) == rows.count() and all(s.last - s.first < 64 for s in found)
    slabs.write(rows.filter("lane = 1"), path, 64, "overwrite")
    assert slabs.read(spark, path).count() == rows.filter("lane = 1").count()


def test_conditions_leave_files_out():
    reader = slabs.PrunedReader("unused")
    asked = [slabs.EqualTo(("lane",), 1), slabs.GreaterThan(("idx",), 100), slabs.LessThanOrEqual(("idx",), 300), slabs.EqualTo(("cost",), 1)]
    assert list(reader.pushFilters(asked)) == asked and len(reader.conditions) == 3
    slab = lambda lane, first, last: slabs.Slab("s", lane, first, last, 1)
    out = lambda s: any(slabs.rules_out(c, s) for c in reader.conditions)
    assert [out(slab(*x)) for x in ((1, 0, 100), (1, 0, 101), (1, 300, 400), (1, 301, 400), (2, 150, 200))] == [True, False, False, True, True]
    assert slabs.rules_out(slabs.In(("idx",), (5, 900)), slab(0, 6, 100)) and not slabs.rules_out(slabs.In(("lane",), (0, 3)), slab(3, 0, 1))


def test_filters_reach_the_source(spark, sf, tmp_path):
    path = f"file://{tmp_path}/slabs"
    slabs.write(catalog.event_trace(spark, sf), path, 64)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = slabs.read(spark, path).filter("lane = 1 and idx < 64")
        assert one.rdd.getNumPartitions() == 1 and one.count() == catalog.event_trace(spark, sf).filter("lane = 1 and idx < 64").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_folders_do_not_grow_with_the_slabs(spark, sf, tmp_path, monkeypatch):
    """16 slabs a lane in folders of 4, by one write and by appends that end inside a folder; the same answers."""
    monkeypatch.setattr(stored, "SLABS", 4)
    monkeypatch.setattr(stored, "FRAMES", 3)
    rows, arcs = catalog.event_trace(spark, sf), catalog.stand_in_arcs(spark)
    once, twice = f"{tmp_path}/once", f"{tmp_path}/twice"
    stored.store(rows, f"file://{once}", arcs, 64, 100)
    stored.store(rows.filter("idx <= 301"), f"file://{twice}", arcs, 64, 100)
    stored.append(rows.filter("idx > 301"), f"file://{twice}", arcs, 64, 100)
    for path in (once, twice):
        folders = [x for x in os.listdir(f"{path}/rows") if x.startswith("slab=")]
        slabs_ = stored.index(spark, f"file://{path}").count()
        assert 3 * slabs_ > 8 * len(folders) and len(folders) == stored.index(spark, f"file://{path}").select("slab").distinct().count()
        assert stored.slabs(spark, f"file://{path}").count() == rows.count()
    for t in (0, 99.5, 450, 700):
        assert sorted(map(tuple, stored.seek(spark, f"file://{twice}", t).collect())) == sorted(map(tuple, trace.seek(rows, t).collect()))
        want, got = (sorted(map(tuple, stored.restored(spark, f"file://{p}", arcs, t, 100).select("lane", "v", "pred", "settled").collect()), key=str) for p in (once, twice))
        assert want == got == sorted(map(tuple, trace.restored(rows, trace.snapshots(rows, arcs, 100), arcs, t, 100).select("lane", "v", "pred", "settled").collect()), key=str)


def test_slab_files_grow_with_the_tasks(spark, sf, tmp_path):
    rows, path = catalog.event_trace(spark, sf), f"file://{tmp_path}/slabs"
    slabs.write(rows, path, 8)
    found = slabs.manifests(path)
    assert len(found) > 100 and len({s.name for s in found}) <= 8 >= slabs.read(spark, path).rdd.getNumPartitions()
    assert sorted(map(tuple, slabs.read(spark, path).collect())) == sorted(map(tuple, rows.select(*slabs.COLUMNS).collect()))


def test_predecessors_of_all_customers(spark, sf):
    """Every customer with an order of odd quantity has a predecessor in its lane, not the 25 nations alone."""
    found = table_queries.replay_predecessors(spark, sf)
    lines, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders"))
    odd = lines.filter("CAST(floor(l_quantity) AS BIGINT) % 2 = 1").join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    assert found.filter("lane >= 3").count() == odd.selectExpr("l_linenumber % 3 AS lane", "o_custkey").distinct().count() > 100
    assert found.filter("lane < 3").select("lane").distinct().count() == 3
