import heapq
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.prng import Draws, draw
from waymark.operators import bands, prefix, race, reduce, scene, sssp, trace
from waymark.plans import lanes, specs, sweeps
from waymark.schema import TRACE
from waymark.sources import generators, graphs
from waymark.staging import keep

#: Small graphs with their distances from vertex 0; None is unreachable.
CASES = {
    "chain-3": ("0>1:1 1>2:1", [0, 1, 2]), "cycle-4": ("0>1:1 1>2:1 2>3:1 3>0:1", [0, 1, 2, 3]), "diamond-equal-weight": ("0>1:1 0>2:1 1>2:1 1>3:1 2>3:1", [0, 1, 1, 2]),
    "layered-dag": ("0>1:1 0>2:4 1>3:2 1>4:1 2>4:1 2>5:3 3>6:1 4>6:2 4>7:1 5>7:2 6>8:1 7>8:1", [0, 1, 4, 3, 2, 7, 4, 3, 4]), "sparse-8": ("0>2:4 0>5:1 1>3:2 2>4:1 3>6:5 4>7:2 5>6:3 6>7:1", [0, None, 4, None, 5, 1, 4, 5]),
    "six": ("0>1:2 0>2:3 1>3:2 2>3:2 3>4:1 1>5:10", [0, 2, 3, 4, 5, 12]),
}


def arcs_of(text):
    return [(int(a.split(">")[0]), int(a.split(">")[1].split(":")[0]), float(a.split(":")[1])) for a in text.split()]


@pytest.mark.parametrize("name", list(CASES))
def test_small_graphs(spark, name):
    text, want = CASES[name]
    edges = spark.createDataFrame(arcs_of(text), "src long, dst long, w double")
    got = {r["v"]: r["dist"] for r in sssp.distances(edges, 0).collect()}
    assert got == {v: d for v, d in enumerate(want) if d is not None}


def test_labels_prefer_fewer_arcs_then_smaller_tails(spark):
    edges = spark.createDataFrame(arcs_of("0>1:1 0>2:1 1>2:1 2>1:1 1>3:1 2>3:1 0>3:2"), "src long, dst long, w double")
    got = {r["v"]: (r["label"]["length"], r["label"]["n_edges"], r["label"]["pred"]) for r in sssp.labels(edges, 0).collect()}
    assert got == {0: (0, 0, -1), 1: (1, 1, 0), 2: (1, 1, 0), 3: (2, 1, 0)}


def test_fixture_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "n": 3, "edges": [{"from": 0, "to": 1, "weight": 2}], "source": 0, "distances": [0, 2, None]}))
    arcs, want = graphs.read_fixture(spark, str(tmp_path))
    assert [(r["src"], r["dst"], r["w"]) for r in arcs.collect()] == [(0, 1, 2.0)]
    assert [(r["v"], r["dist"]) for r in want.orderBy("v").collect()] == [(0, 0.0), (1, 2.0), (2, None)]


def test_checks(spark):
    vertices = spark.range(3).select(F.col("id").alias("v"))
    good = spark.createDataFrame([(2, 0, 1.0), (0, 1, 0.0), (0, 2, 3.0)], "src long, dst long, w double")
    assert [(r["e"], r["src"], r["dst"]) for r in graphs.checked(vertices, good).orderBy("e").collect()] == [(0, 0, 1), (1, 0, 2), (2, 2, 0)]
    for bad in ((1, 1, 1.0), (0, 9, 1.0), (0, 1, 2.0), (1, 2, -1.0), (1, 2, float("nan")), (1, 2, float("inf"))):
        with pytest.raises(ValueError):
            graphs.checked(vertices, good.union(spark.createDataFrame([bad], good.schema)))


def test_draws_agree(spark):
    own = list(itertools.islice(Draws(12345), 50))
    assert [r[0] for r in spark.range(1, 51).orderBy("id").select(draw(F.lit(12345), F.col("id"))).collect()] == own


def test_generated_graphs_agree(spark):
    got = {(r["src"], r["dst"]): r["w"] for r in generators.adversarial_arcs(spark, 60, 9).collect()}
    assert got == {(a, b): w for a, b, w in generators.adversarial(60, 9)[1]}
    assert generators.generate(spark, [("sparse", 20, 1), ("maze", 20, 1)]).groupBy("kind").count().orderBy("kind").collect() == [("maze", 38), ("sparse", 40)]


def test_running_in_slabs(spark):
    random.seed(4)
    rows = [(i % 2, i, random.randrange(-5, 6), random.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "lane int, idx long, x long, y long").repartition(5)
    wanted = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "n": ("min", F.col("x")), "l": ("last", F.col("y"))}
    for inclusive in (True, False):
        got = {r["idx"]: (r["s"], r["m"], r["n"], r["l"]) for r in prefix.running(df, ["lane"], "idx", wanted, inclusive, slab=37).collect()}
        for lane in (0, 1):
            seen, last = [], None
            for _, idx, x, y in (r for r in rows if r[0] == lane):
                if inclusive:
                    seen, last = [*seen, x], y if y is not None else last
                assert got[idx] == (sum(seen), max(seen, default=None), min(seen, default=None), last)
                if not inclusive:
                    seen, last = [*seen, x], y if y is not None else last


@pytest.fixture(scope="module")
def lane(spark):
    arcs = lanes.Arcs(60, generators.build("clusters", 60, 2)[1])
    out, dist, pred = lanes.run_one(arcs, "dijkstra")
    frame = out.frame().assign(run_id="r", lane=0)[[c.split()[0] for c in TRACE.split(", ")]]
    edges = spark.createDataFrame([(e, arcs.src[e], arcs.dst[e], arcs.w[e]) for e in range(len(arcs.dst))], "e int, src long, dst long, w double")
    return spark.createDataFrame(frame, TRACE), edges, dist, pred, out


def test_replay(lane):
    rows, edges, dist, pred, out = lane
    assert {r["v"]: r["pred"] for r in trace.replayed(rows, edges).collect()} == {v: p for v, p in enumerate(pred) if p >= 0}
    assert trace.frontier(rows, edges).count() == 0
    assert rows.agg(F.sum("cost")).first()[0] == out.work() == trace.tally(rows).first()["work"]
    assert trace.seek(rows, out.work()).first()["position"] == len(out.rows)
    assert trace.settle_records(rows).count() == 60
    assert trace.next_boundary(rows, out.work()).first()["next_work"] is None


def test_settles_stand_in_order(spark, lane):
    rows, _, dist, _, _ = lane
    found = spark.createDataFrame(list(enumerate(dist)), "vertex int, dist double")
    settles = rows.filter("kind = 1").select("lane", "idx", "vertex").join(found, "vertex")
    assert trace.out_of_order(settles).count() == 0


def test_codec_refuses_unknown_kinds(spark, lane):
    rows = lane[0]
    assert trace.encode(trace.decode(rows)).select("idx", "kind", "aux0", "cost").exceptAll(rows.select("idx", "kind", "aux0", "cost")).count() == 0
    with pytest.raises(Exception, match="unknown"):
        trace.decode(rows.withColumn("kind", F.lit(9))).collect()


def test_schematic_overflow(spark):
    ops = [(0, 7, i, 0, 10 + i) for i in range(5)] + [(0, 7, 5, 1, 99), (0, 7, 6, 2, 2)]
    df = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in ops], "lane int, kind int, idx long, aux0 int, aux1 int")
    assert trace.schematic(df, 3).first()["strip"] == [13]


def test_reduction_keeps_distances(spark):
    arcs = generators.build("clusters", 60, 3)[1]
    edges = spark.createDataFrame(arcs, "src long, dst long, w double")
    small, owners = reduce.reduced(edges, 5)
    out = small.groupBy("src").count().agg(F.max("count")).first()[0]
    assert out <= 3 + 1
    want = {r["v"]: r["dist"] for r in sssp.distances(edges, 0).collect()}
    got = {r["v"]: r["dist"] for r in reduce.distances_by_reduction(edges, 0, 5).collect()}
    assert got == want


def test_rankings(spark):
    rows = lambda *w: spark.createDataFrame([(i, f"L{i}", x) for i, x in enumerate(w)], "lane int, label string, work double")
    order = lambda df: [r["lane"] for r in race.ranked(df).orderBy("place").collect()]
    assert order(rows(139608.0, 237827.0)) == [0, 1] and order(rows(48210.0, 31077.0)) == [1, 0] and order(rows(50000.0, 31077.0, 42000.0)) == [1, 2, 0] and order(rows(100.0, 100.9)) == [0, 1]
    assert race.banner(rows(48210.0, 31077.0)).first()["text"] == "L1 beat L0 by 17,133 comparisons on this graph. (L0: 48,210; L1: 31,077)"


def test_clock():
    clock = race.WorkClock(2)
    assert clock.advance(1) == 0
    clock.play()
    assert clock.advance(0.5) == 20_000 and clock.advance(5, 50_000) == 50_000
    with pytest.raises(ValueError):
        clock.seek(float("nan"))


def test_specs():
    race_spec = specs.read("?g=maze&n=500&seed=0&race=dmsy,dijkstra&target=3&t=2.5&bk=x&dt=4")
    assert (race_spec.g, race_spec.n, race_spec.seed, race_spec.target, race_spec.t, race_spec.bk, race_spec.dt) == ("maze", 500, 0, 3, 2.5, None, 4)
    assert specs.read(specs.write(race_spec)) == race_spec and specs.read("?g=?&n=-3&t=nan") == specs.Race()
    with pytest.raises(ValueError):
        specs.write(specs.Race(g="torus"))


def test_sweep_table(spark, tmp_path):
    cells = sweeps.kt_sweep(spark, ("sparse",), (60,), (0,), (2, 4), (2,))
    sweeps.write_table(cells, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()
    assert len(back) == 2 and all(len(r["ratio"].split(".")[1]) == 4 for r in back)
    assert set(sweeps.timed(spark, "maze", 60, 1)) == {"dijkstra", "bounded", "forest"}


def test_scene(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 1.0), (2, 1.0, 1.0)], "v long, x double, y double")
    r = scene.camera(vertices, 100, 80).first()
    assert r["scale"] == 50 and r["radius"] == 4
    assert scene.grid(vertices, 2).agg(F.sum("n")).first()[0] == 3


def settled(arcs, source, bound=None):
    """Least (length, arcs, predecessor) of every vertex, by a heap."""
    out, heap = {}, [(0, 0, -1, source)]
    while heap:
        length, n, pred, v = heapq.heappop(heap)
        if v not in out:
            out[v] = (length, n, pred)
            for a, b, w in arcs:
                if a == v and (bound is None or length + w < bound):
                    heapq.heappush(heap, (length + w, n + 1, v, b))
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_rounds_against_a_heap(spark, monkeypatch, chunk):
    """Distances, bounded distances, hops and labels, also where lists are cut."""
    monkeypatch.setattr(sssp, "CHUNK", chunk)
    floats = generators.build("clusters", 120, 5)[1]
    whole = [(a, b, int(w) % 3) for a, b, w in generators.build("sparse", 150, 2)[1]]
    for arcs, kind in ((floats, "double"), (whole, "long")):
        edges = spark.createDataFrame(arcs, f"src long, dst long, w {kind}")
        want = settled(arcs, 0)
        assert {r["v"]: r["dist"] for r in sssp.distances(edges, 0).collect()} == {v: x[0] for v, x in want.items()}
        assert {r["v"]: r["dist"] for r in sssp.distances(edges, 0, 40).collect()} == {v: x[0] for v, x in settled(arcs, 0, 40).items()}
        assert {r["v"]: r["hops"] for r in sssp.reachable(edges, 0).collect()} == {v: x[0] for v, x in settled([(a, b, 1) for a, b, _ in arcs], 0).items()}
        got = {r["v"]: (r["length"], r["n_edges"], r["pred"]) for r in sssp.labels(edges, 0).select("v", "label.length", "label.n_edges", "label.pred").collect()}
        assert got == want


def test_a_hub_is_cut_into_lists(spark, monkeypatch):
    monkeypatch.setattr(sssp, "CHUNK", 100)
    edges = spark.range(1, 2001).selectExpr("0L as src", "id as dst", "id % 7 as w")
    lists = sssp.listed(edges).collect()
    assert len(lists) == 20 and max(len(r["arcs"]) for r in lists) < 200
    assert sssp.distances(edges, 0).count() == 2001


def test_long_chains(spark):
    arcs = spark.range(30).selectExpr("id as src", "id + 1 as dst", "1L as w")
    assert sorted(map(tuple, sssp.distances(arcs, 0).collect())) == [(i, i) for i in range(31)]
    assert [tuple(r) for r in sssp.distances(arcs.limit(0), 5).collect()] == [(5, 0)]


def test_a_round_exchanges_once_and_reads_lists_in_place(spark):
    lists, name = sssp.bucketed(sssp.listed(spark.range(2000).selectExpr("id as src", "id % 7 as dst", "1L as w")), "tail", "part")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = keep(spark.range(1).selectExpr("0L as v", "0 as part", "0L as best", "true as changed"), "state")
        plan = spark.sql(sssp.rounds(f"parquet.`{start}`", name, 2))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Bucketed: true") == 2 and text.count("Exchange hashpartitioning") == 3  # the start, and each round's candidates
    sssp.dropped(lists, name)


def test_path_by_doubling(spark):
    preds = spark.createDataFrame([(0, -1), *((i, i - 1) for i in range(1, 40)), (50, 51), (51, 50)], "v long, pred long")
    assert sssp.gold_path(preds, 0, 37) == list(range(38))
    assert sssp.gold_path(preds, 0, 0) == [0] and sssp.gold_path(preds, 60, 5) == []
    with pytest.raises(ValueError):
        sssp.gold_path(preds, 0, 50)


def test_predecessors_come_back_from_rings(spark):
    edges = spark.createDataFrame([(a, b, float(w)) for a, b, w in generators.build("clusters", 40, 7)[1]], "src long, dst long, w double")
    arcs, owners = reduce.reduced(edges, 5)
    start = owners.filter("v = 0").agg(F.min("copy")).first()[0]
    back = {r["v"]: (r["dist"], r["pred"]) for r in reduce.mapped_back_predecessors(sssp.labels(arcs, start), owners).collect()}
    dist = {r["v"]: r["dist"] for r in sssp.distances(edges, 0).collect()}
    weight = {(r["src"], r["dst"]): r["w"] for r in edges.collect()}
    assert {v: d for v, (d, _) in back.items()} == dist and back[0][1] == -1
    assert all(dist[p] + weight[p, v] == d for v, (d, p) in back.items() if v)


def test_no_rounds_run_behind_the_last_where_rounds_are_long(spark, monkeypatch):
    """A chain of three arcs takes four rounds, the last of which changes nothing; each reads the lists near what changed."""
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (2, 3, 2), (8, 9, 1)], "src long, dst long, w long")
    asked, rounds = [], sssp.rounds
    monkeypatch.setattr(sssp, "MANY_ARCS", 0)
    monkeypatch.setattr(sssp, "JOB_S", 0.0)
    monkeypatch.setattr(sssp, "rounds", lambda state, lists, n, bound, within: asked.append((n, within)) or rounds(state, lists, n, bound, within))
    assert {r["v"]: r["dist"] for r in sssp.distances(edges, 0).collect()} == {0: 0, 1: 2, 2: 4, 3: 6}
    assert asked == [(1, (v, v)) for v in range(4)]


def test_rings_are_crossed_by_shortcuts(spark, monkeypatch, tmp_path):
    """One hub with 399 neighbours: a ring of 67 copies, crossed in few rounds; labels as without shortcuts."""
    from waymark.plans import lane_queries

    users = [x for k in range(1, 400) for x in (0, k)]
    events = spark.createDataFrame([(i, u, float(i % 7)) for i, u in enumerate(users)], "event_id long, user_id long, value double")
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    asked, rounds = [], sssp.rounds
    monkeypatch.setattr(sssp, "rounds", lambda state, lists, n, *more: asked.append(n) or rounds(state, lists, n, *more))
    found = lane_queries.mapback_predecessors(spark, f"file://{tmp_path}").collect()
    assert len(found) == 400 and all(r["tight"] for r in found) and sum(asked) <= 40
    edges = spark.createDataFrame([(a, b, w) for k in range(1, 40) for a, b, w in ((0, k, k % 3), (k, 0, 1))], "src long, dst long, w long")
    for kind in ("long", "double"):
        arcs, owners = reduce.reduced(edges.withColumn("w", F.col("w").cast(kind)), 4)
        want = sorted(map(tuple, sssp.labels(arcs, 0).select("v", "label.*").collect()))
        assert want == sorted(map(tuple, sssp.labels(arcs, 0, reduce.ring_shortcuts(owners)).select("v", "label.*").collect()))


def test_long_searches_go_region_by_region(spark, monkeypatch):
    """A chain of copies of a graph takes a few steps, not a round an arc; least values also where hubs are cut."""
    from waymark.operators import regions

    clusters = generators.build("clusters", 40, 7)[1]
    chain = [(a + 40 * k, b + 40 * k, 1 + int(10 * w)) for k in range(4) for a, b, w in clusters] + [(40 * k + 39, 40 * k + 40, 1) for k in range(3)]
    monkeypatch.setattr(regions, "LEAST", 64)
    monkeypatch.setattr(regions, "MOST", 2 * len(clusters))
    taken, asked, keep = [], [], regions.keep
    monkeypatch.setattr(regions, "keep", lambda df, name: taken.append(name) or keep(df, name))
    monkeypatch.setattr(sssp, "rounds", lambda *more: asked.append(more))
    for kind, unit, bound, chunk in (("long", 1, None, 4096), ("double", 0.1, 2.0, 8)):
        monkeypatch.setattr(sssp, "CHUNK", chunk)
        edges = spark.createDataFrame([(a, b, w * unit) for a, b, w in chain], f"src long, dst long, w {kind}")
        want, moved = {0: 0 * unit}, True
        while moved:
            moved = False
            for a, b, w in chain:
                if a in want and (bound is None or want[a] + w * unit < bound) and want[a] + w * unit < want.get(b, math.inf):
                    want[b], moved = want[a] + w * unit, True
        assert {r["v"]: r["best"] for r in sssp.fixpoint(edges, sssp.from_one(edges, 0), bound, 0).collect()} == want
        assert bound or len(want) == 160 and 4 <= len(taken) <= 12
    assert not asked


def test_the_tight_forest_holds_every_vertex_reached(spark, tmp_path):
    """A path of purchases of 9 each, far beyond a distance of 4: every vertex but the source has its parent."""
    from waymark.plans import catalog

    spark.createDataFrame([(k, 1 + k // 2) for k in range(6)], "o_orderkey long, o_custkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    lines = [(k, 1 + (k + 1) // 2, 9.0) for k in range(6)]  # customer 1, supplier 1, customer 1, supplier 2, customer 2...
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    found = {r["v"]: r["parent"] for r in catalog.tight_forest_parent(spark, f"file://{tmp_path}").collect()}
    assert found == {3: 2, 5: 2, 4: 5, 7: 4, 6: 7, 9: 6}


def test_what_names_no_vertex_or_arc_passes_the_way_back(spark):
    rows = spark.createDataFrame([(0, 0, 1, 4, -1), (0, 1, 1, 5, -1), (0, 2, 0, -1, 8), (0, 3, 0, -1, 9), (0, 4, 2, -1, -1)], "lane int, idx long, kind int, vertex int, edge int")
    owners = spark.createDataFrame([(4, 1), (5, 1)], "copy int, orig int")
    assert sorted((r["idx"], r["orig"]) for r in reduce.unmapped(rows, owners).collect()) == [(0, 1), (2, -1), (3, -1), (4, -1)]
    origins = spark.createDataFrame([(8, 3), (9, None)], "edge int, orig_edge int")
    assert sorted((r["idx"], r["edge"]) for r in reduce.unmapped_arcs(rows, origins).collect()) == [(0, -1), (1, -1), (2, 3), (4, -1)]


def test_playback_streams_and_steps(spark, lane):
    from waymark.operators.playback import Playback, Scheduler

    rows, out = lane[0], lane[4]
    half = len(out.rows) // 2
    costs = [r[-1] for r in out.rows]
    player = Playback(rows.filter(F.col("idx") < half), complete=False)
    player.play()
    assert player.advance(1000) == half and player.clock.playing and player.total_work == sum(costs[:half])
    player.append(rows.filter(F.col("idx") >= half))
    assert player.position == half and player.total_work == out.work()
    assert player.step_event() == half + 1 and player.clock.cursor == sum(costs[: half + 1])
    player.mark_complete()
    assert player.advance(1000) == len(costs) and not player.clock.playing and player.step_event() == len(costs)
    assert player.seek(0) == next(i for i, c in enumerate(costs) if c) and player.applied.count() == player.position
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            player.seek(bad)
    both = Scheduler([Playback(rows), Playback(rows.filter(F.col("idx") < half), complete=False)])
    both.seek(10**9)
    assert both.cap == both.applied_cursor == sum(costs[:half]) and not both.settle_all_finished
    both.lanes[1].mark_complete()
    assert both.seek(10**9) == [len(costs), half] and both.settle_all_finished and both.step_event() == [len(costs), half]


def test_forest_lane_comes_back_from_the_reduced_graph(spark):
    from waymark.kernels import dijkstra, reduction
    from waymark.kernels.record import Arcs, Recorder
    from waymark.plans.lanes import run_one

    arcs = Arcs(120, generators.build("clusters", 120, 9)[1])
    small = reduction.reduced(arcs)
    assert small is not None and max(len(small.arcs.of(v)) for v in range(small.arcs.n)) <= 3
    out, dist, pred = run_one(arcs, "dmsy")
    want = dijkstra.run(arcs, 0, Recorder())[0]
    weight = dict(zip(zip(arcs.src, arcs.dst, strict=True), arcs.w, strict=True))
    assert dist == want and pred[0] == -1 and all(dist[pred[v]] + weight[pred[v], v] == dist[v] for v in range(1, arcs.n))
    settles = [r[1] for r in out.rows if r[0] == 1]
    assert sorted(settles) == list(range(arcs.n)) and all(r[2] < len(arcs.src) for r in out.rows)
    # what the improving relaxations leave behind
    replayed = {0: 0.0}
    for r in out.rows:
        if r[0] == 0 and r[3] == 1:
            replayed[arcs.dst[r[2]]] = replayed[arcs.src[r[2]]] + arcs.w[r[2]]
    assert [replayed[v] for v in range(arcs.n)] == want
    with pytest.raises(ValueError):
        run_one(arcs, "astar")
    with pytest.raises(ValueError):
        run_one(arcs, "bmssp", 120)


def test_a_race_read_from_a_query_runs(spark):
    from waymark.plans import lanes

    rows = lanes.race(spark, specs.read("?g=maze&n=60&seed=1&race=dijkstra,bmssp,dmsy&bk=3"))
    assert {r["lane"]: r["n"] for r in rows.filter("kind = 1").groupBy("lane").agg(F.count("*").alias("n")).collect()} == {0: 60, 1: 60, 2: 60}


def test_codecs_and_exports():
    lens = specs.read_lens("?g=maze&n=500&seed=-1&algo=dmsy&bmssp=paper&dk=4")
    assert specs.read_lens(specs.write_lens(lens)) == lens and specs.read_lens("?n=0.5&seed=x&bk=-1") == specs.Lens()
    story = specs.read_story("?mode=story&step=forest&t=12")
    assert specs.read_story(specs.write_story(story)) == story and specs.is_story("?mode=story") and not specs.is_story("?mode=demo")
    race_spec = specs.Race(t=5.0)
    assert specs.share_url(race_spec, "https://example.org/") == "https://example.org/?g=sparse&n=25000&seed=4&race=dijkstra,bmssp"
    assert specs.export_name(race_spec, "png") == "waymark-sparse-25000-seed-4.png" and specs.export_caption(race_spec, "u") == ("seed=4", "u")
    assert specs.can_export(False, True) and not specs.can_export(False) and 0 <= specs.roll_seed() < 2**32 and specs.size_of("XL", "maze") == 100_000
    for bad in (lambda: specs.write_lens(specs.Lens(algo="x")), lambda: specs.write_story(specs.Story(t=-1)), lambda: specs.size_of("XL", "city")):
        with pytest.raises(ValueError):
            bad()


def test_sweep_writers(spark, tmp_path):
    cells = sweeps.kt_sweep(spark, ("sparse",), (60,), (0,), (2,), ("paper", "k2"), "forest")
    text = sweeps.markdown(cells, "Sweep")
    assert text.startswith("# Sweep\n\n| kind | n |") and len(text.splitlines()) == 4 + cells.count()
    sweeps.wall_clock(spark, [("maze", 30, 0)], str(tmp_path / "wall"))
    row = sweeps.read_wall_clock(spark, str(tmp_path / "wall")).first()
    assert set(row["wall_ms"]) == set(row["work"]) == {"dijkstra", "bounded", "forest"} and row["generated_at"] is not None


def test_trace_benches(spark, lane):
    from waymark.plans import trace_bench

    found, took = trace_bench.write_and_scan(spark, 8000)
    assert found.first()["n_pivot"] == 1000 and took > 0
    assert set(trace_bench.replay(lane[0])) == {"end", "back", "frame"}


def test_audits_see_what_is_broken(spark):
    from waymark.operators import audits

    rows = [(0, i, k, v, e, a0, a1, a2, f) for i, (k, v, e, a0, a1, a2, f) in enumerate([
        (5, -1, -1, 0, 1, -1, 9.0), (2, -1, -1, 0, 1, -1, 0.0), (7, -1, -1, 2, 3, 1, 0.0), (1, 4, -1, 0, -1, -1, 0.0), (1, 4, -1, 1, -1, -1, 0.0), (4, -1, -1, 0, 0, 1, 0.0), (4, -1, -1, 0, 0, 1, 0.0),
        (6, -1, 3, 1, 0, -1, 0.0), (6, -1, 3, 1, 1, -1, 0.0), (0, -1, 99, 0, -1, -1, 0.0), (5, -1, -1, 0, 0, -1, 2.0), (2, -1, -1, 0, 1, -1, 0.0), (1, 5, -1, 2, -1, -1, 0.0), (5, -1, -1, 1, 0, -1, 2.0), (1, 6, -1, 3, -1, -1, 0.0),
    ])]
    df = spark.createDataFrame(rows, "lane int, idx long, kind int, vertex int, edge int, aux0 int, aux1 int, aux2 int, aux_f double")
    dist = spark.createDataFrame([(0, 4, 5.0), (0, 5, 3.0), (0, 6, 8.0)], "lane int, v long, dist double")
    ids = lambda x: sorted(r["idx"] for r in x.collect())
    assert ids(audits.heap_levels(df)) == [1] and ids(audits.pull_sizes(df, 1)) == [2] and ids(audits.settled_once(df)) == [4]
    assert ids(audits.batches(df, 10, 50)) == [6, 9] and ids(audits.cut_groups(df)) == [7] and ids(audits.nesting(df)) == [0]
    assert ids(audits.bounded_settles(df, dist)) == [12] and ids(audits.settle_order(df, dist)) == [12]
    calls = {(r["entered"], r["left"], r["depth"]) for r in audits.matched_calls(df).collect()}
    assert calls == {(0, None, 1), (10, 13, 2)}


def plain_distances(rows, start):
    best = dict(start)
    while True:
        new = dict(best)
        for a, b, w in rows:
            if a in new and new[a] + w < new.get(b, 10**9):
                new[b] = new[a] + w
        if new == best:
            return best
        best = new


def test_arcs_that_cannot_matter_are_left_out(spark, monkeypatch):
    """With a bound by their weight, without one by the values that the lightest arcs give; the distances stay."""
    rng = np.random.default_rng(11)
    rows = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 60, 900), rng.integers(0, 60, 900), rng.integers(0, 50, 900), strict=True)]
    rows += [(5, 100, 49), (100, 101, 0), (101, 102, 50), (200, 201, 1)]  # found by heavy arcs only, and not at all
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    start = spark.createDataFrame([(5, 0), (7, 2)], "v long, best long")
    taken = []
    monkeypatch.setattr(sssp, "listed", lambda e, old=sssp.listed: (taken.append(e.count()), old(e))[1])
    want = plain_distances(rows, [(5, 0), (7, 2)])
    assert {r["v"]: r["best"] for r in sssp.relaxed(edges, start, 6).collect()} == {v: d for v, d in want.items() if d < 6}
    assert taken.pop() == sum(w < 6 for _, _, w in rows)
    monkeypatch.setattr(sssp, "MANY_ARCS", 0)
    assert {r["v"]: r["best"] for r in sssp.relaxed(edges, start).collect()} == want
    assert len(taken) == 2 and sum(taken) < len(rows)
    steps = edges.withColumn("w", F.lit(1).cast("long"))
    assert {r["v"]: r["best"] for r in sssp.relaxed(steps, start).collect()} == plain_distances([(a, b, 1) for a, b, _ in rows], [(5, 0), (7, 2)])
    monkeypatch.setattr(bands, "listed", sssp.listed)
    taken.clear()
    one = spark.createDataFrame([(5, 5)], "source long, v long")
    assert {r["v"]: r["dist"] for r in bands.distances(edges, one, 6, 2).collect()} == {v: d for v, d in plain_distances(rows, [(5, 0)]).items() if d < 6}
    assert taken == [sum(w < 6 for _, _, w in rows)]


def test_tables_that_grow_are_not_broadcast(spark):
    rows = spark.range(100).selectExpr("CAST(id % 3 AS INT) AS lane", "id AS idx", "id AS value")
    plan = prefix.running(rows, ["lane"], "idx", {"least": ("min", F.col("value"))}, slab=8)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    dist = spark.createDataFrame([(1, 0)], "v long, dist long")
    plan = reduce.mapped_back(dist, spark.createDataFrame([(1, 2)], "copy long, v long"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
