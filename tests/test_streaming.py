import pandas as pd

from waymark.plans import lanes
from waymark.schema import TRACE
from waymark.sources import generators
from waymark.streaming.lanes import DONE, lane_totals, read_slabs, runs_of, streamed, streaming_session, write_slabs


def test_slabs_out_of_order(spark, tmp_path):
    arcs = lanes.Arcs(40, generators.build("sparse", 40, 1)[1])
    out = lanes.run_one(arcs, "dijkstra")[0]
    frame = out.frame().assign(run_id="r", lane=1)[[c.split()[0] for c in TRACE.split(", ")]]
    n = len(frame)
    done = frame.head(1).assign(idx=n, kind=DONE, cost=0)
    cuts = [frame.iloc[n // 3 : 2 * n // 3], frame.iloc[: n // 3], done, frame.iloc[2 * n // 3 :]]
    seen = []
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, TRACE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = lane_totals(read_slabs(streaming_session(spark), str(tmp_path / "in"), 1)).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        last = seen[-1]
        if i == 0:
            assert last["applied"] == 0 and last["waiting"] == len(part)
    assert last["applied"] == n and last["complete"] and last["total"] == out.work() and last["n_settle"] == out.settled


def test_runs_hold_totals():
    frame = pd.DataFrame({"idx": [7, 3, 4, 9, 8], "kind": [0, 1, 7, 2, 0], "cost": [1, 1, 5, 2, 1]})
    assert list(runs_of(frame)) == [(3, 5, [6, 0, 1, 0, 0, 0, 0, 0, 1]), (7, 10, [4, 2, 0, 1, 0, 0, 0, 0, 0])]
    assert list(runs_of(frame.head(0))) == []


def test_a_lane_without_its_first_slab_waits(spark, tmp_path):
    rows = spark.range(300).selectExpr("'r' as run_id", "cast(id % 2 as int) as lane", "id div 2 as idx", "0 as chunk", "0 as row", "cast(id % 8 as int) as kind", *(f"-1 as {c}" for c in ("vertex", "edge", "aux0", "aux1", "aux2")), "0d as aux_f", "id as cost")
    path = f"file://{tmp_path}/slabs"
    write_slabs(rows.filter("lane = 0 or idx >= 50"), path, 20)
    got = {r["lane"]: r for r in streamed(spark, path, 3).collect()}
    assert (got[0]["applied"], got[0]["waiting"], got[0]["complete"]) == (150, 0, True)
    assert (got[1]["applied"], got[1]["waiting"], got[1]["complete"], got[1]["total"]) == (0, 100, False, 0)
    assert got[0]["cap"] == 0  # the open lane holds the clock
