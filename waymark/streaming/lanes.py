"""Lanes as streams: slabs of a trace arrive as files in any order, and each lane's totals follow its rows in order of idx.

A lane's state is two cells and a map. The cells hold where its applied rows end, their totals, and how many rows the
lane has once a row of kind DONE has said so. Rows that come early are kept in the map as runs: consecutive rows are one
entry with their totals, under the idx they begin at, so that the state grows with the gaps and not with the rows. When a
gap closes, the runs behind it are taken up one by one. A lane that is not complete can set a timer; if nothing has come
when it fires, a row says that the lane stands still. The clock may run to the least total of the lanes that are
still open (race.stream_cap), over what the stream has last said of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.operators.race import stream_cap
from waymark.schema import KINDS, TRACE
from waymark.staging import shared_folder

DONE = -1
TOTALS = "work long, " + ", ".join(f"n_{k} long" for k in KINDS)
CELL = f"next_idx long, {TOTALS}"
RUN = f"end_idx long, {TOTALS}"
OUT = f"run_id string, lane int, applied long, total long, waiting long, complete boolean, stalled boolean, " + ", ".join(f"n_{k} long" for k in KINDS)
NAMES = [c.split()[0] for c in OUT.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_slabs(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_slabs(rows: DataFrame, path: str, slab: int) -> None:
    """The trace's rows and, for each lane, the row that says how many it has, in files that follow no order of idx."""
    columns = [c.split()[0] for c in TRACE.split(", ")]
    ends = rows.groupBy("run_id", "lane").agg((F.max("idx") + 1).alias("idx"))
    marks = ends.select(*(F.col(c) if c in ends.columns else F.lit(DONE if c == "kind" else 0).cast(dict(rows.dtypes)[c]).alias(c) for c in columns))
    rows.select(*columns).unionByName(marks).repartition("run_id", F.floor(F.col("idx") / slab)).write.mode("append").parquet(path)


class LaneTotals(StatefulProcessor):
    """One lane: run_id and lane are the key. patience: milliseconds after which a lane that sends nothing is said to stand
    still; None sets no timer."""

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", CELL)
        self.rows = handle.getValueState("rows", "n long")
        self.runs = handle.getMapState("runs", "first long", RUN)

    def told(self, key: tuple, cell: list[int], stalled: bool) -> pd.DataFrame:
        n = self.rows.get()[0] if self.rows.exists() else -1
        waiting = sum(run[0] - first[0] for first, run in self.runs.iterator())
        return pd.DataFrame([(*key, cell[0], cell[1], waiting, cell[0] == n, stalled, *cell[2:])], columns=NAMES)

    def held(self, cell: list[int]) -> list[int]:
        """The cell behind the runs that now join it."""
        while self.runs.containsKey((cell[0],)):
            run = self.runs.getValue((cell[0],))
            self.runs.removeKey((cell[0],))
            cell = [run[0], *(a + b for a, b in zip(cell[1:], run[1:], strict=True))]
        return cell

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cell = [int(x) for x in self.at.get()] if self.at.exists() else [0] * (2 + len(KINDS))
        for frame in rows:
            marks = frame.loc[frame["kind"] == DONE, "idx"]
            if len(marks):
                self.rows.update((int(marks.iloc[0]),))
            for first, end, totals in runs_of(frame[(frame["kind"] != DONE) & (frame["idx"] >= cell[0])]):
                if first == cell[0]:
                    cell = self.held([end, *(a + b for a, b in zip(cell[1:], totals, strict=True))])
                elif first > cell[0]:
                    self.runs.updateValue((first,), (end, *totals))
        cell = self.held(cell)
        self.at.update(tuple(cell))
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not (self.rows.exists() and self.rows.get()[0] == cell[0]):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self.told(key, cell, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.told(key, [int(x) for x in self.at.get()], True)

    def close(self) -> None:
        pass


def runs_of(frame: pd.DataFrame) -> Iterator[tuple[int, int, list[int]]]:
    """(first idx, idx behind the last, totals) of each stretch of consecutive rows."""
    frame = frame.sort_values("idx")
    idx, kind, cost = (frame[c].to_numpy(np.int64) for c in ("idx", "kind", "cost"))
    for part in np.split(np.arange(len(idx)), np.flatnonzero(np.diff(idx) != 1) + 1):
        if len(part):
            yield int(idx[part[0]]), int(idx[part[-1]]) + 1, [int(cost[part].sum()), *np.bincount(kind[part], minlength=len(KINDS)).tolist()]


def lane_totals(slabs: DataFrame, mode: str = "update", patience: int | None = None) -> DataFrame:
    """run_id, lane, rows applied, billed total, rows waiting, complete, stalled, and the counts by kind, after each batch
    that brought rows of the lane. The session's state store must be RocksDB (see streaming_session). A slab comes once. patience is for streams that run on: a query
    that is to end when all is read must not wait for timers."""
    grouped = slabs.select("run_id", "lane", "idx", "kind", "cost").groupBy("run_id", "lane")
    return grouped.transformWithStateInPandas(LaneTotals(patience), OUT, mode, "none" if patience is None else "processingTime")


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that lane_totals needs; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def streamed(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """What the stream of all slabs under path says last of each lane, and `cap`, to where the shared clock may run."""
    own, out, state = streaming_session(spark), shared_folder(spark, "lanes"), shared_folder(spark, "state")
    sink = lane_totals(read_slabs(own, path, files_per_trigger), "append").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    query = sink.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    said = spark.read.schema(OUT).parquet(out)
    last = said.groupBy("run_id", "lane").agg(F.max_by(F.struct(*NAMES[2:]), F.struct("applied", "complete")).alias("l")).select("run_id", "lane", "l.*")
    return last.join(F.broadcast(stream_cap(last)), F.lit(True))  # one row
