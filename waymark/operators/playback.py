"""Playing lanes: a clock, a position in each lane's trace, and steps by operation or by event. The state is the clock's;
rows are queries over the staged prefix of each lane."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.race import WorkClock
from waymark.operators.trace import work_after
from waymark.staging import stage


def checked(t: float) -> float:
    if not math.isfinite(t) or t < 0:
        raise ValueError("the clock's position must be finite and not negative")
    return t


class Playback:
    """One lane. Work after each row is computed once and staged in the shared folder; seeks read aggregates of it."""

    def __init__(self, trace: DataFrame, complete: bool = True, speed: float = 1.0):
        self.rows = stage(work_after(trace), "playback")
        self.clock, self.complete, self.position = WorkClock(speed), complete, 0
        self.measure()

    def measure(self) -> None:
        r = self.rows.agg(F.coalesce(F.max("work_after"), F.lit(0)).alias("w"), F.count("*").alias("n")).first()
        self.total_work, self.total_events = r["w"], r["n"]

    def append(self, slab: DataFrame) -> None:
        """Further rows of the lane; the position stays."""
        shifted = work_after(slab).withColumn("work_after", F.col("work_after") + self.total_work)
        self.rows = stage(self.rows.unionByName(shifted.select(*self.rows.columns)), "playback")
        self.measure()

    def begin_streaming(self) -> None:
        self.complete = False

    def mark_complete(self) -> None:
        self.complete = True
        if self.clock.cursor >= self.total_work:
            self.clock.pause()

    def play(self) -> None:
        self.clock.play()

    def pause(self) -> None:
        self.clock.pause()

    def seek(self, t: float) -> int:
        """How many rows are applied at t, no further than the lane's end."""
        self.clock.seek(min(checked(t), self.total_work))
        self.position = self.rows.filter(F.col("work_after") <= self.clock.cursor).count()
        return self.position

    def advance(self, seconds: float) -> int:
        """Move with the clock; at the end of a complete lane the clock stops."""
        if not math.isfinite(seconds) or seconds < 0:
            raise ValueError("time must be finite and not negative")
        self.clock.advance(seconds)
        over = self.clock.cursor > self.total_work
        found = self.seek(self.clock.cursor)
        if over and self.complete:
            self.clock.pause()
        return found

    def step_event(self) -> int:
        """Apply the next row, whatever it costs; the clock follows."""
        row = self.rows.filter(F.col("idx") == self.position).select("work_after").first()
        if row is not None:
            self.clock.seek(row["work_after"])
            self.position += 1
        return self.position

    def step_op(self) -> int:
        """One billed operation on: a row of cost k is applied by the kth."""
        return self.seek(min(self.clock.cursor + 1, self.total_work))

    @property
    def applied(self) -> DataFrame:
        return self.rows.filter(F.col("idx") < self.position)


class Scheduler:
    """Lanes on one clock, which runs no further than the slowest incomplete lane has come."""

    def __init__(self, lanes: list[Playback]):
        self.lanes, self.clock = lanes, WorkClock()

    @property
    def all_complete(self) -> bool:
        return all(x.complete for x in self.lanes)

    @property
    def longest(self) -> float:
        return max((x.total_work for x in self.lanes), default=0)

    @property
    def cap(self) -> float:
        return min((x.total_work for x in self.lanes if not x.complete), default=self.longest)

    @property
    def applied_cursor(self) -> float:
        return min(self.clock.cursor, self.cap)

    @property
    def settle_all_finished(self) -> bool:
        return self.all_complete and self.applied_cursor >= self.longest

    def sync(self) -> list[int]:
        return [x.seek(self.applied_cursor) for x in self.lanes]

    def seek(self, t: float) -> list[int]:
        self.clock.seek(min(checked(t), self.longest) if self.all_complete else checked(t))
        return self.sync()

    def step_op(self) -> list[int]:
        return self.seek(min(self.clock.cursor + 1, self.longest if self.all_complete else self.cap))

    def step_event(self) -> list[int]:
        """To the nearest next row that costs something, in any lane."""
        at = self.applied_cursor
        ahead = [x.rows.filter(F.col("work_after") > at).agg(F.min("work_after")).first()[0] for x in self.lanes]
        found = [w for w in ahead if w is not None]
        return self.seek(min(found)) if found else self.sync()
