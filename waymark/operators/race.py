"""Lanes on one clock: caps, rankings, differences, banners and narration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stream_cap(lanes: DataFrame) -> DataFrame:
    """lanes(lane, total, complete): one row, how far the clock may go: the least total of those still running, or the greatest."""
    running = F.min(F.when(~F.col("complete"), F.col("total")))
    return lanes.agg(F.coalesce(running, F.max("total")).alias("cap"))


def photo_cap(lanes: DataFrame, applied: int) -> DataFrame:
    """lane, target: each lane stops at the clock, its end, or the settling of the finish, whichever is first."""
    return lanes.select("lane", F.least(F.lit(applied).cast("long"), F.col("total"), F.col("settle_work")).alias("target"))


def ranked(lanes: DataFrame) -> DataFrame:
    """lane, place: by whole work, ties in the lanes' order."""
    return lanes.select("lane", F.row_number().over(Window.orderBy(F.floor("work"), "lane")).alias("place"))  # a row per lane


def best_in_class(lanes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """lane, and for each counter whether it is the least of all lanes; with one lane all false."""
    everyone = Window.partitionBy(F.lit(1))
    several = F.count("*").over(everyone) > 1
    return lanes.select("lane", *((several & (F.col(c) == F.min(c).over(everyone))).alias(f"best_{c}") for c in columns))


def settle_lead(lanes: DataFrame) -> DataFrame:
    """leader, margin: the lane with most settled, if it is alone in front; else no row."""
    top = lanes.orderBy(F.desc("settled"), "lane").limit(2).agg(F.sort_array(F.collect_list(F.struct("settled", (-F.col("lane")).alias("o"))), asc=False).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return top.filter(second.isNotNull() & (first["settled"] > second["settled"])).select((-first["o"]).alias("leader"), (first["settled"] - second["settled"]).alias("margin"))


def settle_diff(left: DataFrame, right: DataFrame, vertices: DataFrame) -> DataFrame:
    """v, side: 0 settled by neither, 1 left, 2 right, 3 both."""
    a, b = left.select("v", F.lit(1).alias("a")), right.select("v", F.lit(2).alias("b"))
    return vertices.select("v").join(a, "v", "left").join(b, "v", "left").select("v", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).cast("long").alias("side"))


def grouped(number: Column) -> Column:
    return F.format_number(number.cast("long"), 0)


#: What the banners say behind the number.
TO_TARGET, SETTLE_ALL = "comparisons on this graph.", "comparisons on the settle-all work clock."


def banner(lanes: DataFrame, settle_all: bool = False) -> DataFrame:
    """One row, text: who beat whom by how many comparisons, then all totals in the lanes' order. Lanes are few; with
    fewer than two it raises."""
    rows = lanes.select("lane", "label", F.floor("work").alias("work"))
    all_rows = rows.agg(F.sort_array(F.collect_list(F.struct("work", "lane", "label"))).alias("r"), F.sort_array(F.collect_list(F.struct("lane", "label", "work"))).alias("o"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    totals = F.concat_ws("; ", F.transform("o", lambda x: F.concat(x["label"], F.lit(": "), grouped(x["work"]))))
    said = F.concat(first["label"], F.lit(" beat "), second["label"], F.lit(" by "), grouped(second["work"] - first["work"]), F.lit(" " + (SETTLE_ALL if settle_all else TO_TARGET)), F.lit(" ("), totals, F.lit(")"))
    return all_rows.select(F.when(F.size("r") < 2, F.raise_error(F.lit("a banner needs at least two lanes")).cast("string")).otherwise(said).alias("text"))


def bound_text(bound: Column) -> Column:
    """A bound as it is shown: whole numbers without a fraction, the endless one by its sign."""
    whole = (bound == F.floor(bound)) & (F.abs(bound) < 1e15)
    return F.when(F.isnan(bound) | (F.abs(bound) == float("inf")), "\u221e").when(whole, bound.cast("long").cast("string")).otherwise(bound.cast("string"))


def narration(state: DataFrame) -> DataFrame:
    """state(lane, depth, batch_open, round, rounds, size, pivots, bound, pulled) -> lane, text: what the bounded lane
    is doing: finding pivots, else pulling, else its level, else idle."""
    level = F.format_string("BMSSP level %d: bound %s", F.col("depth").cast("long"), bound_text(F.col("bound")))
    of = F.when(F.col("rounds") > 0, F.format_string("FindPivots round %d/%d", F.col("round").cast("long"), F.col("rounds").cast("long"))).otherwise(F.format_string("FindPivots round %d", F.col("round").cast("long")))
    finding = (F.col("depth") > 0) & (F.col("batch_open") | (F.col("round") > 0))
    said = (
        F.when(finding, F.concat(of, F.format_string(": %d vertices relaxed, %d pivots found", F.col("size").cast("long"), F.col("pivots").cast("long"))))
        .when((F.col("pulled") > 0) & (F.col("depth") > 0), F.concat(level, F.format_string(", pulled %d", F.col("pulled").cast("long"))))
        .when(F.col("depth") > 0, level)
        .otherwise("BMSSP idle")
    )
    return state.select("lane", said.alias("text"))


def forest_narration(state: DataFrame) -> DataFrame:
    """state(lane, depth, grown, cut, subtrees, pivots, bound, region) -> lane, text of the forest-based lane."""
    active = (F.col("grown") > 0) | (F.col("cut") > 0) | (F.col("subtrees") > 0)
    numbers = [F.col(c).cast("long") for c in ("grown", "subtrees", "pivots", "region")]
    said = (
        F.when(active, F.format_string("Forest %d edges, %d subtrees cut, %d pivots, D occupancy %d", *numbers))
        .when(F.col("depth") > 0, F.format_string("DMSY level %d: bound %s", F.col("depth").cast("long"), bound_text(F.col("bound"))))
        .otherwise("DMSY idle")
    )
    return state.select("lane", said.alias("text"))


#: Algorithm, id, label and persona of a race's lanes; then of a second lane of the same algorithm.
LANE_NAMES = {"dijkstra": ("dijkstra", "Dijkstra", "marble"), "bmssp": ("bmssp", "BMSSP '25", "ember"), "dmsy": ("dmsy", "DMSY '26", "moss")}
SECOND_NAMES = {"dijkstra": ("dijkstra-b", "Dijkstra B", "stub"), "bmssp": ("bmssp-b", "BMSSP B", "ember"), "dmsy": ("dmsy", "DMSY '26", "moss")}


def named_lanes(lanes: DataFrame) -> DataFrame:
    """lanes(run_id, lane, algo) -> with id, label, persona; later lanes of one algorithm are told apart."""
    nth = F.row_number().over(Window.partitionBy("run_id", "algo").orderBy("lane"))
    pick = lambda i: F.when(nth == 1, F.create_map(*(F.lit(x) for k, v in LANE_NAMES.items() for x in (k, v[i])))[F.col("algo")]).otherwise(F.create_map(*(F.lit(x) for k, v in SECOND_NAMES.items() for x in (k, v[i])))[F.col("algo")])
    return lanes.select("run_id", "lane", "algo", pick(0).alias("id"), pick(1).alias("label"), pick(2).alias("persona"))


def applied_cursor(lanes: DataFrame, cursor: float) -> DataFrame:
    """One row, applied: the clock's position, no further than the lanes have come."""
    return stream_cap(lanes).select(F.least(F.lit(float(cursor)), F.col("cap").cast("double")).alias("applied"))


def lane_states(lanes: DataFrame, cursor: float) -> DataFrame:
    """lanes(lane, total, complete, finish_work) at a clock position -> lane, finished (its applied work is its whole
    work and no more will come), frozen (it has settled the finish)."""
    cap = stream_cap(lanes)
    met = lanes.join(F.broadcast(cap), F.lit(True)).withColumn("at", F.least(F.lit(float(cursor)), F.col("cap"), F.coalesce("finish_work", "cap")))  # cap is one row
    frozen = F.col("finish_work").isNotNull() & (F.col("finish_work") <= F.col("at"))
    return met.select("lane", (F.col("complete") & ((F.col("at") >= F.col("total")) | frozen)).alias("finished"), frozen.alias("frozen"))


def race_states(lanes: DataFrame, cursor: float) -> DataFrame:
    """One row: all_complete, all_frozen, settle_all_finished (the clock stands at the longest lane's end)."""
    states = lane_states(lanes, cursor).agg(F.bool_and("frozen").alias("all_frozen"))
    ends = lanes.agg(F.bool_and("complete").alias("all_complete"), F.max("total").alias("longest"), F.coalesce(F.min(F.when(~F.col("complete"), F.col("total"))), F.max("total")).alias("cap"))
    applied = F.least(F.lit(float(cursor)), F.col("cap"))
    return ends.join(F.broadcast(states), F.lit(True)).select("all_complete", "all_frozen", (F.col("all_complete") & (applied >= F.col("longest"))).alias("settle_all_finished"))  # one row each


def story_windows(beats: DataFrame, totals: DataFrame) -> DataFrame:
    """beats(beat, start, end as fractions) for each lane's total: beat, lane, seek_t, end_t. Beats are few and fixed."""
    return totals.join(F.broadcast(beats), F.lit(True)).select("beat", "lane", (F.col("start") * F.col("total")).alias("seek_t"), (F.col("end") * F.col("total")).alias("end_t"))


#: The tour's speed, and billed operations a second at speed 1.
STORY_SPEED, OPS_A_SECOND = 0.0458, 20_000


def story_seconds(windows: DataFrame) -> DataFrame:
    """windows(beat, lane, seek_t, end_t) -> one row, seconds: how long the tour plays."""
    return windows.agg((F.sum(F.greatest(F.col("end_t") - F.col("seek_t"), F.lit(0.0))) / (STORY_SPEED * OPS_A_SECOND)).alias("seconds"))


class WorkClock:
    """The shared clock: speed times 20 000 billed operations a second while it plays."""

    RATE = 20_000

    def __init__(self, speed: float = 1.0):
        self.cursor, self.speed, self.playing = 0.0, speed, False

    def play(self) -> None:
        self.playing = True

    def pause(self) -> None:
        self.playing = False

    def advance(self, seconds: float, cap: float = float("inf")) -> float:
        if self.playing:
            self.cursor = min(cap, self.cursor + self.speed * self.RATE * seconds)
        return self.cursor

    def seek(self, t: float) -> float:
        if not 0 <= t < float("inf"):
            raise ValueError("the clock's position must be finite and not negative")
        self.cursor = t
        return t
