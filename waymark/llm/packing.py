"""Best-fit packing of tokenised documents by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the plan is made from the histogram of lengths alone (at most
`capacity` rows at the driver, whatever the number of documents):

1. pieces as long as the capacity stand alone;
2. lengths over LARGE are dealt, longest first, into GROUPS groups of equal numbers and rounded up to their group's
   longest; a linear programme over the configurations of these few sizes (columns made by a knapsack, basis solved
   densely) says how many sequences of each configuration to use;
3. the actual lengths take the rounded ones' places, and the true gaps remain;
4. what is left, small lengths above all, goes longest first to the smallest gap that takes it.

The plan is a table of runs: the pieces of a length with ranks lo to hi go, per_bin to a sequence, to the sequences
from `sequence` on, at `offset`. Ranks within a length come from salted windows, so no length gathers in one task.

Defined cases: null text is the empty text (one token, the closing id 0); rows may repeat, each is packed; a null
doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import stage, text_column, text_slices
from waymark.llm.subwords import shared_subwords, vocabulary_path

CAPACITY = 2048
#: A length over a quarter of the capacity is large: at most three of them share a sequence.
LARGE = 4
GROUPS = 64
SALTS = 512
#: Plans up to this many runs are broadcast (48 bytes each); their number depends on the capacity, not on the documents.
MOST_BROADCAST_RUNS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CLOSE = b"\0\0\0\0"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The documents' pieces: each text's ids and a closing 0, cut where longer than the capacity."""
    path = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = shared_subwords(path)
        for part in text_slices(batches, "text"):
            columns: list[list] = [[] for _ in ARROW]
            for doc_id, ids in zip(part.column(0).to_pylist(), subwords.ids(part.column(1).to_pylist()), strict=True):
                ids += CLOSE
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at : at + 4 * capacity]
                    for c, v in zip(columns, (doc_id, k, at // 4, len(raw) // 4, zlib.crc32(raw)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(cut, PIECES)


@dataclass
class Run:
    length: int
    lo: int
    hi: int
    per_bin: int
    sequence: int
    offset: int


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, most_steps: int = 2000) -> list[tuple[float, np.ndarray]]:
    """The linear programme min sum(x), A x >= counts over all configurations of sizes: (x, configuration)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    deepest = int(capacity // sizes.min())
    for _ in range(most_steps):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value = np.zeros(capacity + 1)
        choice = []
        for _ in range(deepest):
            best, pick = value.copy(), np.full(capacity + 1, -1)
            for j in range(k):
                if prices[j] > 0:
                    with_j = np.full(capacity + 1, -1.0)
                    with_j[sizes[j] :] = value[: capacity + 1 - sizes[j]] + prices[j]
                    better = with_j > best + 1e-12
                    best[better], pick[better] = with_j[better], j
            value = best
            choice.append(pick)
        if value[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(choice):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        amount, rate = np.linalg.solve(basis, counts.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(rate > 1e-9, np.maximum(amount, 0) / np.where(rate > 1e-9, rate, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, counts.astype(float))
    return [(float(x), basis[:, i].astype(int)) for i, x in enumerate(amount) if x > 1e-9]


class Packer:
    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {int(n): int(c) for n, c in histogram.items() if c}
        self.rank: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.runs: list[Run] = []

    def place(self, length: int, sequence: int, bins: int, per_bin: int, offset: int) -> None:
        lo = self.rank[length]
        self.runs.append(Run(length, lo, lo + bins * per_bin, per_bin, sequence, offset))
        self.rank[length] = lo + bins * per_bin
        self.left[length] -= bins * per_bin

    def open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins

    def pack_large(self, groups: int) -> None:
        lengths = sorted((n for n, c in self.left.items() if c and self.capacity > n > self.capacity // LARGE), reverse=True)
        total = sum(self.left[n] for n in lengths)
        if not total:
            return
        each = -(-total // groups)
        dealt: list[list[list[int]]] = [[]]
        room = each
        for n in lengths:
            count = self.left[n]
            while count:
                if not room:
                    dealt.append([])
                    room = each
                take = min(count, room)
                dealt[-1].append([n, take])
                count, room = count - take, room - take
        merged: dict[int, list[list[int]]] = {}
        for group in dealt:  # groups of the same rounded size are one size
            merged.setdefault(group[0][0], []).extend(group)
        sizes = np.array(list(merged))
        stock = list(merged.values())
        counts = np.array([sum(c for _, c in g) for g in stock])
        for amount, config in configurations(sizes, counts, self.capacity):
            bins = int(amount + 1e-9)
            if not bins:
                continue
            parts = [(self.open(bins), bins, 0)]
            for j in np.repeat(np.arange(len(sizes)), config):
                done = []
                for start, n, used in parts:
                    while n:
                        if not stock[j]:
                            done.append((start, n, used))
                            break
                        length, there = stock[j][0]
                        take = min(n, there)
                        self.place(length, start, take, 1, used)
                        done.append((start, take, used + length))
                        stock[j][0][1] -= take
                        if not stock[j][0][1]:
                            stock[j].pop(0)
                        start, n = start + take, n - take
                parts = done
            for start, n, used in parts:
                self.gaps[self.capacity - used].append((start, n))

    def best_fit(self) -> None:
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            while left := self.left[length]:
                fitting = [g for g, at in self.gaps.items() if g >= length and at]
                if not fitting:
                    per_bin = min(self.capacity // length, left)
                    bins = left // per_bin
                    start = self.open(bins)
                    self.place(length, start, bins, per_bin, 0)
                    self.gaps[self.capacity - per_bin * length].append((start, bins))
                    continue
                gap = min(fitting)
                start, n = self.gaps[gap].pop()
                per_bin = min(gap // length, left)
                bins = min(n, left // per_bin)
                self.place(length, start, bins, per_bin, self.capacity - gap)
                self.gaps[gap - per_bin * length].append((start, bins))
                if n > bins:
                    self.gaps[gap].append((start + bins, n - bins))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """The runs that place every piece of the histogram."""
    packer = Packer(histogram, capacity)
    if whole := packer.left.get(capacity):
        packer.place(capacity, packer.open(whole), whole, 1, 0)
    packer.pack_large(groups)
    packer.best_fit()
    return packer.runs


def ranked(cut: DataFrame) -> DataFrame:
    """Adds `rank`, from 0 within each length: a number inside the length's salt and the sizes of the salts before."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    return salted.withColumn("n", F.row_number().over(inside)).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n") - 1)


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity, groups)
    table = spark.createDataFrame([(r.length, r.lo, r.hi, r.per_bin, r.sequence, r.offset) for r in runs], "length long, lo long, hi long, per_bin long, first long, base_offset long")
    if len(runs) <= MOST_BROADCAST_RUNS:
        table = F.broadcast(table)
    rows = stage(ranked(cut), "ranked")
    r = rows.alias("r").join(table.alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return r.select(
        "doc_id", "piece", "start", "r.length", "ids_crc32",
        (F.col("first") + F.expr("(rank - lo) div per_bin")).alias("sequence_id"),
        (F.col("base_offset") + (nth % F.col("per_bin")) * F.col("r.length")).alias("offset"),
    )
