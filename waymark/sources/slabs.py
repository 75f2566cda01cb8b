"""A trace's slabs as a data source: spark.read.format("waymark_slabs") and df.write.format("waymark_slabs").

A folder holds one Arrow file for each task that has written rows, whose record batches each belong to one slab of a lane, and
manifests. A manifest names the slabs of one committed write, with the file, the record batches, the lane and the first and last
idx of each; files that no manifest names do not exist for readers, so that a write that fails, or a task that runs twice,
leaves nothing behind that is read. A read is a partition for at most READ_ROWS rows of a file, or one slab: files and
partitions grow with the tasks and the rows, not with the slabs. Conditions on lane and idx are taken over by the source where
Spark hands them down (spark.sql.python.filterPushdown.enabled): slabs that they rule out are not read, and rows are still
filtered by Spark.

Paths are those that pyarrow can open (file://, hdfs://, s3://). Rows should come dealt by lane and slab (slabbed()), so that
a slab is in few batches; in any order the content is the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from waymark.schema import SLAB, TRACE

NAME = "waymark_slabs"
COLUMNS = [c.split()[0] for c in TRACE.split(", ")]
#: Rows in one partition of a read, unless one slab has more.
READ_ROWS = 1_000_000


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Slab:
    """One slab in one file: the file's name, lane, range of idx, rows, and numbers of record batches."""

    name: str
    lane: int
    first: int
    last: int
    rows: int
    batches: list[int] = field(default_factory=list)


@dataclass
class Part(InputPartition):
    """Record batches of one file that a task reads."""

    name: str
    batches: list[int]


@dataclass
class Written(WriterCommitMessage):
    slabs: list[Slab]


def manifests(path: str) -> list[Slab]:
    """The files of all committed writes, lane by lane."""
    fs, root = opened(path)
    found = [x for x in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("manifest-")]
    slabs = [Slab(**s) for x in found for s in json.loads(fs.open_input_stream(x.path).read())]
    return sorted(slabs, key=lambda s: (s.lane, s.first, s.name))


def rules_out(condition: Filter, slab: Slab) -> bool:
    """Whether no row of the slab can meet the condition."""
    column, value = condition.attribute[0], condition.value
    low, high = (slab.lane, slab.lane) if column == "lane" else (slab.first, slab.last)
    if isinstance(condition, In):
        return not any(low <= v <= high for v in value)
    tests = {EqualTo: lambda: not low <= value <= high, GreaterThan: lambda: high <= value, GreaterThanOrEqual: lambda: high < value, LessThan: lambda: low >= value, LessThanOrEqual: lambda: low > value}
    return tests[type(condition)]()


class SlabReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.conditions = path, []

    def partitions(self) -> Sequence[InputPartition]:
        wanted = [s for s in manifests(self.path) if not any(rules_out(c, s) for c in self.conditions)]
        parts: list[Part] = []
        for name, slabs in groupby(sorted(wanted, key=lambda s: s.name), key=lambda s: s.name):
            rows = 0
            for slab in slabs:  # in the order of lane and idx, as sorting is stable
                if not rows or rows + slab.rows > READ_ROWS:
                    rows = 0
                    parts.append(Part(name, []))
                parts[-1].batches.extend(slab.batches)
                rows += slab.rows
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as file:
            reader = pyarrow.ipc.open_file(file)
            yield from merged(reader.get_batch(i) for i in sorted(partition.batches))


def merged(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about this many: a slab's batch is small."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def runs(batch: pa.RecordBatch, slab: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """lane, chunk and rows of every slab that the batch holds rows of."""
    lanes = batch.column("lane").to_numpy(zero_copy_only=False)
    chunks = np.floor_divide(batch.column("idx").to_numpy(zero_copy_only=False), slab)
    order = np.lexsort((chunks, lanes))  # stable
    lanes, chunks = lanes[order], chunks[order]
    starts = np.flatnonzero(np.r_[True, (lanes[1:] != lanes[:-1]) | (chunks[1:] != chunks[:-1])]) if len(order) else order
    rows = batch.take(pa.array(order))
    for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(lanes[start]), int(chunks[start]), rows.slice(start, end - start)


class PrunedReader(SlabReader):
    """Takes conditions over; Spark asks for that only where its setting allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        self.conditions = [f for f in filters if isinstance(f, kinds) and f.attribute in (("lane",), ("idx",))]
        yield from filters  # files are left out here, rows by Spark


class SlabWriter(DataSourceArrowWriter):
    def __init__(self, path: str, slab: int, overwrite: bool):
        self.path, self.slab, self.overwrite = path, slab, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, out, writer = f"slabs-{uuid.uuid4().hex}.arrow", None, None
        slabs: dict[tuple[int, int], Slab] = {}
        n = 0
        for batch in iterator:
            for lane, chunk, part in runs(batch, self.slab):
                if writer is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = pyarrow.ipc.new_file(out, batch.schema)
                writer.write_batch(part)
                ends = pc.min_max(part.column("idx")).as_py()
                slab = slabs.setdefault((lane, chunk), Slab(name, lane, ends["min"], ends["max"], 0))
                slab.first, slab.last, slab.rows = min(slab.first, ends["min"]), max(slab.last, ends["max"]), slab.rows + part.num_rows
                slab.batches.append(n)
                n += 1
        if writer is not None:
            writer.close()
            out.close()
        return Written(list(slabs.values()))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        old = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(root)) if x.base_name.startswith("manifest-")] if self.overwrite else []
        name = f"{root}/manifest-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps([s.__dict__ for m in messages if m for s in m.slabs]).encode())
        for path in old:
            fs.delete_file(path)
        fs.move(f"{name}.part", name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for name in {s.name for m in messages if m for s in m.slabs}:
            fs.delete_file(f"{root}/{name}")


class SlabSource(DataSource):
    """Options: path; slab, rows of idx in one file (when writing); pruned, whether conditions are taken over."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TRACE

    def reader(self, schema: StructType) -> SlabReader:
        return (PrunedReader if self.options.get("pruned") == "true" else SlabReader)(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SlabWriter:
        return SlabWriter(self.options["path"], int(self.options.get("slab", SLAB)), overwrite)


def slabbed(rows: DataFrame, slab: int = SLAB) -> DataFrame:
    """The trace's columns, dealt by lane and slab and in order of idx."""
    chunk = F.floor(F.col("idx") / slab)
    return rows.select(*COLUMNS).repartition("lane", chunk).sortWithinPartitions("lane", "idx")


def write(rows: DataFrame, path: str, slab: int = SLAB, mode: str = "append") -> None:
    rows.sparkSession.dataSource.register(SlabSource)
    slabbed(rows, slab).write.format(NAME).option("slab", slab).mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SlabSource)
    return spark.read.format(NAME).option("pruned", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(path)
