"""What the operators of this package share: the shared folder, staged tables, batch sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.staging import shared_dir
from waymark.staging import stage as stage

#: ASCII white space as a character class for Java's and RE2's patterns.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
#: Characters of text that numpy code holds at once in one worker; longer texts pass alone.
CHUNK_CHARS = 2_000_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(df: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def width(spark: SparkSession) -> int:
    """How many partitions an explicit exchange should have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those whose key hashes lowest; about as many, if there are more. A filter by hash comes
    first, so that tasks hand on a few rows beyond the sample and not `most` each."""
    share, scale = min(1.0, 1.25 * most / max(1, rows.count())), 2**40
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(scale)) < int(share * scale))
    return rows.orderBy(F.pmod(F.xxhash64(key), F.lit(scale)), key).limit(most)


def free(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't use, so that no extra column is overwritten."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_column(name: str = "text") -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words between runs of ASCII white space; 0 for a blank text."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long")


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about `most` bytes of text each, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
