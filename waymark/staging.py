"""Tables staged in the folder that driver and executors share; they cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of sessions on one machine that set none; a running session's settings can't be changed.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='waymark-')}")
        base = _own[0]
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> str:
    """Write df as Parquet in the shared folder; its path."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: a lost executor costs no recomputation of earlier rounds."""
    return df.sparkSession.read.schema(df.schema).parquet(keep(df, name))


def dealt(df: DataFrame) -> DataFrame:
    """df to be joined by an exchange of both sides: a broadcast of a table that grows with the input passes through the driver."""
    return df.hint("merge")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        forget(df.sparkSession, folder)
