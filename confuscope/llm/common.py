"""Helpers shared by the training-data operators: inputs, shared storage, written tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"


#: How to clear what a Python worker remembers between tasks; workers are shared by all operators of a session.
_MEMORIES: list[Callable[[], None]] = []


def remembers(clear: Callable[[], None]) -> None:
    """Say how to clear a memory that outlives tasks."""
    _MEMORIES.append(clear)


def forget() -> None:
    """Clear them all: called by operators' tasks that do not need what other operators left in the worker."""
    for clear in _MEMORIES:
        clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where that setting may be absent (tests), a temporary folder is set for the session and deleted
    when the program ends; on a cluster its absence is an error, as each machine would write to its own disk.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        context.setCheckpointDir(root)
    return root.rstrip("/")


#: Paths of work tables by open scratch(), the innermost last.
_SCRATCH: list[list[str]] = []


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/work/{label}-{uuid.uuid4().hex}"
    for paths in _SCRATCH[-1:]:
        paths.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again: lineage ends there and
    the rows survive lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["work_path"] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = df.__dict__.get("work_path")
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables and files that operators write under the shared folder within the block are deleted at its end, but for
    those that the function it yields is called with."""
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__["work_path"])
        return df

    _SCRATCH.append(paths)
    try:
        yield keep
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            if path not in kept:
                _delete(spark, path)
        for outer in _SCRATCH[-1:]:
            outer += kept


def clear_work(spark: SparkSession) -> None:
    """Delete all tables and files that operators wrote under the shared folder; results that still read
    them must have been written elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/work")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def col_of(name: str) -> Column:
    """A top-level column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
