"""Materialised intermediates that survive the loss of executors.

Intermediates are written as Parquet under the shared folder named by
``spark.checkpoint.dir``: later reads prune columns, see fresh statistics, and
never depend on blocks held by a single machine.  A session on a single machine
that names none uses :data:`DEFAULT`; on a cluster that is an error, since a
folder of one machine is lost with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULT = "/tmp/checkpoints"


class NoSharedFolder(RuntimeError):
    """A cluster session does not say where intermediates can lie."""


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediates."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        named = DEFAULT
    return named.rstrip("/") + "/tabcord"


#: Folders that the current thread made inside :func:`scratch`, if it is inside.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the work folder; every run writes its own copy."""
    folder = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end or on failure, the intermediates that this thread makes inside.

    What is to stay must be stored before, at a path from outside.
    """
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for folder in made:
            remove(spark, folder)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a DataFrame and open what was written, with the types it had.

    With an explicit ``path`` the previous contents are replaced, so a reader
    never sees a stale copy; opening fails unless the write left its output.
    """
    spark = df.sparkSession
    target = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, wherever Spark's file systems keep it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates, wherever Spark's file systems keep it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
