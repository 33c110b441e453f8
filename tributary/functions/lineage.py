"""Tables in the folder that driver and executors share: cutting lineage, and what is left."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process wrote and has not deleted, oldest first.
_WRITTEN: list[str] = []
#: Those of the innermost ``scratch`` that this thread is in.
_INSIDE: ContextVar[list[str] | None] = ContextVar("inside", default=None)
_LOCK = threading.Lock()
#: Writes that want shuffles deleted, and the setting as it was before the first of them.
_CLEANING: list[str | None] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set.  Otherwise a temporary folder in local mode
    (tests); on a cluster a machine's own folder would lose data, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tributary-{label}-{uuid.uuid4().hex}"
    with _LOCK:
        _WRITTEN.append(path)
    if (inside := _INSIDE.get()) is not None:
        inside.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage so that a lost
    executor costs no recomputation, and forgets the partitioning so that adaptive
    execution may split skewed partitions of a later join.  What the write shuffled is
    deleted with its end."""
    return _stored(df, fresh_path(df.sparkSession, label), compression)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting holds from the first of several writes at a time to the last."""
    with _LOCK:
        _CLEANING.append(_CLEANING[0] if _CLEANING else spark.conf.get(_CLEANUP, None))
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _CLEANING.pop()
            if not _CLEANING:
                spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def _stored(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    with _cleaning(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        with _LOCK:
            if path in _WRITTEN:
                _WRITTEN.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Deletes the tables that were written inside, at its end: those of this thread, so that
    several can be at work.  What it gives stores a table as ``stored`` does, but for longer:
    until the scratch around this one ends, if there is one."""
    mine: list[str] = []
    token = _INSIDE.set(mine)
    around = token.old_value if token.old_value is not token.MISSING else None

    def outliving(df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(spark, label)
        mine.remove(path)
        if around is not None:
            around.append(path)
        return _stored(df, path)

    try:
        yield outliving
    finally:
        _INSIDE.reset(token)
        _delete(spark, mine)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes this process's tables (from the ``since``-th that is left); results that still
    read them can't be computed any more."""
    _delete(spark, _WRITTEN[since:])


def left() -> int:
    """How many tables are left."""
    return len(_WRITTEN)
