"""Tables in the shared folder, where lineage ends: lost executors cost their tasks, not all work before."""

from __future__ import annotations

import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables written by the operator that is running in this thread.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets a new folder of its own; on a cluster executors could not see one, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing, _before = threading.Lock(), {}, {}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While tables are written, in any thread, Spark deletes the shuffle files of a query at its end and not when the driver's memory happens to be cleaned: nothing reads them again."""
    key = id(spark._jsparkSession)
    with _lock:
        if not _writing.get(key):
            _before[key] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing[key] = _writing.get(key, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writing[key] -= 1
            if not _writing[key]:
                before = _before.pop(key)
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.options(**options).parquet(path)
    written = _written.get()
    if written is not None:
        written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = [path]
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables; nothing may read them any more."""
    for table in tables:
        paths, table.stored = table.__dict__.get("stored", []), []
        _delete(table.sparkSession, paths)
        written = _written.get()
        if written is not None:
            _written.set([p for p in written if p not in paths])


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written to the shared folder too, and whose other tables there are then deleted."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        outer = _written.set([])
        kept: list[str] = []
        try:
            out = materialise(operator(*args, **kwargs))
            kept.append(_written.get().pop())
            return out
        finally:
            paths = _written.get()
            _written.reset(outer)
            _delete(SparkSession.active(), paths)
            if _written.get() is not None:
                _written.get().extend(kept)

    return run
