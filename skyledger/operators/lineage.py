"""Cutting lineage on storage every executor can read."""

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="skyledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which belongs to the innermost ``owned_tables`` around the call."""
    path = f"{shared_folder(spark).rstrip('/')}/skyledger-{name}-{uuid.uuid4().hex}"
    if (paths := _owned.get()) is not None:
        paths.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``settle`` wrote in the body, also after an error.

    What shall outlive the body is written elsewhere or collected before it ends; frames over settled tables cannot be
    read afterwards. Bodies may be nested: each owns what was written directly in it.
    """
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(token)
        for path in paths:
            delete_path(spark, path)


#: Removes the shuffle files of a query at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
_writers: dict[int, list] = {}


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries of the body remove their shuffle files at their end. Bodies may run at a time; the last one restores the setting."""
    key = id(spark._jsparkSession)
    with _writing:
        if key not in _writers:
            _writers[key] = [0, spark.conf.get(CLEANUP, None)]
            spark.conf.set(CLEANUP, "true")
        _writers[key][0] += 1
    try:
        yield
    finally:
        with _writing:
            _writers[key][0] -= 1
            if not _writers[key][0]:
                before = _writers.pop(key)[1]
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write the frame once and read it back.

    Later branches read only the columns they need, a lost executor re-reads files instead of
    replaying the joins above, and the planner sees the true size, so that its broadcast
    threshold is a measured one. With ``by``, each value of that column has a folder. The shuffle
    files of the joins above go with the write.
    """
    path = scratch_path(df.sparkSession, name)
    with released_shuffles(df.sparkSession):
        df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
