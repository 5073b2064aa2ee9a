"""Scratch folders that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: By application: its session, and the folder that holds all of its scratch.
_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local folder serves, but only if all of Spark runs in this
    process, as in tests: on a cluster every executor would write to its own disk.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (root := getattr(spark, "_relflow_scratch", None)):
        root = spark._relflow_scratch = "file://" + tempfile.mkdtemp(prefix="relflow-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder of the application."""
    app = spark.sparkContext.applicationId
    folder = f"{scratch_root(spark)}/relflow/{app}"
    _FOLDERS[app] = (spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there, and
    a lost executor costs no recomputation."""
    return _written(df, scratch(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function like :func:`written` whose tables go when the block ends: nothing that is read later may need them."""
    folder = scratch(spark, name)
    try:
        yield lambda df, part: _written(df, f"{folder}/{part}-{uuid.uuid4().hex}")
    finally:
        remove(spark, folder)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Has the driver let go of what ended plans held: their shuffles and broadcasts, and heap that is free.

    Its JVM collects late while it has room and grows its heap instead.
    """
    gc.collect()  # Python's handles keep the JVM's objects
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all scratch of the application.  Relations that were made before it may no longer be readable.

    It also runs as Python exits, if Spark still runs then.
    """
    if found := _FOLDERS.pop(spark.sparkContext.applicationId, None):
        remove(spark, found[1])


@atexit.register
def _sweep_all() -> None:
    for spark, folder in _FOLDERS.values():
        with suppress(Exception):  # Spark may have been stopped
            remove(spark, folder)
