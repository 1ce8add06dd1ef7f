"""Folders that driver and executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: For each open scratch, the folders made since.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; it goes when the application ends.

    Only a local master, as in tests, may leave that setting out: a folder of this machine serves then.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "kinname-shared")
    name = f"{base}/{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    for made in _open:
        made.append(name)
    return name


def remove(spark: SparkSession, name: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is written within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def no_shuffles_left(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of a write within go at its end; else they stay until the driver happens to collect garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_scans(spark: SparkSession, most: int = 32 << 20) -> contextlib.AbstractContextManager[None]:
    """Scans of a write within have parts of ``most`` bytes at most, as far as row groups allow, so that what a task makes of its part is sorted in memory."""
    now = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return setting(spark, "spark.sql.files.maxPartitionBytes", f"{min(now, most)}b")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that are made within, at its end: for work whose result is written by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for name in made:
            remove(spark, name)
