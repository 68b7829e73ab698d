"""Work folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Folders named by this process, for ``release``.
_NAMED: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the cluster's shared checkpoint folder (spark.checkpoint.dir).

    Only a local session (one JVM) may go without that setting; a cluster's machine-local folders are not shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/bytecarve-checkpoints"
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    _NAMED.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _NAMED[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """The place in the list of work folders that ``release`` goes back to."""
    return len(_NAMED)


def release(spark: SparkSession, since: int) -> None:
    """Delete the work folders named since ``mark``: for a caller that has written what it made of them elsewhere."""
    while len(_NAMED) > since:
        remove(spark, _NAMED.pop())
