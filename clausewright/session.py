"""Session settings the engine relies on."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Needed for right results: UTC everywhere, and a patch that repeats a metadata key wins over the stored value.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def session(app: str = "clausewright", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a session that someone else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """For applications: rows then travel to Python in batches of a few MB, whatever their size. Operators change no setting, and are right with any."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For applications: within, what an execution shuffles goes when it ends, rather than when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it: for what Spark's readers and writers don't do, anywhere."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one in the warehouse.

    A warehouse on a local disk is shared by nobody but the threads of a local master, so on a cluster without
    either setting this fails rather than have each executor write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if filesystem(spark, warehouse)[0].getUri().getScheme() == "file" and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is on a local disk")
    return f"{warehouse}/cut"


def own_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared one."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"
