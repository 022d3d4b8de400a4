"""Session settings and the shared work folder."""

from __future__ import annotations

import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings that results depend on; everything else is left to the cluster.
RESULT_SETTINGS = {"spark.sql.session.timeZone": "UTC"}

# Settings worth having at scale.  They are advice for spark-submit and are
# used by the tests and the bench; no operator depends on them.
ADVISED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session options the results depend on."""
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Give every core a task when a table comes as fewer pieces than there are cores.

    That happens with one small file, whose row groups cannot be split.  A table
    of many files is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship_with_tasks(module: str) -> None:
    """Send a module's task functions along with the tasks.

    The executors then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` (or already set on the
    context) is used as it is.  Only a local session without one gets a
    temporary folder; a cluster without one is an error, since executors on
    other machines could not read it back.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="voxmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/voxmill-{uuid.uuid4().hex}"
    # Whatever a job leaves there goes when the application ends.
    _files(spark, path).deleteOnExit(_path(spark, path))
    return path


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """The file system that ``path`` is on."""
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


# The folders written in each open ``scratch`` of this thread.
_OPEN = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


def _delete(spark: SparkSession, folder: str) -> None:
    _files(spark, folder).delete(_path(spark, folder), True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Free what ``cut_lineage`` writes inside, at the end or after an error.

    Gives a function that hands a frame over to what surrounds the block: it is
    written once and lives until the surrounding ``scratch`` ends, or the
    application.  No other frame of the block may be read after it.
    """
    scopes = _scopes()
    folders: list[str] = []
    scopes.append(folders)

    def hand_over(df: DataFrame) -> DataFrame:
        written = _written(df)
        if len(scopes) > 1:
            scopes[-2].append(written._folder)
        return written

    try:
        yield hand_over
    finally:
        scopes.remove(folders)
        for folder in folders:
            _delete(spark, folder)


# Nothing reads the shuffles of a frame again once its rows are written.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = work_dir(spark)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(folder + "/rows")
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    written = spark.read.schema(df.schema).parquet(folder + "/rows")
    written._folder = folder
    return written


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to reliable storage and go on from the written rows.

    Used once per round of an iterative operator, so that the plan does not
    grow and a lost executor costs a re-read instead of a re-run.  The round
    before, given as ``replaces``, is deleted once the new one is written; no
    other frame may still need it.  Inside a ``scratch`` the rows go with it.
    """
    written = _written(df)
    if scopes := _scopes():
        scopes[-1].append(written._folder)
    if replaces is not None:
        discard(replaces)
    return written


def discard(written: DataFrame) -> None:
    """Delete the rows of a frame that ``cut_lineage`` or a ``scratch`` gave; nothing to do for any other."""
    if (folder := getattr(written, "_folder", None)) is not None:
        _delete(written.sparkSession, folder)
        for folders in _scopes():
            if folder in folders:
                folders.remove(folder)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a folder of any file system; none if it is missing."""
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    return sorted(told.getPath().getName() for told in files.listStatus(_path(spark, path)) if told.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
