"""Fresh folders that every executor can reach, and their removal."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, SparkSession] = {}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    Both are shared on a cluster. The folder is removed when the process ends, or by ``clear``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{base.rstrip('/')}/colweave-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        if len(_roots) == 1:
            atexit.register(_clear_all)
    return root


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority as Spark resolves it, so that tasks which open it themselves reach the same place."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(folder).toString()


def file_system(path: str):
    """The ``pyarrow.fs`` file system of a qualified path, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go as soon as it has run, not when the driver happens to collect its garbage.

    For jobs that write a table: nothing reads their shuffles again, and the next job needs the disk.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows, written to a fresh folder; the shuffles that made them are released."""
    spark = df.sparkSession
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Remove all folders of this application; results not yet written that read them are lost."""
    root = shared_root(spark)
    remove_dir(spark, root)
    _roots.pop(root, None)


def _clear_all() -> None:
    for root, spark in list(_roots.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            remove_dir(spark, root)
