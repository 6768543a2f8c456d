"""Session helpers: local sessions for tests and bench, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tickloom", cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where that is unset, as in tests, and driver and executors are one process,
    is a folder of its own made; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for one table or stream of this application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def newest_parts(spark: SparkSession, path: str, column: str, n: int) -> list[str]:
    """The ``n`` largest values of a table's partition column, newest first, by listing its
    directories: nothing is read. Empty without a table."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()]
    unescape = context._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted((unescape(x.split("=", 1)[1]) for x in names if x.startswith(f"{column}=")), reverse=True)[:n]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours, in whatever store it lies."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as each one ends; else those of all steps of a job
    stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: the rows as parquet in the shared folder, read back.

    Readers prune columns, push filters and know the size. The folder of an
    application goes when its process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    _clean_at_exit(spark)
    return spark.read.schema(df.schema).parquet(path)


_WATCHED: set[str] = set()


def _clean_at_exit(spark: SparkSession) -> None:
    application = spark.sparkContext.applicationId
    if application in _WATCHED:
        return
    _WATCHED.add(application)
    folder = f"{shared_dir(spark)}/{application}"

    def clean() -> None:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, folder)

    atexit.register(clean)
