"""Columns, stored tables in the shared folder, and batches of texts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, in the store that it names or the cluster's default one.

    Only where that is unset, as in tests, and driver and executors are one process, is a folder
    of its own made; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = context.getCheckpointDir()
    where = context._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString()


_ROOTS: list[Scratch] = []


def _clean() -> None:
    """What operators left in the shared folder goes with the application."""
    while _ROOTS:
        scratch = _ROOTS.pop()
        if scratch.spark.sparkContext._jsc is not None:
            scratch.drop()


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if not _ROOTS:
            atexit.register(_clean)
        _ROOTS.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stored(self, name: str, df: DataFrame, **options: object) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Remove one table, or all."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: name=type. Other columns, whatever their names, go."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, one pass, one number."""
    return df.agg(F.sum(F.octet_length(F.col(f"`{column}`")))).first()[0] or 0


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = lengths(batch.column(column))
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end as bytes, and their bounds (one more than texts); null is empty."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths(texts), out=bounds[1:])
    joined = b"".join(x for x in texts.cast(pa.binary()).to_pylist() if x)
    return np.frombuffer(joined, np.uint8), bounds


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers of this application the package, whatever their own path holds."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="llm-")) / "tickloom_workers.zip"
    with zipfile.ZipFile(archive, "w") as out:
        out.write(here.parent / "__init__.py", "tickloom/__init__.py")
        for file in sorted(here.glob("*.py")):
            out.write(file, f"tickloom/llm/{file.name}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
