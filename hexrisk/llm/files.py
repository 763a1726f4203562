"""Files that tasks write beside Spark's own formats: in any file system that a URI names, each complete or absent."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexrisk.session import scratch_path


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or absolute path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Written:
    """A file under a name of its own until ``done`` gives it its final name; a repeated task replaces it by equal bytes."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.draft)


def give_back_memory() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def whole_row(df: DataFrame) -> Column:
    """All columns in one, so that added columns can't clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("whole")


#: Bytes of input that one task of a range shuffle should get.
RANGE_BYTES = 64 << 20
#: Sizes beyond this stand for "not known".
UNKNOWN_BYTES = 1 << 55


def range_tasks(df: DataFrame) -> int:
    """Tasks for a range shuffle of ``df``: more than the session's number where Spark knows its input to be large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, known // RANGE_BYTES) if known < UNKNOWN_BYTES else least


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start from files that survive lost executors."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
