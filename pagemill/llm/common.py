"""Shared helpers: staged tables in the shared folder, and null-safe inputs."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import re
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str):
    """Session settings for the time of one write."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, label: str, batch: str = "8m") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Its shuffle files go when it is written, since nothing else reads them, and batches sent to Python are bounded
    by bytes (``batch``), since rows may hold long texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    with _settings(spark, classic__shuffleDependency__fileCleanup__enabled="true", execution__arrow__maxBytesPerBatch=batch):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def task_row_ids():
    """A generator of longs, unique over all tasks of a stage; stable only once the stage's output is staged."""
    n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    while True:
        yield n
        n += 1


def give_back() -> None:
    """Return memory that nothing uses any more to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """run, a task's function of one or two tables or an iterator of batches, after which unused memory is given back:
    workers go on to other tasks, and what each of them keeps adds up."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def batches_of(batches):
            give_back()
            try:
                yield from run(batches)
            finally:
                give_back()

        return batches_of
    if len(inspect.signature(run).parameters) == 1:

        @functools.wraps(run)
        def of_one(table):
            try:
                return run(table)
            finally:
                give_back()

        return of_one

    @functools.wraps(run)
    def of_two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return of_two


def id_remainder(value, modulus: int = 5) -> int:
    """crc32 of the id written as text, mod modulus."""
    return zlib.crc32(str(value).encode()) % modulus
