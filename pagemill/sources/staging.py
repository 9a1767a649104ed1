"""Tables written once and read back, so that no branch of a plan repeats the work before them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset in local mode (tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def staged(df: DataFrame, label: str, batch: str = "8m") -> DataFrame:
    """df written to the shared folder and read back; it stays until the folder is cleared. Batches to Python are bounded by bytes
    (``batch``) meanwhile, since rows may hold whole pages."""
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"
    before = conf.get(_BATCH_BYTES, None)
    conf.set(_BATCH_BYTES, batch)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_BATCH_BYTES) if before is None else conf.set(_BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
