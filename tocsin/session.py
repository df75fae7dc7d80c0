"""Lineage cuts in shared storage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tocsin-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tocsin/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has a one-scan lineage, survives lost executors, keeps column
    pruning and filter pushdown, and gives the same rows to every reader.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._tocsin_path = path
    return stored


def discard(*stored: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more, neither now nor in a retry."""
    for df in stored:
        path = getattr(df, "_tocsin_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_count(stored: DataFrame) -> int:
    """Rows of a materialized table; Parquet answers from its footers. Asked once."""
    if not hasattr(stored, "_tocsin_rows"):
        stored._tocsin_rows = stored.count()
    return stored._tocsin_rows


def broadcast_if_small(df: DataFrame, source: DataFrame | None = None, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only when a count proves the row bound; otherwise leave the
    join strategy to the optimizer.

    ``source`` is a materialized table that ``df`` is derived from without adding rows.
    """
    n = row_count(source) if source is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
