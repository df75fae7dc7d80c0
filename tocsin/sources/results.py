"""Result tables: all-or-nothing writes, replicate files, resumable runs, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write through Spark's commit protocol: readers see all of it or nothing."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, compression="gzip")
    else:
        writer.format(fmt).save(path)


def read_replicates(spark: SparkSession, root: str, schema: T.StructType, glob: str = "rep_*.csv.gz") -> DataFrame:
    """All replicate files below a folder as one table."""
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .schema(schema).csv(root, header=True, enforceSchema=False, nanValue="NaN", positiveInf="inf", negativeInf="-inf"))


def config_key(*values: object) -> Column:
    """Hash of the settings that a unit of work depends on."""
    return F.sha2(F.concat_ws("|", *[F.lit(str(v)) for v in values]), 256)


def pending_units(units: DataFrame, done: DataFrame | None, keys: Sequence[str], config: Column) -> DataFrame:
    """Units without a finished result under the same settings."""
    marked = units.withColumn("config_key", config)
    if done is None:
        return marked
    return marked.join(done.select(*keys, "config_key").distinct(), [*keys, "config_key"], "left_anti")


def append_units(results: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace only the partitions of the finished units. ``keys`` are all keys of a unit: a
    partition that held several units would lose those of an earlier append."""
    (results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Content hash independent of row order and file layout: row count, and the sum and
    xor of per-row md5 prefixes over the named columns in the given order."""
    columns = list(columns or sorted(df.columns))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *cells).cast("binary")), 1, 12), 16, 10).cast("long")
    rows = df.select(h.alias("h"))
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                    F.bit_xor("h").alias("hash_xor"))


def maxima_table(maxima: DataFrame, origin: Column | str, order: str = "position") -> DataFrame:
    """Calibration maxima for storage: (origin, site, patient_order, fixed_maximum, time_maximum)."""
    origin = F.lit(origin) if isinstance(origin, str) else origin
    return maxima.select(origin.alias("origin"), "site", "episode_id", F.col(order).alias("patient_order"),
                         F.col("max_score").alias("fixed_maximum"), F.col("max_z").alias("time_maximum"))
