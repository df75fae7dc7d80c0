"""Delimited episode files: listing, typed read, audit and change check."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.session import materialize, row_count

# The record columns of the public challenge files, in file order.
LONGITUDINAL = (
    "HR", "O2Sat", "Temp", "SBP", "MAP", "DBP", "Resp", "EtCO2", "BaseExcess", "HCO3", "FiO2", "pH", "PaCO2",
    "SaO2", "AST", "BUN", "Alkalinephos", "Calcium", "Chloride", "Creatinine", "Bilirubin_direct", "Glucose",
    "Lactate", "Magnesium", "Phosphate", "Potassium", "Bilirubin_total", "TroponinI", "Hct", "Hgb", "PTT", "WBC",
    "Fibrinogen", "Platelets",
)
BASELINE = ("Age", "Gender", "Unit1", "Unit2", "HospAdmTime")
TIME, LABEL = "ICULOS", "SepsisLabel"
FILE_COLUMNS = (*LONGITUDINAL, *BASELINE, TIME, LABEL)
FILE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in FILE_COLUMNS])

# Folder or `site=` part gives the site; the file stem or an `episode_id=` folder or stem the id.
SITE_PATTERN = r"site=([^/]+)"
ID_PATTERN = r"episode_id=([^/]+?)(?:/|\.[^./]+$)"
STEM_PATTERN = r"([^/]+?)\.[^./]+$"
#: Folders of a site that its files are dealt over, so that tasks can list them.
FOLDERS = 64


def _paths(roots: Mapping[str, str] | str) -> list[str]:
    return [roots] if isinstance(roots, str) else list(roots.values())


def _site(path: Column, roots: Mapping[str, str] | str) -> Column:
    if isinstance(roots, str):
        return F.regexp_extract(path, SITE_PATTERN, 1)
    out = F.lit(None).cast("string")
    for site, root in roots.items():
        out = F.when(path.contains(root.rstrip("/") + "/"), site).otherwise(out)
    return out


def _episode(path: Column) -> Column:
    by_folder = F.regexp_extract(path, ID_PATTERN, 1)
    return F.when(by_folder != "", by_folder).otherwise(F.regexp_extract(path, STEM_PATTERN, 1))


def _files(spark: SparkSession, roots: Mapping[str, str] | str, glob: str, content: bool) -> DataFrame:
    """(path, size_bytes, modified[, sha256, header]) of all files, empty ones included.

    A Spark scan leaves out files without bytes, but its file index, which the driver
    holds for every scan, names them; names without a scanned row are empty files. The
    names are fetched only if there are more of them than rows. Content stays in the task
    that reads it; the other columns are stored, so that the files are read once.
    """
    scan = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(_paths(roots))
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    text = F.col("content").cast("string")
    first = F.split(F.regexp_replace(F.when(F.is_valid_utf8(text), text), "^\ufeff", ""), "\r?\n")[0]
    extra = [F.sha2("content", 256).alias("sha256"), first.alias("header")] if content else []
    rows = scan.select(plain(F.col("path")).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), *extra)
    rows = materialize(rows.repartition("path"), "files")
    if len(scan._jdf.inputFiles()) == row_count(rows):
        return rows
    names = spark.createDataFrame([(n,) for n in scan.inputFiles()], "path string")
    return names.select(plain(F.url_decode("path")).alias("path")).join(rows, "path", "left").withColumn(
        "size_bytes", F.coalesce("size_bytes", F.lit(0).cast("long")))


def list_files(spark: SparkSession, roots: Mapping[str, str] | str, glob: str = "*.psv") -> DataFrame:
    """Files of every site in a stable order: (site, episode_id, path, size, modified).
    Listing and metadata only; no content is read."""
    return _files(spark, roots, glob, False).select(
        _site(F.col("path"), roots).alias("site"), _episode(F.col("path")).alias("episode_id"),
        "path", "size_bytes", "modified").orderBy("site", "episode_id")


def read_episodes(spark: SparkSession, roots: Mapping[str, str] | str, glob: str = "*.psv",
                  schema: T.StructType = FILE_SCHEMA, sep: str = "|") -> DataFrame:
    """Typed records with site, episode_id and the row number within the file.

    The header must match the schema in name and order. NaN, nan, empty and blank
    fields become NULL. Files are not split, so the running id keeps file order.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .schema(text).csv(_paths(roots), sep=sep, header=True, enforceSchema=False, mode="FAILFAST",
                              multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
    path = F.col("_metadata.file_path")
    value = lambda n: F.when(~F.lower(F.trim(n)).isin("nan", ""), F.trim(n)).cast("double")
    return rows.select(_site(path, roots).alias("site"), _episode(path).alias("episode_id"),
                       F.monotonically_increasing_id().alias("row_no"),
                       *[value(F.col(f"`{f.name}`")).alias(f.name) for f in schema])


def as_records(rows: DataFrame, time: str = TIME, label: str = LABEL) -> DataFrame:
    """File columns under the record names t and label."""
    return rows.withColumnRenamed(time, "t").withColumnRenamed(label, "label")


def audit_files(spark: SparkSession, roots: Mapping[str, str] | str, glob: str = "*.psv",
                columns: Sequence[str] = FILE_COLUMNS, sep: str = "|") -> DataFrame:
    """Manifest of the files: size, time, sha256, header, schema_ok, empty, corrupt, error.

    A file holds one episode, so its bytes fit in a task. A file that is not valid UTF-8 is
    corrupt and has a null header; it does not stop the audit of the others."""
    files = _files(spark, roots, glob, True)
    empty = F.col("size_bytes") == 0
    unreadable = F.col("header").isNull()
    return (files.select(
        _site(F.col("path"), roots).alias("site"), _episode(F.col("path")).alias("episode_id"), "path", "size_bytes", "modified",
        F.when(~empty, F.col("sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"),
        F.when(~empty, F.col("header")).otherwise("").alias("header"))
        .withColumn("schema_ok", F.col("header").eqNullSafe(F.lit(sep.join(columns)))).withColumn("empty", empty).withColumn("corrupt", empty | unreadable)
        .withColumn("read_error", F.when(empty, "empty").when(unreadable, "undecodable").when(~F.col("schema_ok"), "schema_mismatch").otherwise("")))


def audit_counts(manifest: DataFrame, expected: Mapping[str, int] | None = None) -> DataFrame:
    """Counts and the pass flag of an audit, one row."""
    n = lambda cond: F.count(F.when(cond, 1))
    sites = {} if expected is None else expected
    one = manifest.agg(
        F.count("*").alias("total_files"), n(F.col("empty")).alias("empty"), n(F.col("corrupt")).alias("corrupt"),
        n(~F.col("schema_ok")).alias("schema_mismatch"),
        (F.count("*") - F.count_distinct("episode_id")).alias("duplicate_ids"),
        *[n(F.col("site") == s).alias(f"{s}_files") for s in sites])
    passed = (F.col("empty") + F.col("corrupt") + F.col("schema_mismatch") + F.col("duplicate_ids")) == 0
    for s, k in sites.items():
        passed = passed & (F.col(f"{s}_files") == k)
    return one.withColumn("passed", passed)


def duplicate_ids(manifest: DataFrame) -> DataFrame:
    """Ids that name more than one file over all sites."""
    return manifest.groupBy("episode_id").agg(F.count("*").alias("n")).where("n > 1")


def changed_files(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or differ now: (path, problem)."""
    now = current.select("path", F.col("size_bytes").alias("_s"), F.col("modified").alias("_m"), F.col("sha256").alias("_h"))
    diff = (F.col("size_bytes") != F.col("_s")) | (F.col("modified") != F.col("_m")) | (F.col("sha256") != F.col("_h"))
    return (manifest.join(now, "path", "left")
            .withColumn("problem", F.when(F.col("_h").isNull(), "missing").when(diff, "changed"))
            .where("problem is not null").select("path", "problem"))


def _write_files(root: str, header: str):
    """mapInArrow: lines sorted by episode to one local file each. A file gets its name when it is
    whole, so a task that runs again replaces it by the same bytes."""
    def part_of(name, value):  # as Spark writes partition values
        escaped = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value or "")
        return f"{name}={escaped or '__HIVE_DEFAULT_PARTITION__'}"

    def run(batches):
        key = part = target = out = None
        written, made = 0, set()
        for batch in batches:
            for episode, rows in groupby(zip(*(batch.column(c).to_pylist() for c in ("site", "folder", "episode_id", "line"))), itemgetter(0, 1, 2)):
                if not out or episode != key:
                    if out:
                        out.close()
                        os.replace(part, target)
                    key, written = episode, written + 1
                    folder = os.path.join(root, part_of("site", key[0]), f"folder={key[1]}")
                    if folder not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                    part, target = os.path.join(folder, f".{uuid.uuid4().hex}"), os.path.join(folder, part_of("episode_id", key[2]) + ".csv")
                    out = open(part, "w", encoding="utf-8", newline="")
                    out.write(header + "\n")
                out.writelines(row[3] + "\n" for row in rows)
        if out:
            out.close()
            os.replace(part, target)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])
    return run


def write_episode_files(records: DataFrame, path: str, columns: Sequence[str] = FILE_COLUMNS, sep: str = "|") -> None:
    """One delimited file per episode, by site= and, within a site, folders of files.

    On a local or mounted file system the tasks write the files themselves: Spark's writer
    starts processes there to set the mode of each file and of its checksum, makes a folder for
    each file, and moves all files one by one on the driver. Elsewhere it is Spark's writer that
    makes one folder per episode.
    """
    spark = records.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        (records.select("site", "episode_id", *columns, "row_no").repartition("episode_id").sortWithinPartitions("site", "episode_id", "row_no")
         .drop("row_no").write.partitionBy("site", "episode_id").csv(path, sep=sep, header=True, nullValue="NaN"))
        return
    if system.exists(place):
        raise FileExistsError(path)
    folder = F.pmod(F.xxhash64("episode_id"), F.lit(FOLDERS))
    lines = records.select(F.col("site").cast("string").alias("site"), folder.alias("folder"), F.col("episode_id").cast("string").alias("episode_id"), "row_no",
                           F.to_csv(F.struct(*columns), {"sep": sep, "nullValue": "NaN"}).alias("line"))
    lines = lines.repartition("episode_id").sortWithinPartitions("site", "folder", "episode_id", "row_no").drop("row_no")
    root = system.makeQualified(place).toUri().getPath()
    lines.mapInArrow(_write_files(root, sep.join(columns)), "files long").agg(F.sum("files")).collect()
