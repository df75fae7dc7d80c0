"""Result tables with committed versions: replaced as a whole or not at all, completed units verified.

A table is a folder of data folders that are written once, and of numbered commits. A commit is
a small JSON file that names the data folders of a version; it is moved into place after its data
are complete, so readers, who follow the highest number, see the old version until then and the
new one after. A write that fails leaves data that no commit names. Two writers that want the
same number cannot both get it: the later one fails or takes the next.

Every unit of work (a replicate, a site) is recorded beside its rows with their number, a hash of
their content and the key of the settings. A unit counts as done only if the committed rows still
give that number and hash under the same settings.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """(file system, function from text to its path class)."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    fs, path_of = _files(spark, path)
    folder = path_of(f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def commit_of(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The record of a version, of the newest one by default; None if there is none."""
    found = versions(spark, path)
    if version is None and not found:
        return None
    number = found[-1] if version is None else version
    text = spark.read.text(f"{path}/commits/{number:012d}.json", wholetext=True).first()[0]
    return json.loads(text) | {"version": number}


def _commit(spark: SparkSession, path: str, record: dict, after: int) -> int:
    """Moves the record into place as the next version after ``after``."""
    fs, path_of = _files(spark, path)
    fs.mkdirs(path_of(f"{path}/commits"))
    draft = path_of(f"{path}/commits/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    target = path_of(f"{path}/commits/{after + 1:012d}.json")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"{path}: version {after + 1} was committed by another writer")
    return after + 1


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")


def unit_records(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number and content hash of the rows of every unit."""
    return rows.groupBy(*keys).agg(F.count("*").alias("unit_rows"), F.sum(_row_hash(rows)).cast("string").alias("unit_hash"))


def replace_table(df: DataFrame, path: str) -> int:
    """Writes ``df`` as the new content of the table; returns the version."""
    spark, old = df.sparkSession, commit_of(df.sparkSession, path)
    data = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    return _commit(spark, path, {"data": [data], "units": []}, old["version"] if old else 0)


def append_units(results: DataFrame, path: str, keys: Sequence[str], config: Column) -> int:
    """Adds finished units with their records; a unit that was there is replaced in the records,
    and its old rows are no longer read."""
    spark, old = results.sparkSession, commit_of(results.sparkSession, path)
    name = uuid.uuid4().hex
    results.withColumn("_write", F.lit(name)).write.parquet(f"{path}/data/{name}")
    stored = spark.read.parquet(f"{path}/data/{name}").drop("_write")
    records = unit_records(stored, keys).withColumn("config_key", config).withColumn("_write", F.lit(name))
    at = (old["version"] if old else 0) + 1
    records.withColumn("_version", F.lit(at)).write.parquet(f"{path}/units/{name}")
    record = {"data": [*(old["data"] if old else []), f"data/{name}"], "units": [*(old["units"] if old else []), f"units/{name}"]}
    return _commit(spark, path, record, at - 1)


def _records(spark: SparkSession, path: str, commit: dict, keys: Sequence[str]) -> DataFrame:
    """The newest record of every unit."""
    records = spark.read.parquet(*[f"{path}/{u}" for u in commit["units"]])
    values = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*values), "_version").alias("r")).select(*keys, "r.*")


def read_table(spark: SparkSession, path: str, keys: Sequence[str] = (), version: int | None = None) -> DataFrame:
    """The rows of a version. Of a table of units, named by ``keys``, the rows of each unit's newest write."""
    commit = commit_of(spark, path, version)
    if commit is None:
        raise FileNotFoundError(f"{path} has no committed version")
    rows = spark.read.parquet(*[f"{path}/{d}" for d in commit["data"]])
    if not commit["units"]:
        return rows
    newest = _records(spark, path, commit, keys).select(*keys, "_write")
    return rows.join(newest, [*keys, "_write"]).drop("_write")


def pending_units(units: DataFrame, path: str, keys: Sequence[str], config: Column) -> DataFrame:
    """Units without a verified result: never committed, made under other settings, or with rows
    that no longer give the recorded number and hash."""
    spark, commit = units.sparkSession, commit_of(units.sparkSession, path)
    marked = units.withColumn("config_key", config)
    if commit is None or not commit["units"]:
        return marked
    records = _records(spark, path, commit, keys).drop("_write", "_version")
    good = records.join(unit_records(read_table(spark, path, keys), keys), [*keys, "unit_rows", "unit_hash"])
    return marked.join(good.select(*keys, "config_key"), [*keys, "config_key"], "left_anti")


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes data that the newest version does not name; returns the number of folders."""
    commit, (fs, path_of), gone = commit_of(spark, path), _files(spark, path), 0
    named = set(commit["data"] + commit["units"]) if commit else set()
    for kind in ("data", "units"):
        folder = path_of(f"{path}/{kind}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if f"{kind}/{status.getPath().getName()}" not in named:
                gone += bool(fs.delete(status.getPath(), True))
    return gone
