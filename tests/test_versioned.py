"""Committed versions: interrupted writes, competing writers, verified units."""

import pytest
from pyspark.sql import functions as F

from tocsin.sources import results as rt
from tocsin.sources import versioned as vt


def test_an_interrupted_replace_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        vt.read_table(spark, path)
    assert vt.replace_table(spark.range(5), path) == 1
    with pytest.raises(Exception):
        vt.replace_table(spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id")), path)
    assert vt.read_table(spark, path).count() == 5 and vt.versions(spark, path) == [1]
    assert vt.replace_table(spark.range(7), path) == 2
    assert vt.read_table(spark, path).count() == 7 and vt.read_table(spark, path, version=1).count() == 5
    assert vt.vacuum(spark, path) >= 1 and vt.read_table(spark, path).count() == 7
    with pytest.raises(RuntimeError):
        vt._commit(spark, path, {"data": [], "units": []}, 1)
    assert vt.read_table(spark, path).count() == 7


def test_units_are_done_only_when_their_rows_verify(spark, tmp_path):
    path, keys, key = str(tmp_path / "u"), ["rep", "site"], rt.config_key("a", 0.1)
    rows = spark.createDataFrame([(r, s, r * 10.0 + i) for r in range(3) for s in "AB" for i in range(4)], "rep int, site string, x double")
    units = rows.select(*keys).distinct()
    left = lambda k=key: sorted(tuple(r)[:2] for r in vt.pending_units(units, path, keys, k).collect())
    assert len(left()) == 6
    vt.append_units(rows.where("rep = 0"), path, keys, key)
    vt.append_units(rows.where("rep = 1 and site = 'A'"), path, keys, key)
    assert left() == [(1, "B"), (2, "A"), (2, "B")] and len(left(rt.config_key("b"))) == 6
    vt.append_units(rows.where("rep = 1 and site = 'A'").withColumn("x", F.col("x") + 1), path, keys, key)  # again, with other values
    assert vt.read_table(spark, path, keys).count() == 12 and vt.read_table(spark, path, keys).where("rep = 1").agg(F.min("x")).first()[0] == 11.0
    name = vt.commit_of(spark, path)["data"][0]
    damaged = spark.read.parquet(f"{path}/{name}").where("not (site = 'B' and x = 2.0)").collect()  # one row of unit (0, B) is lost
    spark.createDataFrame(damaged, "rep int, site string, x double, _write string").write.mode("overwrite").parquet(f"{path}/{name}")
    assert left() == [(0, "B"), (1, "B"), (2, "A"), (2, "B")]
