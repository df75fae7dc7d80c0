"""Small literal tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def values(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A table of literals, one row per tuple; stays inside the JVM plan."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def each(df: DataFrame, name: str, items: Iterable) -> DataFrame:
    """Repeat every row of ``df`` for each literal, in the new column ``name``."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in items])))


def each_row(df: DataFrame, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """Repeat every row of ``df`` for each tuple of literals."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return df.select("*", F.inline(F.array(*structs)))
