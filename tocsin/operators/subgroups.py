"""Subgroup summaries of the outcome table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.exprs import age_group, ratio, unit_type
from tocsin.operators.metrics import count_if, mean_if, non_event
from tocsin.operators.ranking import distinct_values, quantile_linear

QUARTILES = ("Q1 shortest", "Q2", "Q3", "Q4 longest")


def exposure_edges(patients: DataFrame) -> list[float]:
    """Distinct type-7 quartile edges of the non-event exposures (five numbers)."""
    probs = [(q, q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]
    counts = distinct_values(patients.where(non_event()), [], "exposure_days")
    return sorted({r["quantile"] for r in quantile_linear(counts, [], "exposure_days", probs).collect()})


def with_subgroups(patients: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add age group, unit type and the exposure quartile of non-events.

    ``baseline`` has one row per episode: (episode_id, age, gender, unit1, unit2).
    Duplicate quartile edges are merged, as are their labels.
    """
    edges = exposure_edges(patients)
    x = F.col("exposure_days")
    quartile = F.lit(None).cast("string")
    if len(edges) > 1:
        if len(edges) < 5:
            names = list(QUARTILES[: len(edges) - 1])
        else:
            names = list(QUARTILES)
        for name, hi in reversed(list(zip(names, edges[1:]))):
            quartile = F.when(x <= hi, name).otherwise(quartile)
    joined = patients.join(baseline, "episode_id", "left")
    return (joined.withColumn("age_group", age_group("age")).withColumn("unit_type", unit_type("unit1", "unit2"))
            .withColumn("exposure_quartile", F.when(non_event(), quartile)))


def subgroup_summary(patients: DataFrame, variables: Sequence[str] = (
        "site", "gender", "unit_type", "age_group", "exposure_quartile")) -> DataFrame:
    """n, PFA, Sens3 and PPV3 for every level of every variable, missing kept as a level."""
    measures = ["event", "alerted", "eval3", "valid3"]
    named = [F.coalesce(F.col(v).cast("string"), F.lit("missing")).alias(v) for v in variables]
    long = patients.select(*measures, *named).unpivot(measures, list(variables), "subgroup_variable", "subgroup")
    return long.groupBy("subgroup_variable", "subgroup").agg(
        F.count("*").alias("n_patients"), count_if(non_event()).alias("n_non_events"), count_if(F.col("event")).alias("n_events"),
        mean_if(F.col("alerted"), non_event()).alias("pfa"), mean_if(F.col("valid3"), F.col("eval3")).alias("sens3"),
        ratio(count_if(F.col("valid3")), count_if(F.col("alerted"))).alias("ppv3"))
