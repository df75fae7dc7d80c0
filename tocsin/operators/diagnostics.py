"""Score, threshold and replicate diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, finite
from tocsin.operators.ranking import distinct_values, null_safe_join, quantile_linear
from tocsin.params import Params
from tocsin.session import broadcast_if_small

# The reported quantiles.
QUANTILES = {"minimum": 0.0, "q001": 0.001, "q01": 0.01, "q05": 0.05, "q10": 0.10, "q25": 0.25, "median": 0.5,
             "q75": 0.75, "q90": 0.90, "q95": 0.95, "q99": 0.99, "q999": 0.999, "maximum": 1.0}


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Size, distinct values, quantiles and the largest atom (the largest value on ties)
    of the finite values per key; all from one table of value counts."""
    keys = list(keys)
    rows = df.select(*keys, finite(value).alias("_v")).where("_v is not null")
    counts = distinct_values(rows, keys, "_v")
    atom = F.max(F.struct("n", "_v"))
    base = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_scores"), F.count("*").alias("n_unique"), atom.alias("_atom"),
        F.max_by("n", "_v").alias("number_at_maximum"))
    wide = (quantile_linear(counts, keys, "_v", list(QUANTILES.items()), "name").groupBy(*keys)
            .agg(*[F.max(F.when(F.col("name") == n, F.col("quantile"))).alias(n) for n in QUANTILES]))
    joined = base.join(wide, keys)
    return joined.select(
        *keys, "n_scores", "n_unique", (F.col("n_unique") / F.col("n_scores")).alias("unique_fraction"), *QUANTILES,
        F.col("_atom._v").alias("largest_atom_value"), F.col("_atom.n").alias("largest_atom_count"),
        (F.col("_atom.n") / F.col("n_scores")).alias("largest_atom_fraction"), "number_at_maximum")


def score_stages(traj: DataFrame, part: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Eligible values of every score stage as (part, keys, stage, value)."""
    stages = {"raw_probability": "risk", "moving_average": "smooth", "clipped_logit": "score", "standardized": "z"}
    rows = traj.where("eligible").select(part.alias("part"), *keys, *[F.col(c).alias(s) for s, c in stages.items()])
    return rows.unpivot(["part", *keys], list(stages), "stage", "value")


def top_values(df: DataFrame, keys: Sequence[str], value: str, top: int = 30) -> DataFrame:
    """The largest distinct values with count, share and cumulative share per key.

    The limit is the report itself. Spark keeps only the first ranks of every map task
    before the shuffle (window group limit), so no group is gathered.
    """
    keys = list(keys)
    counts = distinct_values(df, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    first = counts.withColumn("rank_from_top", F.row_number().over(w)).where(F.col("rank_from_top") <= top)
    upper = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = null_safe_join(first, broadcast_if_small(totals), keys) if keys else first.crossJoin(totals)  # one row
    return (first.select(*keys, "rank_from_top", value, F.col("n").alias("count"), (F.col("n") / F.col("total_n")).alias("share"),
                         upper.alias("cumulative_count"), (upper / F.col("total_n")).alias("cumulative_share")))


def threshold_ties(maxima: DataFrame, thresholds: DataFrame, match: Sequence[str] = ("site",)) -> DataFrame:
    """Maxima below, equal to and above each scalar threshold, by group of ``part``."""
    c = F.col("threshold")
    x = F.when(F.col("scale") == "z", F.col("max_z")).otherwise(F.col("max_score"))
    n = lambda cond: F.count(F.when(cond, 1))
    joined = maxima.join(broadcast_if_small(thresholds), list(match)).withColumn("_x", x)
    keys = [k for k in ("part", *match, "method", "alpha", "threshold") if k in joined.columns]
    return joined.groupBy(*keys).agg(
        n(F.col("_x") < c).alias("n_less"), n(F.col("_x") == c).alias("n_equal"), n(F.col("_x") > c).alias("n_greater"),
        F.avg((F.col("_x") == c).cast("double")).alias("equality_fraction"),
        n(F.col("_x") >= c).alias("n_at_least"))


def check_thresholds(maxima: DataFrame, thresholds: DataFrame, match: Sequence[str] = ("site",)) -> DataFrame:
    """Second derivation of order-statistic thresholds: a stored threshold is right when
    fewer than k maxima lie below it and at least k do not lie above it, or when it is
    +inf and k exceeds m0. Counting needs no sort."""
    c, k = F.col("threshold"), F.col("k")
    x = F.when(F.col("scale") == "z", F.col("max_z")).otherwise(F.col("max_score"))
    joined = maxima.join(broadcast_if_small(thresholds), list(match)).withColumn("_x", x)
    keys = [*match, "method", "alpha", "threshold", "k", "m0"]
    n = lambda cond: F.count(F.when(cond, 1))
    return joined.groupBy(*keys).agg(n(F.col("_x") < c).alias("n_below"), n(F.col("_x") <= c).alias("n_not_above"),
                                     F.count("*").alias("n_maxima")).withColumn(
        "threshold_match", F.when(k > F.col("n_maxima"), c == F.lit(INF)).otherwise(
            (F.col("n_below") < k) & (F.col("n_not_above") >= k))).withColumn("m0_match", F.col("m0") == F.col("n_maxima"))


def preburn_check(scores: DataFrame, smoothed: DataFrame, episodes: DataFrame, p: Params) -> DataFrame:
    """Episodes with a complete history at tmin: the smoothed value there against the
    plain mean of its L hours."""
    first = p.tmin - p.smooth_length + 1
    hist = (scores.where(F.col("t").between(max(1, first), p.tmin) & finite("risk").isNotNull())
            .groupBy("episode_id").agg(F.avg("risk").alias("expected_mean"), F.count("*").alias("n_hours")))
    at = smoothed.where(F.col("t") == p.tmin).select("episode_id", "smooth")
    able = episodes.where((F.col("horizon") >= p.tmin) & (F.col("onset") > p.tmin)).select("episode_id", "site")
    return (able.join(hist, "episode_id").where(F.col("n_hours") == p.smooth_length).join(at, "episode_id")
            .withColumn("matches", F.abs(F.col("smooth") - F.col("expected_mean")) <= 1e-12))


def covariate_balance(reservoir: DataFrame, population: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of covariates in a sample against the population: (variable, means, counts)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        m = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value")
        return m.groupBy("variable").agg(F.avg("value").alias(f"{name}_mean"), F.count("value").alias(f"{name}_n"))

    out = side(reservoir, "reservoir").join(side(population, "population"), "variable")
    return out.withColumn("absolute_difference", F.abs(F.col("reservoir_mean") - F.col("population_mean")))


def atom_shares(maxima: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of the most frequent maximum per key and column: (keys, scale, n, n_unique,
    largest_atom_fraction)."""
    long = maxima.select(*keys, *columns).unpivot(list(keys), list(columns), "scale", "value")
    counts = long.groupBy(*keys, "scale", "value").count()
    return counts.groupBy(*keys, "scale").agg(
        F.sum("count").alias("n"), F.count("*").alias("n_unique"),
        (F.max("count") / F.sum("count")).alias("largest_atom_fraction"))


def collapsed(shares: DataFrame, limit: float = 0.10) -> DataFrame:
    """Keys whose maxima pile up on one value."""
    return shares.where(F.col("largest_atom_fraction") > limit)
