"""Score trajectories: smoothing, logit, eligibility and episode maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, clipped_logit, eligible, finite, utility_grid
from tocsin.params import Params


def smooth(scores: DataFrame, p: Params, carry: Sequence[str] = ()) -> DataFrame:
    """Causal mean of the finite risks of the last L clock hours.

    One output row per hour that has such a risk, also when the hour itself has
    none; absent hours are never stored. An hour t writes itself and the following
    hours up to the next scored one, so a gap is filled without a dense grid.
    ``carry`` columns are constant per episode and are kept. Hours are unique per
    episode, which bounds every window partition by the hours of one episode.
    """
    length = p.smooth_length
    carry = list(carry)
    w = Window.partitionBy("episode_id").orderBy("t")
    rows = scores.select("episode_id", *carry, F.col("t").cast("int").alias("t"), finite("risk").alias("risk"))
    rows = rows.where(F.col("risk").isNotNull())
    means = [F.avg("risk").over(w.rangeBetween(-(length - 1 - j), 0)).alias(f"_m{j}") for j in range(length)]
    rows = rows.select("*", F.lead("t").over(w).alias("_next"), *means)
    hours = F.array(*[
        F.struct((F.col("t") + j).alias("t"),
                 F.col("risk").alias("risk") if j == 0 else F.lit(None).cast("double").alias("risk"),
                 F.col(f"_m{j}").alias("smooth"))
        for j in range(length)
    ])
    keep = F.filter(hours, lambda h: (h["t"] < F.coalesce(F.col("_next"), h["t"] + 1))
                    & (h["t"] <= (p.hmax if p.hmax is not None else 2**30)))
    return rows.select("episode_id", *carry, F.explode(keep).alias("h")).select(
        "episode_id", *carry, "h.t", "h.risk", "h.smooth")


def trajectories(scores: DataFrame, episodes: DataFrame, p: Params) -> DataFrame:
    """Join scores with episodes and add smooth, score, eligibility and the values of
    the hour before (NULL when that hour is not eligible or not scored).

    Scores and episodes meet on episode_id once; both windows reuse that partitioning.
    """
    attrs = [c for c in episodes.columns if c != "episode_id"]
    joined = scores.select("episode_id", "t", "risk").join(episodes, "episode_id")
    rows = smooth(joined, p, attrs)
    score = clipped_logit("smooth", p.epsilon)
    if p.score_digits is not None:
        score = F.round(score, p.score_digits)
    rows = rows.withColumn("score", score).where(
        (F.col("t") <= F.col("horizon")) & (F.col("t") >= p.tmin))
    rows = rows.withColumn("eligible", eligible(p)).withColumn("in_grid", utility_grid(p))
    w = Window.partitionBy("episode_id").orderBy("t").rangeBetween(-1, -1)
    return rows.withColumn("prev_risk", F.first("risk").over(w)).withColumn("prev_score", F.first("score").over(w))


def clip_horizon(traj: DataFrame, hmax: Column | int) -> DataFrame:
    """Trajectories cut at a shorter hour limit."""
    hmax = F.lit(hmax) if isinstance(hmax, int) else hmax
    return traj.where(F.col("t") <= hmax)


def subset(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("episode_id"), "episode_id", "left_semi")


def maxima(traj: DataFrame, episodes: DataFrame, columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Largest finite eligible value per episode, -inf when there is none.

    ``columns`` maps output names to trajectory columns. Every row of ``episodes``
    stays, so an episode without an eligible score still counts.
    """
    on = ["episode_id", *keys]
    best = traj.where(F.col("eligible")).groupBy(*on).agg(
        *[F.max(finite(src)).alias(out) for out, src in columns.items()])
    joined = episodes.join(best, on, "left")
    for out in columns:
        joined = joined.withColumn(out, F.coalesce(F.col(out), F.lit(-INF)))
    return joined


def flat_eligible(traj: DataFrame, p: Params, value: str = "risk") -> DataFrame:
    """Eligible finite rows as (episode_id, value, label) for threshold-free work."""
    from tocsin.functions.exprs import lookahead_label

    return traj.where(F.col("eligible") & finite(value).isNotNull()).select(
        *[c for c in ("episode_id", "site") if c in traj.columns], "t",
        F.col(value).alias("value"), (F.col("event") & lookahead_label(p)).cast("int").alias("label"))
