"""Alerts of many thresholds in one pass over the trajectories."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, eligible_hours, finite, window_evaluable
from tocsin.operators.utility import base_utilities, utility_gain
from tocsin.params import Params
from tocsin.session import broadcast_if_small


SCALES = ("risk", "score", "z")


def pack_ops(thresholds: DataFrame, match: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """One row per ``match`` value: an array of its thresholds per scale, and the lowest
    limit of each scale."""
    one = F.size("threshold") == 1
    op = F.struct("op", F.when(one, F.element_at("threshold", 1)).alias("limit"), F.when(~one, F.col("threshold")).alias("hourly"), *labels)
    aggs = [e for s in SCALES for e in (
        F.sort_array(F.collect_list(F.when(F.col("scale") == s, op))).alias(f"_{s}_ops"),
        F.min(F.when(F.col("scale") == s, F.array_min("threshold"))).alias(f"_{s}_min"))]
    return thresholds.groupBy(*match).agg(*aggs)


def _limit(op: Column, hour: Column) -> Column:
    return F.coalesce(op["limit"], F.get(op["hourly"], hour - 1))


def alert_hours(traj: DataFrame, thresholds: DataFrame, match: Sequence[str] = ("site",)) -> DataFrame:
    """Hours above threshold: (episode_id, op, t, eligible, start, ...).

    Rows at or below the lowest limit leave the plan before any threshold is tried, and
    only hours that exceed a threshold leave the scan, so the number of methods does not
    multiply the trajectory rows. ``start`` marks an eligible hour above threshold whose
    preceding hour is not. Comparison is strict; a missing score is never above.
    """
    packed = broadcast_if_small(pack_ops(thresholds, match), thresholds)
    if "z" not in traj.columns:
        null = F.lit(None).cast("double")
        traj = traj.withColumn("z", null).withColumn("prev_z", null)
    rows = traj.where("in_grid")
    joined = rows.join(packed, list(match))
    above_any = F.lit(False)
    for s in SCALES:
        above_any = above_any | F.coalesce(F.col(s) > F.col(f"_{s}_min"), F.lit(False))

    def hits(s: str) -> Column:
        t, now, before = F.col("t"), F.col(s), F.col(f"prev_{s}")
        found = F.filter(f"_{s}_ops", lambda op: F.coalesce(now > _limit(op, t), F.lit(False)))
        return F.transform(found, lambda op: F.struct(
            op["op"].alias("op"), (~F.coalesce(before > _limit(op, t - 1), F.lit(False))).alias("up")))

    keep = ["episode_id", "t", "eligible", "event", "onset", "horizon"]
    found = joined.where(above_any).select(*keep, F.inline(F.concat(*[hits(s) for s in SCALES])))
    return found.select(*keep, "op", (F.col("eligible") & F.col("up")).alias("start"))


def first_alert_by_row(traj: DataFrame, value: str, threshold: str) -> DataFrame:
    """First alert under a threshold given per episode and hour: (episode_id, tau), +inf
    when the episode never exceeds it."""
    hit = F.col("eligible") & (finite(value) > F.col(threshold))
    return traj.groupBy("episode_id").agg(F.coalesce(F.min(F.when(hit, F.col("t"))).cast("double"), F.lit(INF)).alias("tau"))


def count_alert_episodes(starts: Column, separation: int) -> Column:
    """Alert episodes in an array of run starts: a start counts when it lies at least
    ``separation`` hours after the last counted one."""
    zero = F.struct(F.lit(-(10**6)).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(starts), zero,
        lambda a, s: F.when(s - a["last"] >= separation, F.struct(s.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a),
        lambda a: a["n"])


def alerts(hours: DataFrame, p: Params) -> DataFrame:
    """(episode_id, op, tau, n_alert_episodes, gain) for episodes with a hit: first alert
    hour, alert episodes, and the utility gained over silence."""
    grouped = hours.groupBy("episode_id", "op").agg(
        F.min(F.when(F.col("eligible"), F.col("t"))).alias("tau"),
        F.collect_list(F.when(F.col("start"), F.col("t"))).alias("_starts"),
        F.sum(utility_gain(p)).alias("gain"))
    return grouped.select("episode_id", "op", "tau",
                          count_alert_episodes(F.col("_starts"), p.separation).alias("n_alert_episodes"), "gain")


def episode_hits(traj: DataFrame, episodes: DataFrame, thresholds: DataFrame, p: Params, match: Sequence[str] = ("site",),
                 labels: Sequence[str] = (), keep_op: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``outcomes`` with an hour above the threshold, for very many thresholds:
    hours above the lowest limit are exchanged once per episode, as an array, and every threshold
    that ``keep_op`` leaves to the episode goes through that array in place.

    ``labels`` are threshold columns for ``keep_op``. Episodes without such hours have no row.
    """
    packed = broadcast_if_small(pack_ops(thresholds, match, labels), thresholds)
    limits = packed.select(*match, *[f"_{s}_min" for s in SCALES])
    above_any = F.lit(False)
    for s in SCALES:
        above_any = above_any | F.coalesce(F.col(s) > F.col(f"_{s}_min"), F.lit(False))
    if "z" not in traj.columns:
        null = F.lit(None).cast("double")
        traj = traj.withColumn("z", null).withColumn("prev_z", null)
    hour = F.struct("t", "eligible", utility_gain(p).alias("gain"), *SCALES, *[f"prev_{s}" for s in SCALES])
    hours = traj.where("in_grid").join(limits, list(match)).where(above_any).groupBy("episode_id").agg(
        F.sort_array(F.collect_list(hour)).alias("_hours"), *[F.max(s).alias(f"_{s}_peak") for s in SCALES])
    start = F.struct(F.lit(None).cast("int").alias("tau"), F.lit(-(10**6)).alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("gain"), F.lit(False).alias("hit"))

    def found(s: str) -> Column:
        def step(op: Column) -> Callable[[Column, Column], Column]:
            def add(a: Column, h: Column) -> Column:
                above = F.coalesce(h[s] > _limit(op, h["t"]), F.lit(False))
                up = above & h["eligible"] & ~F.coalesce(h[f"prev_{s}"] > _limit(op, h["t"] - 1), F.lit(False))
                counts = up & (h["t"] - a["last"] >= p.separation)
                return F.struct(
                    F.when(a["tau"].isNull() & above & h["eligible"], h["t"]).otherwise(a["tau"]).alias("tau"),
                    F.when(counts, h["t"]).otherwise(a["last"]).alias("last"), (a["n"] + counts.cast("int")).alias("n"),
                    F.when(above, a["gain"] + h["gain"]).otherwise(a["gain"]).alias("gain"), (a["hit"] | above).alias("hit"))
            return add
        ops = F.filter(f"_{s}_ops", lambda op: op["hourly"].isNotNull() | F.coalesce(F.col(f"_{s}_peak") > op["limit"], F.lit(False)))
        ops = ops if keep_op is None else F.filter(ops, keep_op)
        return F.filter(F.transform(ops, lambda op: F.struct(op["op"].alias("op"), F.aggregate("_hours", start, step(op)).alias("of"))), lambda x: x["of"]["hit"])

    n = int(traj.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # explicit, because the work is in what follows
    base = episode_constants(episodes.repartition(n, "episode_id").join(hours.repartition(n, "episode_id"), "episode_id"), p).join(packed, list(match))
    fixed = list(dict.fromkeys([*episodes.columns, "eval0", "eval3", "exposure_hours", "exposure_days", "utility_inactive", "utility_best"]))
    rows = base.select(*fixed, F.inline(F.concat(*[found(s) for s in SCALES])))
    rows = rows.select(
        *fixed, "op", F.coalesce(F.col("of.tau").cast("double"), F.lit(INF)).alias("tau"), F.col("of.n").alias("n_alert_episodes"),
        (F.col("utility_inactive") + F.col("of.gain")).alias("utility_observed"))
    return classify(rows, p)


def outcomes(traj: DataFrame, episodes: DataFrame, thresholds: DataFrame, p: Params,
             match: Sequence[str] = ("site",), labels: Sequence[str] = ("method", "alpha"),
             keep_op: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per-episode outcome table: every episode with every threshold of its site.

    Alert results come back as one map per episode, so the join moves one row per
    episode; what does not depend on the threshold is computed there, and the methods
    are expanded last. ``keep_op`` drops thresholds per episode before the expansion.
    The partition count is explicit because the rows grow after that shuffle.
    """
    found = alerts(alert_hours(traj, thresholds, match), p).groupBy("episode_id").agg(
        F.map_from_entries(F.collect_list(F.struct("op", F.struct("tau", "n_alert_episodes", "gain")))).alias("_found"))
    op_list = F.sort_array(F.collect_list(F.struct("op", *labels))).alias("_ops")
    ops = broadcast_if_small(thresholds.groupBy(*match).agg(op_list), thresholds)
    n = int(traj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = episode_constants(episodes, p).repartition(n, "episode_id").join(found.repartition(n, "episode_id"), "episode_id", "left")
    base = base.join(ops, list(match))
    listed = F.col("_ops") if keep_op is None else F.filter("_ops", keep_op)
    fixed = list(dict.fromkeys([*episodes.columns, "eval0", "eval3", "exposure_hours", "exposure_days", "utility_inactive", "utility_best"]))
    rows = base.select(*fixed, "_found", F.explode(listed).alias("_op"))
    rows = rows.withColumn("_hit", F.when(F.col("_found").isNotNull(), F.try_element_at("_found", F.col("_op.op"))))
    rows = rows.select(
        *fixed, F.col("_op.op").alias("op"), *[F.col(f"_op.{c}").alias(c) for c in labels],
        F.coalesce(F.col("_hit.tau").cast("double"), F.lit(INF)).alias("tau"),
        F.coalesce("_hit.n_alert_episodes", F.lit(0)).alias("n_alert_episodes"),
        (F.col("utility_inactive") + F.coalesce("_hit.gain", F.lit(0.0))).alias("utility_observed"))
    return classify(rows, p)


def episode_constants(episodes: DataFrame, p: Params) -> DataFrame:
    """Evaluability, exposure and base utilities: the same under every threshold."""
    inactive, best = base_utilities(p)
    return (episodes.withColumn("eval0", window_evaluable(p, 0)).withColumn("eval3", window_evaluable(p, p.short_lead))
            .withColumn("exposure_hours", eligible_hours(p))
            .withColumn("exposure_days", F.col("exposure_hours") / F.lit(24.0))
            .withColumn("utility_inactive", inactive).withColumn("utility_best", best))


def classify(rows: DataFrame, p: Params) -> DataFrame:
    """Outcome flags from the first alert hour tau of rows with ``episode_constants``."""
    alerted = F.col("tau") < F.lit(INF)
    lead = F.when(alerted & F.col("event"), F.col("onset") - F.col("tau"))
    in_window = lambda lo: F.coalesce((lead >= lo) & (lead <= p.warning_hours), F.lit(False))
    return (rows.withColumn("alerted", alerted)
            .withColumn("valid0", F.col("eval0") & in_window(0))
            .withColumn("valid3", F.col("eval3") & in_window(p.short_lead))
            .withColumn("premature", F.col("eval0") & F.coalesce(lead > p.warning_hours, F.lit(False))))
