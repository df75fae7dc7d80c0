"""Threshold rules. Every rule returns rows of the thresholds table:

(keys..., method, alpha, scale, threshold ARRAY<DOUBLE>, m0, k, alpha_m0)

``threshold`` has one element, or one per hour for the bin-wise rule; ``scale`` names
the trajectory column it applies to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.binomial import hc_index
from tocsin.functions.exprs import INF, achieved_bound, bin_index, finite, marginal_index
from tocsin.functions.tables import each, each_row
from tocsin.operators.ranking import (
    distinct_values, group_sizes, pick_ranks, prefix_sums, quantile_linear, select_ranks, weighted_quantile,
)
from tocsin.params import Params
from tocsin.session import materialize

METHODS = ("fixed_half", "youden", "pointwise", "binwise_bonferroni", "naive_max",
           "fixed_max", "time_adaptive", "high_confidence")
COLUMNS = ("method", "alpha", "scale", "threshold", "m0", "k", "alpha_m0")


def _shape(df: DataFrame, keys: Sequence[str], method: str, scale: str) -> DataFrame:
    have = set(df.columns)
    threshold = F.col("threshold")
    if not df.schema["threshold"].dataType.typeName() == "array":
        threshold = F.array(threshold)
    return df.select(
        *keys, F.lit(method).alias("method"), F.col("alpha"), F.lit(scale).alias("scale"),
        threshold.alias("threshold"), F.col("m0").cast("long").alias("m0"),
        (F.col("k") if "k" in have else F.lit(None)).cast("long").alias("k"),
        (F.col("alpha_m0") if "alpha_m0" in have else F.lit(None)).cast("double").alias("alpha_m0"),
    )


def marginal_ranks(sizes: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Rank and achieved bound for each key and alpha."""
    ranks = each(sizes, "alpha", alphas).withColumn("k", marginal_index("m0", "alpha"))
    return ranks.withColumn("alpha_m0", achieved_bound("m0", "k"))


def high_confidence_ranks(sizes: DataFrame, alphas: Sequence[float], delta: float) -> DataFrame:
    return each(sizes, "alpha", alphas).withColumn("k", hc_index(F.col("m0"), F.col("alpha"), delta))


def marginal_thresholds(counts: DataFrame, sizes: DataFrame, alphas: Sequence[float], keys: Sequence[str],
                        value: str, method: str = "fixed_max", scale: str = "score") -> DataFrame:
    """k-th smallest maximum with k = ceil((m0 + 1)(1 - alpha)), +inf for k = m0 + 1."""
    picked = pick_ranks(counts, marginal_ranks(sizes, alphas), keys, value)
    return _shape(picked, keys, method, scale)


def high_confidence_thresholds(counts: DataFrame, sizes: DataFrame, alphas: Sequence[float], keys: Sequence[str],
                               value: str, delta: float, method: str = "high_confidence") -> DataFrame:
    picked = pick_ranks(counts, high_confidence_ranks(sizes, alphas, delta), keys, value)
    return _shape(picked, keys, method, "score")


def naive_thresholds(counts: DataFrame, sizes: DataFrame, alphas: Sequence[float], keys: Sequence[str], value: str) -> DataFrame:
    """Linear-interpolation (1 - alpha) quantile of the maxima."""
    q = quantile_linear(counts, keys, value, [(a, 1.0 - a) for a in alphas], "alpha", "threshold")
    full = each(sizes, "alpha", alphas).join(q, [*keys, "alpha"], "left")
    return _shape(full.withColumn("threshold", F.coalesce("threshold", F.lit(INF))), keys, "naive_max", "score")


def pointwise_thresholds(traj: DataFrame, sizes: DataFrame, alphas: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Episode-equal weighted (1 - alpha) quantile of all eligible scores."""
    x = finite("score")
    rows = traj.where(F.col("eligible") & x.isNotNull()).select(*keys, "episode_id", x.alias("x"))
    rows = rows.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy(*keys, "episode_id")))
    q = weighted_quantile(rows, keys, "x", "w", [(a, 1.0 - a) for a in alphas], "alpha", "threshold")
    full = each(sizes, "alpha", alphas).join(q, [*keys, "alpha"], "left")
    return _shape(full.withColumn("threshold", F.coalesce("threshold", F.lit(INF))), keys, "pointwise", "score")


def binwise_values(traj: DataFrame, sizes: DataFrame, alphas: Sequence[float], keys: Sequence[str], p: Params) -> DataFrame:
    """Marginal threshold per unmerged bin at alpha / bins: (keys, alpha, m0, bin, lo, hi, k, c).

    An episode without an eligible score in a bin has the maximum -inf there. These
    are counted, not stored: they take the lowest ranks.
    """
    cuts = p.boundaries
    n_bins = len(cuts) - 1
    counts = distinct_values(bin_peaks(traj, keys, p), [*keys, "bin"], "peak")
    present = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("present"))
    bins = [(b, cuts[b], cuts[b + 1]) for b in range(n_bins)]
    ranks = (each_row(each(sizes, "alpha", alphas), ["bin", "lo", "hi"], bins).join(present, [*keys, "bin"], "left")
             .withColumn("k", marginal_index("m0", F.col("alpha") / F.lit(float(n_bins))))
             .withColumn("inner_k", F.when(F.col("k") <= F.col("m0"),
                                           F.col("k") - (F.col("m0") - F.coalesce("present", F.lit(0)))))
             .drop("present"))
    c = F.when(F.col("k") > F.col("m0"), F.lit(INF)).when(F.col("inner_k") <= 0, F.lit(-INF)).otherwise(F.col("c"))
    return select_ranks(counts, ranks, [*keys, "bin"], "peak", "inner_k", "c").withColumn("c", c).drop("inner_k")


def hourly(bin_values: DataFrame, group: Sequence[str], p: Params) -> DataFrame:
    """Spread bin thresholds over the hours 1..hmax as one array per group."""
    n_bins = len(p.boundaries) - 1
    packed = bin_values.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("_bins"))
    hours = F.sequence(F.lit(1), F.lit(p.hmax))
    return packed.where(F.size("_bins") == n_bins).select(
        *group, F.transform(hours, lambda h: F.element_at(F.col("_bins"), bin_index(h, p.boundaries) + 1)["c"]).alias("threshold"))


def binwise_thresholds(traj: DataFrame, sizes: DataFrame, alphas: Sequence[float], keys: Sequence[str], p: Params) -> DataFrame:
    spread = hourly(binwise_values(traj, sizes, alphas, keys, p), [*keys, "alpha", "m0"], p)
    return _shape(spread, keys, "binwise_bonferroni", "score")


def youden_threshold(flat: DataFrame, keys: Sequence[str] = (), tol: float = 1e-12) -> DataFrame:
    """Threshold with the largest weighted sensitivity + specificity - 1 under strict >.

    Each episode has total weight one; ties within ``tol`` go to the largest
    threshold; +inf and -inf are candidates; +inf when only one class is present.
    ``flat`` has (keys, episode_id, value, label).
    """
    keys = list(keys)
    per_episode = Window.partitionBy(*keys, "episode_id")
    rows = flat.withColumn("w", F.lit(1.0) / F.count("*").over(per_episode))
    sums = prefix_sums(rows, keys, "value", {"pos": F.col("w") * F.col("label"), "neg": F.col("w") * (1 - F.col("label"))})
    sens = (F.col("total_pos") - F.col("cum_pos")) / F.col("total_pos")
    spec = F.col("cum_neg") / F.col("total_neg")
    gain = sums.where("total_pos > 0 and total_neg > 0").select(*keys, F.col("value"), (sens + spec - 1).alias("j"))
    gain = materialize(gain, "youden")
    best = gain.groupBy(*keys).agg(F.greatest(F.max("j"), F.lit(0.0)).alias("best"))
    joined = gain.join(best, keys) if keys else gain.withColumn("best", F.lit(best.first()["best"]))
    top = joined.groupBy(*keys).agg(
        F.max(F.when(F.col("j") >= F.col("best") - tol, F.col("value"))).alias("_t"), F.max("best").alias("_best"))
    none = F.when(F.coalesce(F.col("_best"), F.lit(0.0)) <= tol, F.lit(INF)).otherwise(F.col("_t"))
    if not keys:
        return top.select(F.coalesce(none, F.lit(INF)).alias("threshold"))
    return (flat.select(*keys).distinct().join(top, keys, "left")
            .select(*keys, F.coalesce(none, F.lit(INF)).alias("threshold")))


def constant_thresholds(groups: DataFrame, alphas: Sequence[float], keys: Sequence[str], method: str,
                        threshold: float, scale: str = "risk") -> DataFrame:
    """The same threshold for every group and alpha (fixed 0.5, pooled Youden)."""
    rows = each(groups.select(*keys, "m0"), "alpha", alphas).withColumn("threshold", F.lit(float(threshold)))
    return _shape(rows, keys, method, scale)


def rank_values(maxima: DataFrame, traj: DataFrame | None, keys: Sequence[str], columns: Sequence[str],
                p: Params) -> DataFrame:
    """Values behind all rank rules in one table (keys, series, value): the named maxima
    and, with ``traj``, the largest eligible score per episode and unmerged bin."""
    long = maxima.select(*keys, *columns).unpivot(list(keys), list(columns), "series", "value")
    if traj is None:
        return long
    peaks = bin_peaks(traj, keys, p).select(*keys, F.concat(F.lit("bin"), F.col("bin")).alias("series"), F.col("peak").alias("value"))
    return long.unionByName(peaks)


def bin_peaks(traj: DataFrame, keys: Sequence[str], p: Params) -> DataFrame:
    x = finite("score")
    return (traj.where(F.col("eligible") & x.isNotNull())
            .groupBy(*keys, "episode_id", bin_index("t", p.boundaries).alias("bin")).agg(F.max(x).alias("peak")))


def calibrate(maxima: DataFrame, traj: DataFrame, p: Params, keys: Sequence[str] = ("site",),
              alphas: Sequence[float] | None = None, methods: Sequence[str] | None = None,
              youden: float | None = None) -> DataFrame:
    """All threshold rules for every group and alpha, from non-event calibration episodes.

    ``maxima`` has (keys, max_score, max_z), one row per episode; ``traj`` the eligible
    rows behind them. The rank rules share one table of value counts and one lookup.
    Returns a materialized thresholds table with the column ``op``, a small integer
    that names the row.
    """
    keys = list(keys)
    methods = set(methods or METHODS)
    table = list(alphas or p.alphas)
    cuts = p.boundaries if "binwise_bonferroni" in methods else ()
    n_bins = len(cuts) - 1
    columns = [c for c, use in (("max_score", {"fixed_max", "high_confidence", "naive_max"}), ("max_z", {"time_adaptive"})) if methods & use]
    values_long = rank_values(maxima, traj if cuts else None, keys, columns, p)
    counts = distinct_values(values_long, [*keys, "series"], "value")
    sizes = group_sizes(maxima, keys)
    grid = each(sizes, "alpha", table)

    wanted = []
    if "fixed_max" in methods:
        wanted.append(_wanted(grid, "fixed_max", "max_score", marginal_index("m0", "alpha")))
    if "time_adaptive" in methods:
        wanted.append(_wanted(grid, "time_adaptive", "max_z", marginal_index("m0", "alpha")))
    if "high_confidence" in methods:
        wanted.append(_wanted(grid, "high_confidence", "max_score", hc_index(F.col("m0"), F.col("alpha"), p.delta)))
    if "naive_max" in methods:
        place = (F.lit(1.0) - F.col("alpha")) * (F.col("m0") - 1)
        for side, k in (("naive_lo", F.floor(place) + 1), ("naive_hi", F.ceil(place) + 1)):
            wanted.append(_wanted(grid, side, "max_score", k))
    for b in range(n_bins):
        wanted.append(_wanted(grid, f"bin{b}", f"bin{b}", marginal_index("m0", F.col("alpha") / F.lit(float(n_bins)))))

    parts = []
    if wanted:
        ranks = wanted[0]
        for part in wanted[1:]:
            ranks = ranks.unionByName(part)
        picked = materialize(_pick_series(counts, ranks, keys), "picked-ranks")
        marginal = F.col("method").isin("fixed_max", "time_adaptive")
        ranked = picked.where(F.col("method").isin("fixed_max", "time_adaptive", "high_confidence")).withColumn(
            "alpha_m0", F.when(marginal, achieved_bound("m0", "k")))
        parts.append(ranked.select(
            *keys, "method", "alpha", F.when(F.col("method") == "time_adaptive", "z").otherwise("score").alias("scale"),
            F.array("threshold").alias("threshold"), F.col("m0").cast("long").alias("m0"), F.col("k").cast("long").alias("k"), "alpha_m0"))
        if "naive_max" in methods:
            place = (F.lit(1.0) - F.col("alpha")) * (F.col("m0") - 1)
            lo = F.max(F.when(F.col("method") == "naive_lo", F.col("threshold")))
            hi = F.max(F.when(F.col("method") == "naive_hi", F.col("threshold")))
            between = picked.where(F.col("method").isin("naive_lo", "naive_hi")).groupBy(*keys, "alpha", "m0").agg(lo.alias("_lo"), hi.alias("_hi"))
            c = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")).otherwise(
                F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (place - F.floor(place)))
            parts.append(_shape(between.withColumn("threshold", c), keys, "naive_max", "score"))
        if cuts:
            bins = picked.where(F.col("series").startswith("bin")).withColumn("bin", F.substring("series", 4, 3).cast("int"))
            parts.append(_shape(hourly(bins.withColumnRenamed("threshold", "c"), [*keys, "alpha", "m0"], p), keys, "binwise_bonferroni", "score"))
    if "pointwise" in methods:
        parts.append(pointwise_thresholds(traj, sizes, table, keys))
    if "fixed_half" in methods:
        parts.append(constant_thresholds(sizes, table, keys, "fixed_half", 0.5))
    if "youden" in methods and youden is not None:
        parts.append(constant_thresholds(sizes, table, keys, "youden", youden))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return number_ops(out, keys)


def _wanted(grid: DataFrame, method: str, series: str, k) -> DataFrame:
    return grid.withColumn("method", F.lit(method)).withColumn("series", F.lit(series)).withColumn("k", k.cast("long"))


def _pick_series(counts: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Look up every wanted rank. A series with fewer values than m0 lacks episodes
    whose maximum is -inf; these hold the lowest ranks."""
    on = [*keys, "series"]
    present = counts.groupBy(*on).agg(F.sum("n").alias("present"))
    want = ranks.join(present, on, "left").withColumn(
        "inner_k", F.when(F.col("k") <= F.col("m0"), F.col("k") - (F.col("m0") - F.coalesce("present", F.lit(0))))).drop("present")
    c = F.when(F.col("k") > F.col("m0"), F.lit(INF)).when(F.col("inner_k") <= 0, F.lit(-INF)).otherwise(F.col("c"))
    return select_ranks(counts, want, on, "value", "inner_k", "c").withColumn("threshold", c).drop("c", "inner_k")


def number_ops(thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the rows of a thresholds table. Its size is groups x methods x alphas,
    independent of the data, so one ordered window is enough."""
    order = Window.orderBy(*keys, "method", "alpha")
    return materialize(thresholds.withColumn("op", F.row_number().over(order)), "thresholds")


def reference_order_statistic(reference: DataFrame, alphas: Sequence[float], value: str = "maximum") -> DataFrame:
    """ceil(N (1 - alpha))-th smallest value of a large reference table of maxima."""
    counts = distinct_values(reference, [], value)
    n = counts.agg(F.sum("n").alias("n_reference"))
    ranks = each(n, "alpha", alphas).withColumn(
        "k", F.ceil(F.col("n_reference").cast("double") * (F.lit(1.0) - F.col("alpha"))))
    return pick_ranks(counts, ranks, [], value)


def conditional_exceedance(reference: DataFrame, thresholds: DataFrame, value: str = "maximum",
                           out: str = "conditional_pfa") -> DataFrame:
    """Share of reference maxima strictly above each scalar threshold.

    Thresholds take part in the prefix sums of the reference with count 0, so each one
    finds the number of values up to it, however many thresholds there are.
    """
    rows = reference.select(F.col(value).alias("_v"), F.lit(1).cast("long").alias("_n")).unionByName(
        thresholds.select(F.col("threshold").alias("_v"), F.lit(0).cast("long").alias("_n")))
    sums = prefix_sums(rows, [], "_v", {"n": F.col("_n")})
    above = (F.col("total_n") - F.col("cum_n")) / F.col("total_n")
    return thresholds.join(sums.select("_v", above.alias(out)), F.col("threshold") == F.col("_v")).drop("_v")


def describe_methods(thresholds: DataFrame) -> DataFrame:
    """One row per method and scale: what its threshold rows tell about how they were made.

    ``per_hour``: a row holds one value per hour. ``source``: ``rank`` of the calibration
    maxima (the row has a k), ``quantile`` of calibration scores, or ``outside`` the
    calibration part (thresholds on raw risk). ``standardized``: the series needs a time
    template, which is fitted on validation non-events. ``recalibrated``: the rows name the
    number of target episodes (``target_m0``) that they were fitted on.
    """
    target = F.col("target_m0") if "target_m0" in thresholds.columns else F.lit(None)
    per = thresholds.groupBy("method", "scale").agg(
        (F.max(F.size("threshold")) > 1).alias("per_hour"), F.count("k").alias("_ranked"),
        (F.count(target) > 0).alias("recalibrated"))
    source = F.when(F.col("_ranked") > 0, "rank").when(F.col("scale") == "risk", "outside").otherwise("quantile")
    return per.select("method", "scale", "per_hour", source.alias("source"), (F.col("scale") == "z").alias("standardized"), "recalibrated")
