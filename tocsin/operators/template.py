"""Time template: per-bin location and scale of non-event scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import bin_index, finite, last_eligible_hour
from tocsin.functions.tables import each_row, values
from tocsin.operators.ranking import weighted_quantile
from tocsin.params import Params
from tocsin.session import materialize


@dataclass(frozen=True)
class TimeTemplate:
    boundaries: tuple[int, ...]
    locations: tuple[float, ...]
    scales: tuple[float, ...]
    counts: tuple[int, ...]


def reached_bins(p: Params) -> Column:
    """How many of the unmerged bins hold an eligible hour of the episode. Eligible
    hours are one run starting at tmin, so bins 0..n-1 are the ones reached."""
    last = last_eligible_hour(p)
    starts = [p.tmin, *[lo + 1 for lo in p.boundaries[1:-1]]]
    return sum((F.when(last >= s, 1).otherwise(0) for s in starts), F.lit(0))


def bin_episode_counts(episodes: DataFrame, p: Params) -> DataFrame:
    """Episodes with an eligible hour in each unmerged bin: (bin, lo, hi, n_episodes)."""
    cuts = p.boundaries
    bins = values(episodes.sparkSession, ["bin", "lo", "hi"],
                  [(b, cuts[b], cuts[b + 1]) for b in range(len(cuts) - 1)])
    hist = episodes.select(reached_bins(p).alias("reached")).groupBy("reached").count()
    return (bins.join(hist, hist["reached"] > bins["bin"], "left")
            .groupBy("bin", "lo", "hi").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_episodes")))


def merge_bins(cuts: Sequence[int], hist: Mapping[int, int], minimum: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Merge sparse bins on the counts of ``reached_bins`` (at most bins + 1 numbers).

    The latest bin with fewer than ``minimum`` episodes joins its left neighbour, the
    first one its right neighbour, until all are large enough or one bin is left.
    """
    original = list(cuts)
    current = list(cuts)

    def counts() -> list[int]:
        firsts = [original.index(lo) for lo in current[:-1]]
        return [sum(n for reached, n in hist.items() if reached > first) for first in firsts]

    while len(current) > 2:
        small = [b for b, n in enumerate(counts()) if n < minimum]
        if not small:
            break
        current.pop(max(small[-1], 1))
    return tuple(current), tuple(counts())


def fit_time_templates(
    traj: DataFrame, episodes: DataFrame, p: Params, key: str | None = None, value: str = "score",
    hmax_of: Mapping[object, int] | None = None,
) -> dict[object, TimeTemplate]:
    """Fit one template per value of ``key`` (or one under the key None).

    ``traj`` and ``episodes`` hold the non-event validation episodes. Location is the
    episode-equal weighted median per bin, scale is 1.4826 times the weighted median
    deviation with a floor. Only bin counts and the fitted bins reach the driver.
    ``hmax_of`` gives an hour limit per key value.
    """
    keys = [key] if key else []
    limits = dict(hmax_of) if hmax_of else None
    if limits is None:
        hist_rows = episodes.groupBy(*keys, reached_bins(p).alias("reached")).count().collect()
        names = {r[key] if key else None for r in hist_rows} or {None}
        params = {n: p for n in names}
    else:
        params = {n: p.with_(hmax=h) for n, h in limits.items()}
        reached = F.lit(0)
        for n, q in params.items():
            reached = F.when(F.col(key) == n, reached_bins(q)).otherwise(reached)
        hist_rows = episodes.groupBy(*keys, reached.alias("reached")).count().collect()
    merged = {}
    for n, q in params.items():
        hist = {r["reached"]: r["count"] for r in hist_rows if not key or r[key] == n}
        merged[n] = merge_bins(q.boundaries, hist, q.min_episodes)

    bin_col = F.lit(None).cast("int")
    for n, (cuts, _) in merged.items():
        b = bin_index("t", cuts)
        bin_col = F.when(F.col(key) == n, b).otherwise(bin_col) if key else b
    x = finite(value)
    rows = traj.where(F.col("eligible") & x.isNotNull()).select(
        *keys, "episode_id", bin_col.alias("bin"), x.alias("x"))
    per_episode = Window.partitionBy(*keys, "episode_id", "bin")
    rows = materialize(rows.withColumn("w", F.lit(1.0) / F.count("*").over(per_episode)), "template-rows")
    half = [(0.5, 0.5)]
    on = [*keys, "bin"]
    loc = materialize(weighted_quantile(rows, on, "x", "w", half, out="loc").drop("prob"), "template-loc")
    dev = rows.join(F.broadcast(loc), on).withColumn("dev", F.abs(F.col("x") - F.col("loc")))
    mad = weighted_quantile(dev, on, "dev", "w", half, out="mad").drop("prob")
    fitted = {(r[key] if key else None, r["bin"]): (r["loc"], r["mad"]) for r in loc.join(mad, on).collect()}
    out = {}
    for n, (cuts, counts) in merged.items():
        locations, scales = [], []
        for b in range(len(cuts) - 1):
            if (n, b) in fitted:
                location, deviation = fitted[(n, b)]
                locations.append(location)
                scales.append(max(1.4826 * deviation, params[n].scale_floor))
            else:
                locations.append(0.0)
                scales.append(1.0)
        out[n] = TimeTemplate(cuts, tuple(locations), tuple(scales), counts)
    return out


def standardized(value: Column | str, t: Column | str, templates: Mapping[object, TimeTemplate],
                 key: Column | str | None = None, digits: int | None = None) -> Column:
    """``(value - location) / scale`` of the hour's bin, as one expression of the at
    most six literals per template."""
    value = F.col(value) if isinstance(value, str) else value
    t = F.col(t) if isinstance(t, str) else t
    key = F.col(key) if isinstance(key, str) else key
    out = F.lit(None).cast("double")
    for name, tpl in templates.items():
        z = (value - tpl.locations[-1]) / tpl.scales[-1]
        for i in range(len(tpl.locations) - 2, -1, -1):
            z = F.when(t <= tpl.boundaries[i + 1], (value - tpl.locations[i]) / tpl.scales[i]).otherwise(z)
        out = z if key is None else F.when(key == name, z).otherwise(out)
    return F.round(out, digits) if digits is not None else out


def add_standardized(traj: DataFrame, templates: Mapping[object, TimeTemplate], p: Params,
                     key: str | None = None) -> DataFrame:
    """Add z and prev_z (each hour with the bin of that hour)."""
    return (traj.withColumn("z", standardized("score", "t", templates, key, p.score_digits))
            .withColumn("prev_z", standardized("prev_score", F.col("t") - 1, templates, key, p.score_digits)))


def template_table(spark, templates: Mapping[object, TimeTemplate], key: str = "template") -> DataFrame:
    """One row per bin: (key, bin, lo, hi, loc, scale, n_episodes)."""
    rows = [
        (str(name) if name is not None else "pooled", b, tpl.boundaries[b], tpl.boundaries[b + 1],
         tpl.locations[b], tpl.scales[b], tpl.counts[b])
        for name, tpl in templates.items() for b in range(len(tpl.locations))
    ]
    return values(spark, [key, "bin", "lo", "hi", "loc", "scale", "n_episodes"], rows)


def raw_boundary(template: TimeTemplate, thresholds: DataFrame) -> DataFrame:
    """Time boundary on the score scale, ``loc + c * scale``, per bin and threshold."""
    bins = [(b, loc, scale) for b, (loc, scale) in enumerate(zip(template.locations, template.scales))]
    return each_row(thresholds, ["bin", "loc", "scale"], bins).withColumn(
        "raw_boundary", F.col("loc") + F.element_at("threshold", 1) * F.col("scale"))
