"""Stratified whole-episode bootstrap.

Episodes of a stratum get dense positions in a hashed order, and buckets of neighbouring
positions go to tasks once. There every replicate is drawn in place (``multinomial``): the
draws of a bucket follow from the seed and the stratum's size alone, so drawn rows are never
exchanged, and what a replicate draws does not depend on statistics or partitions.

* Ratio metrics and curves are sums over episodes weighted by multiplicities. Each episode is
  a sparse row of features, a bucket is one matrix product (replicates by episodes times
  episodes by features), and only sums per replicate and feature leave the task.
* Any other statistic is an aggregate over the drawn rows, partly aggregated where they arise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions.exprs import INF, ratio
from tocsin.functions.tables import each_row
from tocsin.operators import multinomial
from tocsin.operators.metrics import RATIO_METRICS, cumulative_false_alerts
from tocsin.operators.multinomial import SLOTS
from tocsin.operators.ranking import hash_rank
from tocsin.session import materialize


def stratum_label(strata: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in strata])


def indexed_episodes(episodes: DataFrame, strata: Sequence[str], seed: int) -> DataFrame:
    """(stratum, position, stratum_size, episode columns): dense positions from 1."""
    labelled = episodes.withColumn("stratum", stratum_label(strata))
    return hash_rank(labelled, ["stratum"], "episode_id", seed, "boot-order", "position", "stratum_size")


def in_buckets(indexed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Indexed episodes by bucket and slot, every bucket in one task and in order."""
    place = F.col("position") - 1
    rows = indexed.withColumn("bucket", F.floor(place / slots)).withColumn("slot", (place % slots).cast("int"))
    return rows.repartition("stratum", "bucket").sortWithinPartitions("stratum", "bucket", "slot")


def with_draws(indexed: DataFrame, replicates: int, seed: int, slots: int = SLOTS) -> DataFrame:
    """Indexed episodes with ``draws``, an array of (bootstrap, multiplicity)."""
    rows = in_buckets(indexed, slots)
    pair = T.StructType([T.StructField("bootstrap", T.IntegerType()), T.StructField("multiplicity", T.LongType())])
    schema = T.StructType([*rows.schema.fields, T.StructField("draws", T.ArrayType(pair))])
    return rows.mapInArrow(multinomial.with_draws(replicates, seed, slots), schema).drop("bucket", "slot")


def multiplicities(indexed: DataFrame, replicates: int, seed: int, slots: int = SLOTS) -> DataFrame:
    """(stratum, position, bootstrap, multiplicity) of the drawn episodes."""
    drawn = with_draws(indexed.select("stratum", "position", "stratum_size"), replicates, seed, slots)
    return drawn.select("stratum", "position", F.inline("draws"))


def resampled(episodes: DataFrame, strata: Sequence[str], replicates: int, seed: int, slots: int = SLOTS) -> DataFrame:
    """Episode rows with (bootstrap, multiplicity), one row per drawn distinct episode."""
    drawn = with_draws(indexed_episodes(episodes, strata, seed), replicates, seed, slots).drop("stratum_size")
    return drawn.select(*[c for c in drawn.columns if c != "draws"], F.inline("draws"))


def replicate_sums(episodes: DataFrame, strata: Sequence[str], replicates: int, seed: int, slots: int = SLOTS) -> DataFrame:
    """(stratum, feature, bootstrap, x): weighted sums of the sparse column ``features``, an
    array of (f long, x double) that may be empty but not null."""
    rows = in_buckets(indexed_episodes(episodes.select("episode_id", *strata, "features"), strata, seed), slots)
    rows = rows.select("stratum", "bucket", "slot", "stratum_size", "features")
    sums = rows.mapInArrow(multinomial.weighted_sums(replicates, seed, slots), "stratum string, feature long, sums array<double>")
    flat = sums.select("stratum", "feature", F.posexplode("sums").alias("bootstrap", "x"))
    return flat.groupBy("stratum", "feature", "bootstrap").agg(F.sum("x").alias("x"))


def bootstrap_statistics(episodes: DataFrame, statistics: Mapping[str, Callable[[Column], Column]],
                         strata: Sequence[str], replicates: int, seed: int, slots: int = SLOTS) -> DataFrame:
    """Bootstrap any statistics given as functions from the multiplicity column to an
    aggregate over episode columns, e.g. ``lambda w: F.sum(x * w) / F.sum(w)``."""
    w = F.col("multiplicity")
    rows = resampled(episodes, strata, replicates, seed, slots)
    return rows.groupBy("bootstrap").agg(*[f(w).alias(name) for name, f in statistics.items()])


def compact_outcomes(patients: DataFrame) -> DataFrame:
    """One row per episode: its method-independent sums and the array of the
    thresholds under which it alerted."""
    hit = F.when(F.col("alerted"), F.struct(
        F.col("op"), F.col("tau"), F.col("valid3").cast("int").alias("valid3"),
        F.col("valid0").cast("int").alias("valid0"), F.col("n_alert_episodes"),
        (F.col("utility_observed") - F.col("utility_inactive")).alias("gain")))
    # predictions after the onset earn utility without an alert
    quiet = F.when(~F.col("alerted") & (F.col("utility_observed") != F.col("utility_inactive")), F.struct(
        F.col("op"), F.lit(INF).alias("tau"), F.lit(0).alias("valid3"), F.lit(0).alias("valid0"),
        F.lit(0).alias("n_alert_episodes"), (F.col("utility_observed") - F.col("utility_inactive")).alias("gain")))
    first = lambda c: F.first(c).alias(c)
    return patients.groupBy("episode_id").agg(
        first("site"), first("event"), first("eval3"), first("eval0"), first("exposure_days"),
        first("utility_inactive"), first("utility_best"), F.collect_list(F.coalesce(hit, quiet)).alias("hits"))


def bootstrap_metrics(patients: DataFrame, ops: DataFrame, strata: Sequence[str], replicates: int,
                      seed: int, slots: int = SLOTS, by: Sequence[str] = ()) -> DataFrame:
    """Resampled ratio metrics of every threshold with common draws, over all strata or apart
    for each value of the strata columns ``by``, which ``ops`` then holds, too.

    ``ops`` maps ``op`` to label columns (small). Feature 6 op + i holds the i-th sum of a
    threshold, op 0 the denominators, which do not depend on the method; an episode only has
    features of thresholds under which it alerts.
    """
    c = F.col
    i = lambda x: x.cast("double")

    def cells(op: Column, sums: Sequence[Column]) -> Column:
        return F.array(*[F.struct((op.cast("long") * 6 + j).alias("f"), x.alias("x")) for j, x in enumerate(sums)])

    base = cells(F.lit(0), [i(~c("event")), i(c("eval3")), i(c("eval0")), i(c("exposure_days")), i(c("utility_inactive")), i(c("utility_best"))])
    alerted = lambda h: h["tau"] < F.lit(INF)
    per_op = F.flatten(F.transform("hits", lambda h: cells(h["op"], [
        i(~c("event") & alerted(h)), i(h["valid3"]), i(h["valid0"]), i(h["n_alert_episodes"]), i(h["gain"]), i(alerted(h))])))
    features = F.filter(F.concat(base, per_op), lambda x: x["x"] != 0)
    rows = compact_outcomes(patients).select("episode_id", *strata, features.alias("features"))
    sums = replicate_sums(rows, strata, replicates, seed, slots)
    by = list(by)
    if by:
        names = rows.select(stratum_label(strata).alias("stratum"), *by).distinct()
        sums = sums.join(F.broadcast(names), "stratum")  # a row for each stratum
    sums = materialize(sums, "boot-sums")
    value = lambda op, j: F.sum(F.when(c("feature") == 6 * op + j, c("x")))
    den = sums.where("feature < 6").groupBy(*by, "bootstrap").agg(*[F.coalesce(value(0, j), F.lit(0.0)).alias(f"{x}0") for j, x in enumerate("abcdef")])
    num = sums.where("feature >= 6").withColumn("op", F.floor(c("feature") / 6).cast("int")).groupBy(*by, "bootstrap", "op").agg(
        *[value(c("op"), j).alias(x) for j, x in enumerate("abcdef")])
    grid = den.join(F.broadcast(ops), by) if by else each_row(den, ops.columns, [tuple(r) for r in ops.collect()])
    out = grid.join(num, [*by, "bootstrap", "op"], "left")
    z = lambda x: F.coalesce(c(x), F.lit(0.0))
    return out.select(
        "bootstrap", *[x for x in ops.columns],
        ratio(z("a"), c("a0")).alias("pfa"), ratio(z("b"), c("b0")).alias("sens3"),
        ratio(z("c"), c("c0")).alias("sens0"), ratio(z("b"), z("f")).alias("ppv3"),
        ratio(100 * z("d"), c("d0")).alias("alerts_per_100d"),
        ratio(z("e"), c("f0") - c("e0")).alias("utility"))


def long_metrics(samples: DataFrame, keys: Sequence[str], metrics: Sequence[str] = RATIO_METRICS) -> DataFrame:
    return samples.unpivot([*keys], list(metrics), "metric", "value")


def summarize_bootstrap(samples: DataFrame, observed: DataFrame, keys: Sequence[str],
                        metrics: Sequence[str] = RATIO_METRICS) -> DataFrame:
    """SE, 2.5 and 97.5 % quantiles and number of defined replicates per key and metric,
    beside the observed value. A group holds one value per replicate."""
    keys = list(keys)
    spread = long_metrics(samples, [*keys, "bootstrap"], metrics).groupBy(*keys, "metric").agg(
        F.stddev_samp("value").alias("bootstrap_se"),
        F.percentile("value", F.lit(0.025)).alias("lower_95"), F.percentile("value", F.lit(0.975)).alias("upper_95"),
        F.count("value").alias("valid_bootstrap"))
    obs = long_metrics(observed, keys, metrics).withColumnRenamed("value", "observed")
    return obs.join(spread, [*keys, "metric"], "left")


def paired_contrasts(samples: DataFrame, observed: DataFrame, reference: str, pair: Sequence[str] = ("alpha",),
                     method: str = "method", metrics: Sequence[str] = RATIO_METRICS,
                     exclude: Sequence[str] = ()) -> DataFrame:
    """Differences of every method to the reference method over common draws."""
    pair = list(pair)

    def differences(df: DataFrame, on: list[str]) -> DataFrame:
        rows = long_metrics(df, [*on, method], metrics)
        ref = rows.where(F.col(method) == reference).select(*on, "metric", F.col("value").alias("_ref"))
        others = rows.where((F.col(method) != reference) & ~F.col(method).isin(list(exclude)))
        return others.join(ref, [*on, "metric"]).withColumn("diff", F.col("value") - F.col("_ref"))

    spread = differences(samples, [*pair, "bootstrap"]).groupBy(*pair, method, "metric").agg(
        F.stddev_samp("diff").alias("bootstrap_se"), F.percentile("diff", F.lit(0.025)).alias("lower_95"),
        F.percentile("diff", F.lit(0.975)).alias("upper_95"), F.count("diff").alias("valid_bootstrap"))
    obs = differences(observed, pair).select(*pair, method, "metric", F.col("diff").alias("observed_difference"))
    return obs.join(spread, [*pair, method, "metric"], "left").withColumn(
        "comparison", F.concat(F.col(method), F.lit(f" minus {reference}"))).drop(method)


def curve_bands(patients: DataFrame, ops: DataFrame, hmax: int, replicates: int, seed: int, slots: int = SLOTS) -> DataFrame:
    """Cumulative first-false-alert curve with bootstrap bands, overall (drawn by site) and per
    site: (panel, op labels, hour, estimate, denominator, lower_95, upper_95).

    An alert adds one at its hour; these differences are summed per replicate, site and
    threshold, panels by grouping sets, and one cumulative sum at the end gives the curves.
    """
    c, width = F.col, hmax + 1
    non = patients.where(~c("event"))
    hits = F.filter("hits", lambda h: h["tau"] <= F.lit(hmax))
    steps = F.transform(hits, lambda h: F.struct((h["op"].cast("long") * width + h["tau"].cast("long")).alias("f"), F.lit(1.0).alias("x")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("f"), F.lit(1.0).alias("x")))
    rows = compact_outcomes(non).select("episode_id", "site", F.concat(one, steps).alias("features"))
    sums = replicate_sums(rows, ["site"], replicates, seed, slots)
    panels = sums.groupingSets([["feature", "bootstrap"], ["stratum", "feature", "bootstrap"]], "stratum", "feature", "bootstrap").agg(F.sum("x").alias("x"))
    panels = materialize(panels.select(F.coalesce("stratum", F.lit("overall")).alias("panel"), "feature", "bootstrap", "x"), "curve-steps")
    total = panels.where("feature = 0").select("panel", "bootstrap", c("x").alias("n"))
    at = panels.where("feature > 0").select("panel", "bootstrap", F.floor(c("feature") / width).cast("int").alias("op"), (c("feature") % width).cast("int").alias("hour"), "x")
    by_op = at.groupBy("panel", "bootstrap", "op").agg(F.map_from_entries(F.collect_list(F.struct("hour", "x"))).alias("at"))
    labels = [x for x in ops.columns if x != "op"]
    curve = (each_row(total, ops.columns, [tuple(r) for r in ops.collect()]).join(by_op, ["panel", "bootstrap", "op"], "left")
             .select("panel", "bootstrap", "op", *labels, "n", "at", F.explode(F.sequence(F.lit(1), F.lit(hmax))).alias("hour")))
    run = Window.partitionBy("panel", "bootstrap", "op").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.try_element_at("at", c("hour")), F.lit(0.0))
    curve = curve.withColumn("p", F.sum(step).over(run) / c("n"))
    bands = curve.groupBy("panel", *labels, "hour").agg(
        F.percentile("p", F.lit(0.025)).alias("lower_95"), F.percentile("p", F.lit(0.975)).alias("upper_95"))
    by_panel = non.withColumn("panel", F.explode(F.array(F.lit("overall"), c("site"))))
    observed = cumulative_false_alerts(by_panel, hmax, ["panel", *labels])
    return observed.join(bands, ["panel", *labels, "hour"])
