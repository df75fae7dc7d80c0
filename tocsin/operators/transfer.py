"""Cross-site transfer and repeated partitions, as keyed tables instead of loops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import ratio
from tocsin.functions.tables import each
from tocsin.operators.alerts import episode_constants, episode_hits, outcomes
from tocsin.operators.calibrate import high_confidence_thresholds, marginal_thresholds, number_ops
from tocsin.operators.metrics import count_if, non_event
from tocsin.operators.ranking import distinct_values, group_sizes
from tocsin.operators.split import nested_prefixes, non_event_order, prefix_shortfalls, stratified_split
from tocsin.params import Params
from tocsin.session import materialize

TARGET_SHARES = {"test": 0.5, "reservoir": 0.5}
LOCAL_METHODS = ("local_fixed_max", "local_time_adaptive", "local_high_confidence")


def repeated_splits(episodes: DataFrame, numbers: Sequence[int], shares: Mapping[str, float], seed: int,
                    stream: str, strata: Sequence[str] = ("site", "event"), number: str = "partition") -> DataFrame:
    """Independent splits for every number, in one job: adds (number, split)."""
    n = int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # explicit, because the rows grow here
    rows = episodes.repartition(n, "episode_id").withColumn(number, F.explode(F.array(*[F.lit(int(i)) for i in numbers])))
    name = F.concat_ws("|", F.lit(stream), F.col(number).cast("string"))
    return stratified_split(rows, shares, seed, name, strata, extra=[number])


def reservoir_prefixes(split: DataFrame, sizes: Sequence[int], seed: int, number: str = "partition") -> DataFrame:
    """Nested non-event prefixes of every reservoir that holds them; for the others see ``shortfalls``."""
    name = F.concat_ws("|", F.lit("reservoir"), F.col(number).cast("string"))
    ordered = non_event_order(split.where("split = 'reservoir'"), seed, name, ["site", number], max(sizes))
    return nested_prefixes(ordered, sizes).where("available >= target_m0")


def shortfalls(split: DataFrame, sizes: Sequence[int], number: str = "partition") -> DataFrame:
    """(site, number, target_m0, method, m0) of the local thresholds that a reservoir of m0 < target_m0
    non-events cannot give; their results are undefined, not absent."""
    keys = ["site", number]
    short = prefix_shortfalls(split.where("split = 'reservoir' and not event"), sizes, keys)
    return each(short.withColumnRenamed("available", "m0"), "method", LOCAL_METHODS)


def local_thresholds(prefixes: DataFrame, maxima: DataFrame, alpha: float, delta: float,
                     number: str = "partition") -> DataFrame:
    """Fixed, time-adaptive and high-confidence thresholds of every prefix. ``maxima``
    has (episode_id, max_score, max_z), max_z from the source template."""
    keys = ["site", number, "target_m0"]
    rows = materialize(prefixes.select(*keys, "episode_id").join(
        maxima.select("episode_id", "max_score", "max_z"), "episode_id"), "prefix-maxima")
    sizes = group_sizes(rows, keys)
    alphas = [alpha]
    scores = distinct_values(rows, keys, "max_score")
    zs = distinct_values(rows, keys, "max_z")
    return (marginal_thresholds(scores, sizes, alphas, keys, "max_score", "local_fixed_max")
            .unionByName(marginal_thresholds(zs, sizes, alphas, keys, "max_z", "local_time_adaptive", "z"))
            .unionByName(high_confidence_thresholds(scores, sizes, alphas, keys, "max_score", delta, "local_high_confidence")))


def direct_thresholds(source: DataFrame, numbers: Sequence[int], site_map: Mapping[str, str],
                      number: str = "partition") -> DataFrame:
    """The source site's threshold for each target site (``site_map``: source to target),
    repeated for every partition, with target_m0 0."""
    target = F.create_map(*[F.lit(x) for pair in site_map.items() for x in pair])
    return (source.withColumn("site", F.try_element_at(target, F.col("site"))).where("site is not null")
            .withColumn("method", F.lit("direct_transfer")).withColumn("target_m0", F.lit(0))
            .withColumn(number, F.explode(F.array(*[F.lit(int(i)) for i in numbers]))))


def transfer_thresholds(direct: DataFrame, local: DataFrame, number: str = "partition") -> DataFrame:
    columns = ["site", number, "target_m0", "method", "alpha", "scale", "threshold", "m0", "k", "alpha_m0"]
    return number_ops(direct.select(*columns).unionByName(local.select(*columns)), ["site", number, "target_m0"])


def test_numbers(split: DataFrame, number: str = "partition") -> DataFrame:
    """Written episodes with ``_tests``, the partitions where they are test episodes."""
    return materialize(split.where("split = 'test'").groupBy("episode_id", "site", "event", "onset", "horizon").agg(F.collect_set(number).alias("_tests")), "target-tests")


def target_hits(traj: DataFrame, tests: DataFrame, thresholds: DataFrame, p: Params, number: str = "partition") -> DataFrame:
    """The rows of ``target_outcomes`` with an hour above the threshold; ``tests`` from ``test_numbers``."""
    return episode_hits(traj, tests, thresholds, p, ("site",), (number,),
                        keep_op=lambda op: F.array_contains("_tests", op[number])).drop("_tests")


def target_summary(traj: DataFrame, split: DataFrame, thresholds: DataFrame, p: Params, number: str = "partition") -> DataFrame:
    """``metrics.summary`` of ``target_outcomes`` per threshold, without a row per episode and threshold.

    What an episode adds under every threshold of a partition is summed per (site, partition);
    only episodes with an hour above a threshold add to the sums of that threshold.
    """
    c, keys = F.col, ["site", number]
    tests = test_numbers(split, number)
    n = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    constants = episode_constants(tests.repartition(n, "episode_id"), p)
    base = constants.withColumn(number, F.explode("_tests")).groupBy(*keys).agg(
        F.count("*").alias("_n"), count_if(non_event()).alias("n_non_events"), count_if(c("event")).alias("n_events"), count_if(c("eval3")).alias("n_sens3"),
        count_if(c("eval0")).alias("n_sens0"), *[F.sum(x).alias(x) for x in ("exposure_days", "utility_inactive", "utility_best")])
    hits = target_hits(traj, tests, thresholds, p, number)
    sums = hits.groupBy("op").agg(
        count_if(non_event() & c("alerted")).alias("_false"), count_if(c("alerted")).alias("n_alerted"), count_if(c("valid3")).alias("n_valid3"),
        count_if(c("valid0")).alias("n_valid0"), count_if(c("premature")).alias("_premature"), F.sum("n_alert_episodes").alias("total_alert_episodes"),
        F.sum(c("utility_observed") - c("utility_inactive")).alias("_gain"),
        F.percentile(F.when(c("valid0"), c("onset") - c("tau")), F.lit(0.5)).alias("median_lead"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    rows = thresholds.join(base, keys).join(sums, "op", "left").select(
        *keys, "target_m0", "method", "alpha", F.element_at("threshold", 1).alias("threshold"), "m0", "k", "alpha_m0", "_n", "n_non_events", "n_events", "n_sens3", "n_sens0",
        "exposure_days", "utility_inactive", "utility_best", "median_lead", *[zero(x) for x in ("_false", "n_alerted", "n_valid3", "n_valid0", "_premature", "total_alert_episodes", "_gain")])
    return rows.select(
        *keys, "target_m0", "method", "alpha", ratio(c("_false"), c("n_non_events")).alias("pfa"), ratio(c("n_valid3"), c("n_sens3")).alias("sens3"),
        ratio(c("n_valid0"), c("n_sens0")).alias("sens0"), ratio(c("n_valid3"), c("n_alerted")).alias("ppv3"),
        ratio(100 * c("total_alert_episodes"), c("exposure_days")).alias("alerts_per_100d"),
        ratio(c("_gain"), c("utility_best") - c("utility_inactive")).alias("utility"),
        ratio(c("_premature"), c("n_sens0")).alias("premature"), "median_lead", ratio(c("n_valid0"), c("n_alerted")).alias("ppv0"),
        (c("total_alert_episodes") / c("_n")).alias("episodes_per_patient"), (c("utility_inactive") + c("_gain")).alias("raw_utility"),
        "n_non_events", "n_events", "n_sens3", "n_sens0", "n_alerted", "n_valid3", "n_valid0", "total_alert_episodes", "exposure_days",
        "threshold", "m0", "k", "alpha_m0")


def target_curves(traj: DataFrame, split: DataFrame, thresholds: DataFrame, p: Params, hmax: int, number: str = "partition") -> DataFrame:
    """``metrics.cumulative_false_alerts`` of ``target_outcomes`` per threshold, from first alerts alone."""
    keys = ["site", number, "target_m0", "method"]
    first = target_hits(traj, test_numbers(split, number), thresholds, p, number).where(non_event() & (F.col("tau") <= hmax))
    counts = first.groupBy("op", F.col("tau").cast("int").alias("hour")).agg(F.count("*").alias("_n"))
    counts = counts.groupBy("op").agg(F.map_from_entries(F.collect_list(F.struct("hour", "_n"))).alias("_at"))
    totals = split.where((F.col("split") == "test") & non_event()).groupBy("site", number).agg(F.count("*").alias("denominator"))
    rows = thresholds.join(totals, ["site", number]).join(counts, "op", "left").select(
        "op", *keys, "denominator", "_at", F.explode(F.sequence(F.lit(1), F.lit(hmax))).alias("hour"))
    upto = F.sum(F.coalesce(F.try_element_at("_at", F.col("hour")), F.lit(0))).over(Window.partitionBy("op").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, "hour", (upto / F.col("denominator")).alias("estimate"), "denominator")


def target_outcomes(traj: DataFrame, split: DataFrame, thresholds: DataFrame, p: Params,
                    number: str = "partition") -> DataFrame:
    """Outcomes of every target episode in the partitions where it is a test episode."""
    rows = outcomes(traj, test_numbers(split, number), thresholds, p, ("site",), (number, "target_m0", "method", "alpha"),
                    keep_op=lambda op: F.array_contains("_tests", op[number]))
    return rows.drop("_tests")


def descriptive_summary(frame: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Median, quartiles, range and number of defined values per group and metric. A
    group holds one value per partition."""
    value = F.col("value")
    long = frame.select(*group, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(group), list(metrics), "metric", "value")
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy(*group, "metric").agg(
        F.count("value").alias("n_defined"), q.alias("_q"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    ).select(*group, "metric", "n_defined", F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(0)).alias("q1"),
             F.get("_q", F.lit(2)).alias("q3"), "minimum", "maximum")


def all_recorded_pfa(patients: DataFrame, extra: DataFrame) -> DataFrame:
    """PFA with never-eligible non-events in the denominator; they cannot alert.
    ``extra`` holds the sampled excluded episodes."""
    n_extra = extra.agg(F.count("*")).scalar()
    non = ~F.col("event")
    base = patients.agg(F.count(F.when(non & F.col("alerted"), 1)).alias("n_alerted"), F.count(F.when(non, 1)).alias("_n"))
    return base.withColumn("below_landmark", n_extra).select(
        ((F.col("n_alerted") / (F.col("_n") + F.col("below_landmark")))).alias("pfa"),
        (F.col("_n") + F.col("below_landmark")).alias("n_non_events"), "n_alerted", "below_landmark")


def direction(site_map: Mapping[str, str], site: Column | str = "site") -> Column:
    """Text ``source_to_target`` for a target site."""
    back = F.create_map(*[F.lit(x) for s, t in site_map.items() for x in (t, s)])
    site = F.col(site) if isinstance(site, str) else site
    return F.concat(F.try_element_at(back, site), F.lit("_to_"), site)
