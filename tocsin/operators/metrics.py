"""Operating metrics as ratios of sums over the outcome table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.binomial import binomial_limits
from tocsin.functions.exprs import INF, ratio
from tocsin.functions.tables import each
from tocsin.operators.ranking import global_rank, prefix_sums
from tocsin.params import Params

RATIO_METRICS = ("pfa", "sens3", "sens0", "ppv3", "alerts_per_100d", "utility")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def mean_if(value: Column, cond: Column) -> Column:
    return F.avg(F.when(cond, value.cast("double")))


def non_event() -> Column:
    return ~F.col("event")


def ratio_metrics(weight: Column | None = None) -> list[Column]:
    """The resampled metrics as aggregates; ``weight`` is the episode multiplicity."""
    w = F.lit(1) if weight is None else weight
    n = lambda cond: F.sum(F.when(cond, w).otherwise(0))
    total = lambda c: F.sum(F.col(c) * w)
    return [
        ratio(n(non_event() & F.col("alerted")), n(non_event())).alias("pfa"),
        ratio(n(F.col("valid3")), n(F.col("eval3"))).alias("sens3"),
        ratio(n(F.col("valid0")), n(F.col("eval0"))).alias("sens0"),
        ratio(n(F.col("valid3")), n(F.col("alerted"))).alias("ppv3"),
        ratio(100 * total("n_alert_episodes"), total("exposure_days")).alias("alerts_per_100d"),
        ratio(total("utility_observed") - total("utility_inactive"),
              total("utility_best") - total("utility_inactive")).alias("utility"),
    ]


def summary(patients: DataFrame, keys: Sequence[str] = ("method", "alpha")) -> DataFrame:
    """Operating metrics per key in one aggregation; undefined ratios are NULL."""
    e0, e3, a = F.col("eval0"), F.col("eval3"), F.col("alerted")
    lead = F.when(F.col("valid0"), F.col("onset") - F.col("tau"))
    return patients.groupBy(*keys).agg(
        *ratio_metrics(),
        mean_if(F.col("premature"), e0).alias("premature"),
        F.percentile(lead, F.lit(0.5)).alias("median_lead"),
        ratio(count_if(F.col("valid0")), count_if(a)).alias("ppv0"),
        F.avg("n_alert_episodes").alias("episodes_per_patient"),
        F.sum("utility_observed").alias("raw_utility"),
        count_if(non_event()).alias("n_non_events"), count_if(F.col("event")).alias("n_events"),
        count_if(e3).alias("n_sens3"), count_if(e0).alias("n_sens0"), count_if(a).alias("n_alerted"),
        count_if(F.col("valid3")).alias("n_valid3"), count_if(F.col("valid0")).alias("n_valid0"),
        F.sum("n_alert_episodes").cast("long").alias("total_alert_episodes"),
        F.sum("exposure_days").alias("exposure_days"))


def class_components(patients: DataFrame, keys: Sequence[str] = ("method", "alpha")) -> DataFrame:
    """Rates and means per class, from which any prevalence can be standardised.

    The numerators of the standardised PPV use all events, not the evaluable ones.
    """
    ev, non = F.col("event"), non_event()
    return patients.groupBy(*keys).agg(
        count_if(non).alias("n_non_events"), count_if(ev).alias("n_events"),
        count_if(F.col("eval3")).alias("n_event_evaluable3"), count_if(F.col("eval0")).alias("n_event_evaluable0"),
        mean_if(F.col("alerted"), non).alias("any_alert_rate_non_event"),
        mean_if(F.col("alerted"), ev).alias("any_alert_rate_event"),
        mean_if(F.col("valid3"), ev).alias("valid3_rate_all_events"),
        mean_if(F.col("valid0"), ev).alias("valid0_rate_all_events"),
        mean_if(F.col("n_alert_episodes"), non).alias("mean_episodes_non_event"),
        mean_if(F.col("n_alert_episodes"), ev).alias("mean_episodes_event"),
        mean_if(F.col("exposure_days"), non).alias("mean_exposure_days_non_event"),
        mean_if(F.col("exposure_days"), ev).alias("mean_exposure_days_event"))


def standardize_prevalence(components: DataFrame, prevalences: Sequence[float]) -> DataFrame:
    """PPV and alert burden at given event prevalences, from stored components."""
    pi = F.col("prevalence")
    mix = lambda stem: (1 - pi) * F.col(f"{stem}_non_event") + pi * F.col(f"{stem}_event")
    any_alert = mix("any_alert_rate")
    return (each(components, "prevalence", [float(x) for x in prevalences])
            .withColumn("ppv3_standardized", ratio(pi * F.col("valid3_rate_all_events"), any_alert))
            .withColumn("ppv0_standardized", ratio(pi * F.col("valid0_rate_all_events"), any_alert))
            .withColumn("alert_burden_100d", ratio(100 * mix("mean_episodes"), mix("mean_exposure_days"))))


def long_stay_flags(episodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Non-event episodes in the longest quarter (ceil(n / 4)) by exposure, ties by id.

    Exposures take few values: a histogram finds the cut-off, and only episodes at the
    cut-off need a rank, which is spread over the cluster.
    """
    keys = list(keys)
    non = episodes.where(non_event()).select(*keys, "episode_id", "exposure_hours")
    hist = non.groupBy(*keys, "exposure_hours").count()
    down = Window.partitionBy(*keys).orderBy(F.desc("exposure_hours")).rowsBetween(Window.unboundedPreceding, 0)
    cut = hist.select(*keys, "exposure_hours", "count", F.sum("count").over(down).alias("_cum"),
                      F.ceil(F.sum("count").over(Window.partitionBy(*keys)) / 4).alias("_q"))
    cut = (cut.where("_cum >= _q and _cum - count < _q")
           .select(*keys, F.col("exposure_hours").alias("_cut"), (F.col("_q") - (F.col("_cum") - F.col("count"))).alias("_room")))
    if keys:
        marked = non.join(cut, keys)
    else:
        row = cut.first()
        marked = non.withColumn("_cut", F.lit(row["_cut"] if row else None)).withColumn("_room", F.lit(row["_room"] if row else None))
    over = marked.where(F.col("exposure_hours") > F.col("_cut")).select(*keys, "episode_id")
    tied = marked.where(F.col("exposure_hours") == F.col("_cut"))
    tied = global_rank(tied, keys, [F.col("episode_id")]).where("rank <= _room").select(*keys, "episode_id")
    return over.unionByName(tied)


def long_stay_pfa(patients: DataFrame, flags: DataFrame, labels: Sequence[str] = ("method", "alpha"),
                  keys: Sequence[str] = ()) -> DataFrame:
    return (patients.join(flags, ["episode_id", *keys], "left_semi").groupBy(*keys, *labels)
            .agg(F.avg(F.col("alerted").cast("double")).alias("long_stay_pfa"), F.count("*").alias("n_long_stay")))


def false_alarm_table(patients: DataFrame, keys: Sequence[str] = ("alpha", "method", "site"),
                      confidence: float = 0.95) -> DataFrame:
    """Alerts among non-events with exact binomial limits, per key."""
    counts = patients.where(non_event()).groupBy(*keys).agg(
        count_if(F.col("alerted")).alias("alerts"), F.count("*").alias("n_non_events"))
    return (counts.withColumn("pfa", ratio(F.col("alerts"), F.col("n_non_events")))
            .withColumn("_ci", binomial_limits(F.col("alerts"), F.col("n_non_events"), confidence))
            .select("*", "_ci.*").drop("_ci"))


def cumulative_false_alerts(patients: DataFrame, hmax: int, keys: Sequence[str] = ("method", "alpha")) -> DataFrame:
    """Share of non-events with a first alert by each hour 1..hmax, all non-events in
    the denominator."""
    keys = list(keys)
    hist = patients.where(non_event()).groupBy(*keys, "tau").count()
    total = hist.groupBy(*keys).agg(F.sum("count").alias("denominator"))
    grid = total.select(*keys, "denominator", F.explode(F.sequence(F.lit(1), F.lit(hmax))).alias("hour"))
    at = hist.where(F.col("tau") < F.lit(INF)).select(*keys, F.col("tau").cast("int").alias("hour"), F.col("count").alias("_n"))
    run = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return (grid.join(at, [*keys, "hour"], "left")
            .withColumn("estimate", F.coalesce(F.sum("_n").over(run), F.lit(0)) / F.col("denominator")).drop("_n"))


def threshold_free(flat: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Episode-equal weighted AUROC and trapezoidal PR-AUC from prefix sums over the
    distinct values. NULL when only one class is present."""
    keys = list(keys)
    rows = flat.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy(*keys, "episode_id")))
    s = prefix_sums(rows, keys, "value", {
        "pos": F.col("w") * F.col("label"), "neg": F.col("w") * (1 - F.col("label")), "n": F.lit(1).cast("long")})
    pos, neg = F.col("total_pos"), F.col("total_neg")
    neg_below = F.col("cum_neg") - F.col("neg")
    roc = F.sum(F.col("pos") * (neg_below + F.col("neg") / 2)) / F.max(pos * neg)
    above_pos, above_neg = pos - F.col("cum_pos"), neg - F.col("cum_neg")
    at_least = above_pos + F.col("pos") + above_neg + F.col("neg")
    precision = (above_pos + F.col("pos")) / at_least
    higher = F.when(F.col("cum_n") >= F.col("total_n"), F.lit(1.0)).otherwise(above_pos / (above_pos + above_neg))
    pr = F.sum(F.col("pos") / pos * (precision + higher) / 2)
    both = s.where("total_pos > 0 and total_neg > 0")
    return both.groupBy(*keys).agg(roc.alias("auroc"), pr.alias("pr_auc"), F.max("total_n").alias("n_rows"))


def standardized_summary(patients: DataFrame, p: Params, keys: Sequence[str] = ("method", "alpha")) -> DataFrame:
    """Class components with PPV and burden at the default prevalence."""
    return standardize_prevalence(class_components(patients, keys), [p.prevalence])
