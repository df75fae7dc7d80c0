"""Summaries over replicates, and report tables.

A replicate result row has identifiers (scenario, method, operating_alpha, target_m0,
replicate, ...) and metric columns; NULL means undefined. Groups hold one row per
replicate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, finite
from tocsin.functions.tables import each, values
from tocsin.operators.ranking import null_safe_join


def without_aliases(frame: DataFrame, alias: str = "is_alias") -> DataFrame:
    return frame.where(~F.coalesce(F.col(alias), F.lit(False))) if alias in frame.columns else frame


def require_unique(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a replicate key occurs twice."""
    if not frame.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"duplicate replicate keys over {list(keys)}")
    return frame


def mcse(value: Column) -> Column:
    """Monte-Carlo standard error, NULL below two values."""
    return F.when(F.count(value) > 1, F.stddev_samp(value) / F.sqrt(F.count(value)))


def _flag(frame: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in frame.columns else F.lit(False)


def aggregate_results(frame: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long summary: mean and MCSE over defined values, counts, failure and
    infinite-threshold frequencies per identifiers and metric."""
    rows = without_aliases(frame)
    metrics = [m for m in metrics if m in rows.columns]
    failed, endless = _flag(rows, "learner_failure"), _flag(rows, "infinite_threshold")
    long = rows.select(*ids, failed.alias("_f"), endless.alias("_i"), *[F.col(m).cast("double").alias(m) for m in metrics])
    long = long.unpivot([*ids, "_f", "_i"], metrics, "metric", "value")
    v = F.col("value")
    return long.groupBy(*ids, "metric").agg(
        F.avg(v).alias("mean"), mcse(v).alias("mcse"), F.count("*").alias("n_total"), F.count(v).alias("n_defined"),
        (F.count("*") - F.count(v)).alias("n_undefined"), F.count(F.when(F.col("_f"), 1)).alias("n_failures"),
        F.avg(F.col("_f").cast("double")).alias("learner_failure_frequency"),
        F.avg(F.col("_i").cast("double")).alias("infinite_threshold_frequency"))


def threshold_summary(frame: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Mean and sd of the finite thresholds, and the frequency of +inf."""
    c = finite("threshold")
    return without_aliases(frame).groupBy(*ids).agg(
        F.avg(c).alias("threshold_mean"), F.when(F.count(c) > 1, F.stddev_samp(c)).alias("threshold_sd"),
        F.count("*").alias("n_total"), F.count(c).alias("finite_count"),
        F.avg(F.when(F.col("threshold") == F.lit(INF), 1.0).otherwise(0.0)).alias("infinite_frequency"))


def learner_summary(frame: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Mean and MCSE of the learner metrics, and the spread of the best iteration."""
    a, b, it = F.col("auroc_weighted"), F.col("aucpr_weighted"), F.col("best_iteration")
    q = F.percentile(it, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = frame.groupBy(*ids).agg(
        F.count("*").alias("n_total"), F.avg(a).alias("auroc_mean"), mcse(a).alias("auroc_mcse"),
        F.avg(b).alias("pr_auc_mean"), mcse(b).alias("pr_auc_mcse"), F.avg(it).alias("best_iteration_mean"),
        F.when(F.count(it) > 1, F.stddev_samp(it)).alias("best_iteration_sd"), q.alias("_q"),
        F.avg(F.coalesce(F.col("learner_failure"), F.lit(False)).cast("double")).alias("learner_failure_frequency"))
    names = ("best_iteration_q05", "best_iteration_median", "best_iteration_q95")
    return out.select("*", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)]).drop("_q")


def failures(frame: DataFrame) -> DataFrame:
    return frame.where(F.coalesce(F.col("learner_failure"), F.lit(False)))


def timing_summary(frame: DataFrame, by: str = "scenario", replicate: str = "replicate", seconds: str = "total_seconds") -> DataFrame:
    """Timing per scenario; a replicate's rows carry the same time and count once."""
    per = frame.groupBy(by, replicate).agg(F.max(seconds).alias("s"))
    return per.groupBy(by).agg(F.count("*").alias("count"), F.avg("s").alias("mean"), F.sum("s").alias("sum"),
                               F.percentile("s", F.lit(0.5)).alias("median"), F.max("s").alias("max"))


def timing_means(frame: DataFrame, ids: Sequence[str]) -> DataFrame:
    cols = [c for c in frame.columns if c.endswith("_seconds")]
    return frame.groupBy(*ids).agg(*[F.avg(c).alias(c) for c in cols])


def select_rows(frame: DataFrame, spec: DataFrame, alpha: float | None = None) -> DataFrame:
    """Rows of a specification table (scenario, method, target_m0 NULL-safe, any labels)."""
    rows = frame.where(F.abs(F.col("operating_alpha") - alpha) < 1e-9) if alpha is not None else frame
    return null_safe_join(rows, F.broadcast(spec), ["scenario", "method", "target_m0"])


def text(value: Column, digits: int = 3) -> Column:
    """Fixed-point text, NA when undefined."""
    return F.when(value.isNotNull() & (F.abs(value) < F.lit(INF)), F.format_string(f"%.{digits}f", F.round(value, digits))).otherwise("NA")


def mean_text(name: str, digits: int = 3) -> Column:
    """``mean (mcse)`` of the defined values, NA without any; the error of one value is 0."""
    v = F.col(name)
    error = F.coalesce(mcse(v), F.when(F.count(v) == 1, F.lit(0.0)))
    shown = F.concat(text(F.avg(v), digits), F.lit(" ("), text(error, digits), F.lit(")"))
    return F.when(F.count(v) > 0, shown).otherwise("NA")


def mean_sd_text(name: str, digits: int = 3) -> Column:
    v = finite(name)
    sd = F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, F.lit(0.0))
    return F.concat(text(F.avg(v), digits), F.lit(" ("), text(sd, digits), F.lit(")"))


def sd_text(name: str, digits: int = 3) -> Column:
    v = finite(name)
    return text(F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, F.lit(0.0)), digits)


def report_table(frame: DataFrame, spec: DataFrame, cells: Mapping[str, Column], alpha: float,
                 labels: Sequence[str] = ()) -> DataFrame:
    """Table with one row per specification row, in the order of its column ``ord``."""
    rows = select_rows(frame, spec, alpha)
    keys = ["ord", "scenario", "method", "target_m0", *labels]
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in cells.items()]).orderBy("ord")


def wide_summary(summary: DataFrame, ids: Sequence[str], metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """Pivot a long summary: display text and defined count per metric, frequencies."""
    shown = summary.where(F.col("metric").isin(list(metrics))).withColumn(
        "display", F.concat(text(F.col("mean"), digits), F.lit(" ("), text(F.col("mcse"), digits), F.lit(")")))
    pivoted = shown.groupBy(*ids).pivot("metric", list(metrics)).agg(
        F.first("display").alias("text"), F.first("n_defined").alias("n_defined"))
    for m in metrics:
        pivoted = pivoted.withColumnRenamed(f"{m}_text", m)
    freq = shown.groupBy(*ids).agg(F.max("infinite_threshold_frequency").alias("infinite_threshold_frequency"),
                                   F.max("learner_failure_frequency").alias("learner_failure_frequency"),
                                   F.max("n_total").alias("n_total"))
    return null_safe_join(pivoted, freq, list(ids))


def defined_counts(frame: DataFrame, metrics: Sequence[str], by: str = "scenario") -> DataFrame:
    """Defined, undefined, silent and infinite rows per scenario."""
    n = lambda cond: F.count(F.when(cond, 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return frame.groupBy(by).agg(
        F.count("*").alias("operating_rows"),
        *[F.count(finite(m)).alias(f"{m}_defined") for m in metrics],
        *[n(finite(m).isNull()).alias(f"{m}_undefined") for m in metrics],
        n(zero("n_alerted")).alias("no_alert_rows"), n(zero("n_valid3")).alias("no_valid_detection_rows"),
        n(zero("n_sens3")).alias("no_evaluable_rows"), n(_flag(frame, "infinite_threshold")).alias("infinite_rows"),
        n(_flag(frame, "learner_failure")).alias("failure_rows"))


def exceedance_frequency(frame: DataFrame, ids: Sequence[str], bound: Column, rate: str = "conditional_pfa") -> DataFrame:
    """Share of replicates whose conditional false-alarm rate exceeds the bound."""
    return frame.where(F.col(rate).isNotNull()).groupBy(*ids).agg(
        F.avg((F.col(rate) > bound).cast("double")).alias("exceedance_frequency"), F.count("*").alias("replicates"))


def alpha_grid(frame: DataFrame, ids: Sequence[str] = ("scenario", "method", "operating_alpha")) -> DataFrame:
    """Mean PFA and mean achieved bound over the alpha grid."""
    return frame.groupBy(*ids).agg(
        F.avg("pfa").alias("mean_pfa"), mcse(F.col("pfa")).alias("pfa_mcse"), F.avg("alpha_m0").alias("mean_alpha_m0"),
        mcse(F.col("alpha_m0")).alias("alpha_m0_mcse"), F.count("pfa").alias("n_defined"))


def replicate_contrasts(frame: DataFrame, spec: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Paired differences over replicates with a +-1.96 MCSE interval.

    ``spec`` rows: (scenario, contrast, method_a, m0_a, method_b, m0_b)."""
    def side(letter: str) -> DataFrame:
        pick = spec.select("scenario", "contrast", F.col(f"method_{letter}").alias("method"), F.col(f"m0_{letter}").alias("target_m0"))
        rows = null_safe_join(frame, F.broadcast(pick), ["scenario", "method", "target_m0"])
        return rows.select("scenario", "contrast", "replicate", *metrics).unpivot(
            ["scenario", "contrast", "replicate"], list(metrics), "metric", f"value_{letter}")

    on = ["scenario", "contrast", "replicate", "metric"]
    diff = finite(F.col("value_a") - F.col("value_b"))
    out = side("a").join(side("b"), on).groupBy("scenario", "contrast", "metric").agg(
        F.avg(diff).alias("mean_paired_difference"),
        F.when(F.count(diff) > 1, F.stddev_samp(diff)).when(F.count(diff) == 1, F.lit(0.0)).alias("paired_sd"),
        F.count(diff).alias("n_pairs")).where("n_pairs > 0")
    out = out.withColumn("paired_mcse", F.col("paired_sd") / F.sqrt("n_pairs"))
    half = 1.96 * F.col("paired_mcse")
    return (out.withColumn("interval_lower", F.col("mean_paired_difference") - half)
            .withColumn("interval_upper", F.col("mean_paired_difference") + half))


def curve_means(frame: DataFrame, ids: Sequence[str], curve: str = "cumulative_false_alert_curve") -> DataFrame:
    """Average curve over replicates. Text curves (JSON arrays) are parsed first."""
    arr = F.col(curve)
    if frame.schema[curve].dataType.typeName() == "string":
        arr = F.from_json(arr, "array<double>")
    rows = frame.select(*ids, F.posexplode(arr).alias("position", "value"))
    return rows.groupBy(*ids, (F.col("position") + 1).alias("hour")).agg(
        F.avg("value").alias("mean"), F.count("value").alias("n_defined"))


def metric_means(frame: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Grouped means with MCSE and defined counts; the data behind the figures."""
    return frame.groupBy(*ids).agg(*[e for m in metrics for e in (
        F.avg(m).alias(f"mean_{m}"), mcse(F.col(m)).alias(f"{m}_mcse"), F.count(m).alias(f"n_{m}"))])


def interval_text(value: str, lower: str, upper: str, digits: int = 3) -> Column:
    return F.concat(text(F.col(value), digits), F.lit(" ["), text(F.col(lower), digits), F.lit(", "),
                    text(F.col(upper), digits), F.lit("]"))


def internal_table(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Internal results in method order as display text. ``results`` carries
    pfa_lower_95 and pfa_upper_95."""
    ranks = values(results.sparkSession, ["method", "ord"], [(m, i) for i, m in enumerate(order)])
    c = F.col
    return results.join(F.broadcast(ranks), "method").select(
        "ord", "method", interval_text("pfa", "pfa_lower_95", "pfa_upper_95").alias("patient_pfa"),
        text(c("sens3")).alias("sens3"), text(c("sens0")).alias("sens0"), text(c("premature")).alias("premature"),
        text(c("median_lead"), 1).alias("median_lead"), text(c("ppv3")).alias("ppv3"),
        text(c("alerts_per_100d"), 1).alias("alerts_per_100d"), text(c("utility")).alias("utility")).orderBy("ord")


def cross_site_table(results: DataFrame, spec: DataFrame) -> DataFrame:
    """Transfer results for the listed (method, target_m0) rows, ordered by direction."""
    c = F.col
    return results.join(F.broadcast(spec), ["method", "target_m0"]).select(
        "direction", "ord", "method", "target_m0", interval_text("pfa", "lower_95", "upper_95").alias("target_pfa"),
        text(c("sens3")).alias("sens3"), text(c("ppv3")).alias("ppv3"), text(c("utility")).alias("utility")
    ).orderBy("direction", "ord")


def completeness(frame: DataFrame, expected: DataFrame, by: str = "scenario") -> DataFrame:
    """Distinct replicates per scenario against the expected number."""
    got = frame.groupBy(by).agg(F.count_distinct("replicate").alias("actual"))
    return expected.join(got, by, "full").select(
        by, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")
    ).withColumn("complete", F.col("expected") == F.col("actual"))


def compare_expected(actual: DataFrame, expected: DataFrame, keys: Sequence[str], tolerance: Column | float,
                     value: str = "value") -> DataFrame:
    """Values against expected values: (keys, expected, actual, within)."""
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    joined = null_safe_join(expected, actual.select(*keys, F.col(value).alias("actual")), list(keys), "left")
    return joined.withColumn("within", F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tol, F.lit(False)))


def failure_placeholders(failed: DataFrame, methods: Sequence[str], metrics: Sequence[str], reason: str = "failure_reason") -> DataFrame:
    """One row per failed unit and method with NULL metrics and the reason kept."""
    return each(failed, "method", methods).select(
        *[c for c in failed.columns if c != reason], "method", *[F.lit(None).cast("double").alias(m) for m in metrics],
        F.lit(True).alias("learner_failure"), reason)


def nonincreasing_in_alpha(thresholds: DataFrame, keys: Sequence[str], alpha: str = "alpha", value: str = "threshold") -> DataFrame:
    """Whether finite neighbouring thresholds fall as alpha grows, per key."""
    c = F.col(value)
    step = finite(c) - F.lag(finite(c)).over(Window.partitionBy(*keys).orderBy(alpha))
    return thresholds.select(*keys, F.col(alpha), step.alias("_step")).groupBy(*keys).agg(
        F.count_distinct(alpha).alias("n_alpha"), (F.count(F.when(F.col("_step") > 0, 1)) == 0).alias("nonincreasing"))
