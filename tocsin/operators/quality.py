"""Episode records: checks, onset reconstruction, cohort flags and their reports.

A record row has (site, episode_id, row_no, variables..., baseline..., t, label) with
t and label as doubles. Order checks between neighbouring rows run in chunks of
``row_no`` and are then linked across chunks, so one long record is not one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, finite
from tocsin.functions.tables import each_row
from tocsin.operators.ranking import distinct_values, quantile_linear
from tocsin.params import Params

CHUNK_ROWS = 4096
LENGTH_EDGES = (0, 6, 12, 24, 48, 72, 96, 120, 168)


def order_checks(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Neighbour checks in record order per episode: strictly increasing hours, gaps,
    falling labels, first and last hour, first label."""
    chunk = F.floor(F.col("row_no") / chunk_rows)
    w = Window.partitionBy("episode_id", "_chunk").orderBy("row_no")
    step, fall = F.col("t") - F.lag("t").over(w), F.col("label") - F.lag("label").over(w)
    rows = records.select("episode_id", "row_no", "t", "label", chunk.alias("_chunk")).select(
        "*", step.alias("_step"), fall.alias("_fall"))
    parts = rows.groupBy("episode_id", "_chunk").agg(
        F.min_by("t", "row_no").alias("t0"), F.max_by("t", "row_no").alias("t1"),
        F.min_by("label", "row_no").alias("y0"), F.max_by("label", "row_no").alias("y1"),
        F.count(F.when(~(F.col("_step") > 0), 1)).alias("not_up"), F.count(F.when(F.col("_step") != 1, 1)).alias("gaps"),
        F.count(F.when(F.col("_fall") < 0, 1)).alias("falls"))
    link = Window.partitionBy("episode_id").orderBy("_chunk")
    linked = parts.select("*", (F.col("t0") - F.lag("t1").over(link)).alias("_step"),
                          (F.col("y0") - F.lag("y1").over(link)).alias("_fall"))
    return linked.groupBy("episode_id").agg(
        (F.sum("not_up") + F.count(F.when(~(F.col("_step") > 0), 1)) == 0).alias("strictly_increasing"),
        (F.sum("gaps") + F.count(F.when(F.col("_step") != 1, 1)) > 0).alias("has_gap"),
        (F.sum("falls") + F.count(F.when(F.col("_fall") < 0, 1)) == 0).alias("label_never_falls"),
        F.min_by("t0", "_chunk").alias("first_hour"), F.max_by("t1", "_chunk").alias("horizon"),
        F.min_by("y0", "_chunk").alias("first_label"))


def duplicate_hours(records: DataFrame) -> DataFrame:
    """(episode_id, duplicate_hour), counted per (episode, hour) first."""
    return (records.groupBy("episode_id", "t").count().groupBy("episode_id")
            .agg((F.max("count") > 1).alias("duplicate_hour")))


def manifest(records: DataFrame, p: Params, variables: Sequence[str], baseline: Sequence[str]) -> DataFrame:
    """One row per episode: checks, onset, cohort flag, exclusion reasons, evaluability
    and observation counts."""
    once = lambda c: (F.coalesce(F.min(finite(c)) == F.max(finite(c)), F.lit(True)))
    valid = F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False))
    positive = F.col("label") == 1.0
    basics = records.groupBy("site", "episode_id").agg(
        F.count("*").alias("n_rows"),
        F.min(valid).alias("label_valid"),
        F.min(F.when(positive, F.col("row_no"))).alias("first_positive_row"),
        F.min_by("t", F.when(positive, F.col("row_no"))).alias("first_positive_hour"),
        F.coalesce(F.min(finite("t").isNotNull() & (finite("t") == F.floor(finite("t")))), F.lit(False)).alias("hours_integer"),
        F.min("t").alias("min_hour"), F.max("t").alias("max_hour"),
        *[F.min(finite(c)).alias(c) for c in baseline],
        *[once(c).alias(f"_ok_{c}") for c in baseline],
        *[F.count(finite(v)).alias(f"{v}_nobs") for v in variables])
    ok = F.lit(True)
    for c in baseline:
        ok = ok & F.col(f"_ok_{c}")
    df = (basics.withColumn("baseline_consistent", ok).drop(*[f"_ok_{c}" for c in baseline])
          .join(order_checks(records), "episode_id").join(duplicate_hours(records), "episode_id"))
    df = df.withColumn("event", F.col("first_positive_row").isNotNull())
    df = df.withColumn("label_monotone", F.col("label_valid") & F.col("label_never_falls")).drop("label_never_falls")
    df = df.withColumn("onset", F.when(F.col("event"), F.col("first_positive_hour") + p.warning_hours).otherwise(F.lit(INF)))
    df = df.withColumn("left_truncated", F.col("event") & F.coalesce(F.col("first_label") == 1.0, F.lit(False))).drop("first_label")
    df = df.withColumn("onset_within_record", ~F.col("event") | (F.col("onset") <= F.col("horizon")))
    df = df.withColumn("onset_reconstructable", F.col("label_valid") & F.col("label_monotone")
                       & ~F.col("left_truncated") & F.col("onset_within_record"))
    df = df.withColumn("primary", primary_flag(p)).withColumn("exclusion_reason", exclusion_reasons(p))
    df = df.withColumn("hmax_truncated", F.col("horizon") > p.hmax if p.hmax is not None else F.lit(False))
    for v in variables:
        df = df.withColumn(f"{v}_missing_fraction", 1 - F.col(f"{v}_nobs") / F.col("n_rows"))
    return df.join(recorded_evaluability(records, df.select("episode_id", "event", "onset", "horizon"), p), "episode_id")


def primary_flag(p: Params) -> Column:
    c = F.col
    return ((c("horizon") >= p.tmin) & c("baseline_consistent") & c("label_valid") & c("label_monotone")
            & c("hours_integer") & c("strictly_increasing") & ~c("duplicate_hour")
            & (~c("event") | (c("onset_reconstructable") & (c("onset") > p.tmin))))


def exclusion_reasons(p: Params) -> Column:
    """Reasons joined by ';' in a fixed order; empty when there is none."""
    c = F.col
    odd = c("event") & ~c("onset_reconstructable") & ~c("left_truncated") & c("onset_within_record")
    return F.concat_ws(
        ";",
        F.when(~c("baseline_consistent"), "baseline_inconsistent"), F.when(~c("label_valid"), "invalid_label"),
        F.when(~c("label_monotone"), "nonmonotone_label"), F.when(~c("hours_integer"), "noninteger_hour"),
        F.when(~c("strictly_increasing"), "hours_not_strictly_increasing"),
        F.when(c("duplicate_hour"), "duplicate_hour"),
        F.when(~F.coalesce(c("horizon") >= p.tmin, F.lit(False)), "below_landmark"),
        F.when(c("event") & c("left_truncated"), "left_truncated"),
        F.when(c("event") & ~c("onset_within_record"), "onset_outside_record"),
        F.when(odd, "onset_unreconstructable"))


def recorded_evaluability(records: DataFrame, episodes: DataFrame, p: Params) -> DataFrame:
    """Recorded eligible hours, and whether the warning windows hold one."""
    t, onset = F.col("t"), F.col("onset")
    stop = F.least(F.col("horizon"), F.lit(float(p.hmax))) if p.hmax is not None else F.col("horizon")
    elig = (t >= p.tmin) & (t <= stop) & (t < onset)
    inside = lambda lead: elig & F.col("event") & (t >= onset - p.warning_hours) & (t <= onset - lead)
    count = lambda cond: F.count(F.when(cond, 1))
    return records.select("episode_id", "t").join(episodes, "episode_id").groupBy("episode_id").agg(
        count(elig).alias("eligible_hour_count"), (count(inside(p.short_lead)) > 0).alias("sens3_evaluable"),
        (count(inside(0)) > 0).alias("sens0_evaluable"))


def fatal_records(man: DataFrame) -> DataFrame:
    """Episodes that break the record contract."""
    c = F.col
    return man.where(~c("baseline_consistent") | ~c("label_valid") | ~c("label_monotone") | ~c("hours_integer")
                     | ~c("strictly_increasing") | c("duplicate_hour"))


def require_clean(man: DataFrame) -> DataFrame:
    """Quality gate: raise when any episode breaks the record contract."""
    n = fatal_records(man).count()
    if n:
        raise ValueError(f"cohort gate failed for {n} episodes")
    return man


def cohort_counts(man: DataFrame) -> DataFrame:
    return man.groupBy("site", "primary", "event").agg(F.count("*").alias("n"))


def onset_listing(man: DataFrame) -> DataFrame:
    return man.where("event").select("site", "episode_id", "first_positive_hour", "onset", "onset_within_record", "left_truncated")


def stay_length(man: DataFrame) -> DataFrame:
    """Count, quartiles and maximum of the last hour by site."""
    probs = [("q1_h", 0.25), ("median_h", 0.5), ("q3_h", 0.75)]
    q = quantile_linear(distinct_values(man, ["site"], "horizon"), ["site"], "horizon", probs, "name")
    wide = q.groupBy("site").pivot("name", ["q1_h", "median_h", "q3_h"]).agg(F.first("quantile"))
    return man.groupBy("site").agg(F.count("*").alias("n"), F.max("horizon").alias("max_h")).join(wide, "site")


def missingness(man: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Per variable: mean missing fraction over episodes, and total observations."""
    sums = man.agg(*[F.struct(F.avg(f"{v}_missing_fraction").alias("a"), F.sum(f"{v}_nobs").alias("n")).alias(v) for v in variables])
    return sums.select(F.inline(F.array(*[F.struct(
        F.lit(v).alias("variable"), F.col(v)["a"].alias("mean_missing_fraction"),
        F.col(v)["n"].alias("total_observations")) for v in variables])))


def primary_ids(man: DataFrame) -> DataFrame:
    return man.where("primary").select("episode_id", "site", "event")


def exclusion_log(man: DataFrame) -> DataFrame:
    return man.where(~F.col("primary")).select("episode_id", "site", "exclusion_reason")


def exclusion_combinations(man: DataFrame) -> DataFrame:
    return exclusion_log(man).groupBy("exclusion_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exclusion_reason")


def cohort_flow(man: DataFrame) -> DataFrame:
    """Flow counts per site as (site, category, value)."""
    c, n = F.col, lambda cond: F.count(F.when(cond, 1))
    reason = F.coalesce(c("exclusion_reason"), F.lit(""))
    wide = man.groupBy("site").agg(
        F.count("*").alias("raw"), n(c("primary") & ~c("event")).alias("primary non-event"),
        n(c("primary") & c("event")).alias("primary event"), n(reason.rlike("below_landmark")).alias("below landmark"),
        n(reason.rlike("left_truncated")).alias("left truncated"),
        n(reason.rlike("onset_unreconstructable|onset_outside_record")).alias("onset unreconstructable/outside"))
    return wide.unpivot(["site"], [x for x in wide.columns if x != "site"], "category", "value")


def length_histogram(man: DataFrame, edges: Sequence[int] = LENGTH_EDGES, column: str = "horizon") -> DataFrame:
    """Monitoring lengths in right-closed bins per site, empty bins kept. The last bin
    is open, and the first one also holds the lowest edge."""
    inner = list(edges[1:])
    labels = [f"<={inner[0]}", *[f"{lo + 1}-{hi}" for lo, hi in zip(inner, inner[1:])], f">{inner[-1]}"]
    h = F.col(column)
    which = F.lit(len(inner))
    for i in range(len(inner) - 1, -1, -1):
        which = F.when(h <= inner[i], i).otherwise(which)
    counts = man.where(h >= edges[0]).groupBy("site", which.alias("bin")).agg(F.count("*").alias("n"))
    grid = each_row(man.select("site").distinct(), ["bin", "length"], list(enumerate(labels)))
    return (grid.join(counts, ["site", "bin"], "left")
            .select("site", "bin", "length", F.coalesce("n", F.lit(0)).alias("n")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(table: DataFrame, cohort: DataFrame) -> DataFrame:
    """Ids on one side only: (episode_id, problem)."""
    a, b = table.select("episode_id").distinct(), cohort.select("episode_id").distinct()
    return (a.join(b, "episode_id", "left_anti").withColumn("problem", F.lit("not_in_cohort"))
            .unionByName(b.join(a, "episode_id", "left_anti").withColumn("problem", F.lit("not_in_table"))))


def post_onset_fitting_rows(features: DataFrame) -> DataFrame:
    return features.where(F.col("fit") & (F.col("t") >= F.col("onset")))


def history_gaps(rows: DataFrame, episodes: DataFrame, p: Params) -> DataFrame:
    """Episodes reaching tmin that lack one of the hours tmin-L+1..tmin: the missing hours."""
    from tocsin.functions.exprs import first_score_hour

    first = first_score_hour(p)
    need = F.sequence(F.lit(first), F.lit(p.tmin))
    have = rows.where(F.col("t").between(first, p.tmin)).groupBy("episode_id").agg(F.collect_set(F.col("t").cast("int")).alias("_have"))
    long = episodes.where((F.col("horizon") >= p.tmin) & (F.col("onset") > p.tmin)).select("episode_id")
    missing = F.array_except(need, F.coalesce("_have", F.array().cast("array<int>")))
    return (long.join(have, "episode_id", "left").select("episode_id", missing.alias("missing_hours"))
            .where(F.size("missing_hours") > 0))


def count_gate(actual: DataFrame, expected: DataFrame, keys: Sequence[str] = ("site", "event")) -> DataFrame:
    """Counts against frozen expected counts: (keys, expected, actual, passed)."""
    got = actual.groupBy(*keys).agg(F.count("*").alias("actual"))
    return expected.join(got, list(keys), "full").select(
        *keys, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"),
        F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("passed", F.col("expected") == F.col("actual"))


def result_checks(results: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Row checks over a result table in one pass: (check, n_failed, passed). A NULL
    outcome passes, because undefined metrics are allowed."""
    bad = results.agg(*[F.count(F.when(~cond, 1)).alias(name) for name, cond in checks.items()])
    return bad.unpivot([], list(checks), "check", "n_failed").withColumn("passed", F.col("n_failed") == 0)


def standard_result_checks() -> dict[str, Column]:
    """Rules on result rows by method family; the marginal methods have a formula for k and its bound."""
    from tocsin.functions.exprs import achieved_bound, marginal_index

    c = F.col
    unit = lambda x: c(x).between(0.0, 1.0)
    endless = c("threshold") == F.lit(INF)
    marginal = c("method").isin("fixed_max", "time_adaptive", "local_fixed_max", "local_time_adaptive", "direct_transfer")
    return {
        "probabilities_in_range": F.coalesce(unit("pfa"), F.lit(True)) & F.coalesce(unit("sens3"), F.lit(True))
        & F.coalesce(unit("sens0"), F.lit(True)) & F.coalesce(unit("ppv3"), F.lit(True)),
        "burden_nonnegative": c("alerts_per_100d") >= 0,
        "index_matches_formula": ~marginal | (c("k") == marginal_index("m0", "alpha")),
        "bound_matches_index": ~marginal | (F.abs(c("alpha_m0") - achieved_bound("m0", "k")) < 1e-12),
        "infinite_means_silent": ~endless | (c("n_alerted") == 0),
    }


def expected_feature_rows(episodes: DataFrame, features: DataFrame, p: Params) -> DataFrame:
    """Rows expected from the horizons against the rows present, per site."""
    from tocsin.functions.exprs import first_score_hour

    last = F.least(F.col("horizon"), F.lit(p.hmax)) if p.hmax is not None else F.col("horizon")
    want = episodes.groupBy("site").agg(
        F.sum(F.greatest(F.lit(0), last.cast("int") - first_score_hour(p) + 1)).alias("expected_rows"))
    have = features.groupBy("site").agg(F.count("*").alias("actual_rows"))
    return want.join(have, "site", "left").withColumn("matches", F.col("expected_rows") == F.col("actual_rows"))
