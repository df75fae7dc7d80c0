"""Queries on replicate summaries, report tables and diagnostics.

The repeated target partitions of ``orders`` serve as replicates: the partition is the
replicate, the target site is the scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, round_scaled
from tocsin.functions.tables import values
from tocsin.operators import calibrate as ca
from tocsin.operators import diagnostics as dg
from tocsin.operators import metrics as me
from tocsin.operators import summarize as su
from tocsin.operators import transfer as tr
from tocsin.operators.trajectory import smooth
from tocsin.plans import fixtures as fx
from tocsin.plans.catalog_metrics import (
    FIRST, results_intervals, rounded, transfer_parts, transfer_results, transfer_split, transfer_thresholds, transfer_trajectories,
)
from tocsin.plans.catalog_thresholds import scalar_thresholds
from tocsin.plans.fixtures import ORDERS as P
from tocsin.plans.oracle import INF as SQL_INF
from tocsin.plans.oracle import PARTITIONS, define
from tocsin.plans.registry import query

METRICS = ["pfa", "sens3", "sens0", "ppv3", "alerts_per_100d"]
IDS = ["scenario", "method", "target_m0"]

define("m_rep", f"""select r.site as scenario, r.method, r.alpha as operating_alpha, r.target_m0, r.partition as replicate, r.pfa, r.sens3, r.sens0, r.ppv3, r.alerts_per_100d, r.utility,
  r.n_alerted, r.n_valid3, r.n_sens3, t.threshold[1] as threshold, t.m0, t.k, t.alpha_m0, t.threshold[1]={SQL_INF} as infinite_threshold,
  r.partition=3 and r.site='B' as learner_failure, r.method='local_time_adaptive' and r.target_m0=250 as is_alias,
  (('0x'||substr(md5('42|seconds|'||r.site||'|'||r.partition),1,15))::bigint % 1000)/10.0::double as total_seconds
  from k_res r join k_thr t on t.site=r.site and t.partition=r.partition and t.target_m0=r.target_m0 and t.method=r.method""")


def replicates(spark, d) -> DataFrame:
    """Long replicate results with failure, alias and timing columns derived from the keys."""
    from tocsin.functions.exprs import hash_key, hash_long

    seconds = (hash_long(hash_key(fx.SEED, "seconds", F.col("site"), F.col("partition"))) % 1000) / 10.0
    rows = transfer_results(spark, d)
    return rows.select(
        F.col("site").alias("scenario"), "method", F.col("alpha").alias("operating_alpha"), "target_m0", F.col("partition").alias("replicate"),
        *METRICS, "utility", "n_alerted", "n_valid3", "n_sens3", "threshold", "m0", "k", "alpha_m0",
        (F.col("threshold") == F.lit(INF)).alias("infinite_threshold"),
        ((F.col("partition") == 3) & (F.col("site") == "B")).alias("learner_failure"),
        ((F.col("method") == "local_time_adaptive") & (F.col("target_m0") == 250)).alias("is_alias"),
        seconds.alias("total_seconds"))


LONG_REP = "(unpivot (select scenario, method, target_m0, replicate, learner_failure, infinite_threshold, pfa, sens3, sens0, ppv3, alerts_per_100d from m_rep where not is_alias) on pfa, sens3, sens0, ppv3, alerts_per_100d into name metric value value)"
TOTALS = "(select scenario, method, target_m0, metric, count(*) as n_total, count(*) filter (where learner_failure) as n_failures, avg(learner_failure::int) as ff, avg(infinite_threshold::int) as fi from m_rep cross join (values ('pfa'),('sens3'),('sens0'),('ppv3'),('alerts_per_100d')) m(metric) where not is_alias group by all)"
SUMMARY_SQL = f"""select t.scenario, t.method, t.target_m0, t.metric, avg(l.value) as mean, case when count(l.value)>1 then stddev_samp(l.value)/sqrt(count(l.value)) end as mcse, t.n_total, count(l.value) as n_defined,
  t.n_total-count(l.value) as n_undefined, t.n_failures, t.ff as learner_failure_frequency, t.fi as infinite_threshold_frequency
  from {TOTALS} t left join {LONG_REP} l on l.scenario=t.scenario and l.method=t.method and l.target_m0=t.target_m0 and l.metric=t.metric group by t.scenario, t.method, t.target_m0, t.metric, t.n_total, t.n_failures, t.ff, t.fi"""


@query("replicate_summary", f"select scenario, method, target_m0, metric, round(mean,6) as mean, round(mcse,6) as mcse, n_total, n_defined, n_undefined, n_failures, round(learner_failure_frequency,6) as learner_failure_frequency, round(infinite_threshold_frequency,6) as infinite_threshold_frequency from ({SUMMARY_SQL})")
def replicate_summary(spark, d):
    return rounded(su.aggregate_results(replicates(spark, d), IDS, METRICS))


@query("threshold_summary", """select scenario, method, target_m0, round(avg(threshold) filter (where isfinite(threshold)),6) as threshold_mean, round(stddev_samp(threshold) filter (where isfinite(threshold)),6) as threshold_sd,
  count(*) as n_total, count(*) filter (where isfinite(threshold)) as finite_count, round(avg((threshold='infinity'::double)::int),6) as infinite_frequency from m_rep where not is_alias group by all""")
def threshold_summary(spark, d):
    return rounded(su.threshold_summary(replicates(spark, d), IDS))


LEARNER_SQL = """(select episode_id%7 as scenario, episode_id as replicate, avg(risk) as auroc_weighted, max(risk) as aucpr_weighted, count(*)::bigint as best_iteration, bool_or(t=1) as learner_failure from o_risk group by episode_id)"""


def learner_frame(spark, d) -> DataFrame:
    """Per-customer stand-ins for learner metrics: mean and largest risk, scored months."""
    e = F.col("episode_id")
    return fx.order_scores(spark, d).groupBy("episode_id").agg(
        F.avg("risk").alias("auroc_weighted"), F.max("risk").alias("aucpr_weighted"), F.count("*").alias("best_iteration"),
        F.max(F.col("t") == 1).alias("learner_failure")).withColumn("scenario", e % 7).withColumnRenamed("episode_id", "replicate")


@query("learner_summary", f"""select scenario, count(*) as n_total, round(avg(auroc_weighted),6) as auroc_mean, round(stddev_samp(auroc_weighted)/sqrt(count(*)),6) as auroc_mcse, round(avg(aucpr_weighted),6) as pr_auc_mean,
  round(stddev_samp(aucpr_weighted)/sqrt(count(*)),6) as pr_auc_mcse, round(avg(best_iteration),6) as best_iteration_mean, round(stddev_samp(best_iteration),6) as best_iteration_sd, round(quantile_cont(best_iteration,0.05),6) as best_iteration_q05,
  round(quantile_cont(best_iteration,0.5),6) as best_iteration_median, round(quantile_cont(best_iteration,0.95),6) as best_iteration_q95, round(avg(learner_failure::int),6) as learner_failure_frequency from {LEARNER_SQL} group by scenario""")
def learner_summary(spark, d):
    return rounded(su.learner_summary(learner_frame(spark, d), ["scenario"]))


@query("failure_rows", "select scenario, method, target_m0, replicate from m_rep where learner_failure")
def failure_rows(spark, d):
    return su.failures(replicates(spark, d)).select("scenario", "method", "target_m0", "replicate")


@query("timing_summary", """select scenario, count(*) as "count", round(avg(s),6) as mean, round(sum(s),6) as sum, round(median(s),6) as median, max(s) as max from (select scenario, replicate, max(total_seconds) as s from m_rep group by all) group by scenario""")
def timing_summary(spark, d):
    return rounded(su.timing_summary(replicates(spark, d)))


@query("timing_means", "select scenario, method, round(avg(total_seconds),6) as total_seconds from m_rep group by all")
def timing_means(spark, d):
    return rounded(su.timing_means(replicates(spark, d), ["scenario", "method"]))


@query("rows_without_aliases", "select scenario, method, target_m0, replicate from m_rep where not is_alias")
def rows_without_aliases(spark, d):
    rows = su.without_aliases(replicates(spark, d))
    return su.require_unique(rows, [*IDS, "replicate"]).select(*IDS, "replicate")


SPEC_ROWS = [(o, s, m, n) for o, (s, m, n) in enumerate(
    (s, m, n) for s in ("A", "B") for m, n in (("direct_transfer", 0), ("local_fixed_max", 50), ("local_fixed_max", 100), ("local_fixed_max", 200),
                                               ("local_time_adaptive", 100), ("local_high_confidence", 200)))]
SPEC_SQL = "(values " + ",".join(f"({o},'{s}','{m}',{n})" for o, s, m, n in SPEC_ROWS) + ") sp(ord,scenario,method,target_m0)"


def spec(spark) -> DataFrame:
    return values(spark, ["ord", "scenario", "method", "target_m0"], SPEC_ROWS)


@query("selected_rows", f"select sp.ord, r.scenario, r.method, r.target_m0, r.replicate, round(r.pfa,6) as pfa from m_rep r join {SPEC_SQL} on sp.scenario=r.scenario and sp.method=r.method and sp.target_m0=r.target_m0")
def selected_rows(spark, d):
    return rounded(su.select_rows(replicates(spark, d), spec(spark), 0.10).select("ord", *IDS, "replicate", "pfa"))


def mean_cell(c: str, digits: int = 3) -> str:
    return f"printf('%.{digits}f', round(avg({c}),{digits}))||' ('||printf('%.{digits}f', round(stddev_samp({c})/sqrt(count({c})),{digits}))||')'"


JOINED = f"m_rep r join {SPEC_SQL} on sp.scenario=r.scenario and sp.method=r.method and sp.target_m0=r.target_m0"


@query("display_means", f"select scenario, method, target_m0, {mean_cell('alerts_per_100d', 2)} as burden, printf('%.3f', round(avg(threshold),3))||' ('||printf('%.3f', round(stddev_samp(threshold),3))||')' as threshold from m_rep where isfinite(threshold) group by all")
def display_means(spark, d):
    return replicates(spark, d).where(F.abs("threshold") < F.lit(INF)).groupBy(*IDS).agg(
        su.mean_text("alerts_per_100d", 2).alias("burden"), su.mean_sd_text("threshold").alias("threshold"))


@query("wide_summary", f"""with s as ({SUMMARY_SQL}) select scenario, method, target_m0, max(printf('%.4f',round(mean,4))||' ('||printf('%.4f',round(mcse,4))||')') filter (where metric='pfa') as pfa, max(n_defined) filter (where metric='pfa') as pfa_n_defined,
  max(printf('%.4f',round(mean,4))||' ('||printf('%.4f',round(mcse,4))||')') filter (where metric='alerts_per_100d') as alerts_per_100d, max(n_defined) filter (where metric='alerts_per_100d') as alerts_per_100d_n_defined,
  max(infinite_threshold_frequency) as infinite_threshold_frequency, max(learner_failure_frequency) as learner_failure_frequency, max(n_total) as n_total from s where metric in ('pfa','alerts_per_100d') group by all""")
def wide_summary(spark, d):
    return su.wide_summary(su.aggregate_results(replicates(spark, d), IDS, METRICS), IDS, ["pfa", "alerts_per_100d"], 4)


def table_cells() -> dict[str, F.Column]:
    return {"pfa": su.mean_text("pfa"), "sens3": su.mean_text("sens3"), "ppv3": su.mean_text("ppv3"),
            "threshold": su.mean_sd_text("threshold")}


@query("report_table_methods", f"select sp.ord, r.scenario, r.method, r.target_m0, {mean_cell('r.pfa')} as pfa, {mean_cell('r.sens3')} as sens3, {mean_cell('r.alerts_per_100d', 2)} as burden from {JOINED} group by all")
def report_table_methods(spark, d):
    cells = {"pfa": su.mean_text("pfa"), "sens3": su.mean_text("sens3"), "burden": su.mean_text("alerts_per_100d", 2)}
    return su.report_table(replicates(spark, d), spec(spark), cells, 0.10)


@query("report_table_target_shift", f"select sp.ord, r.scenario, r.method, r.target_m0, {mean_cell('r.pfa')} as pfa, {mean_cell('r.sens3')} as sens3, coalesce({mean_cell('r.ppv3')},'NA') as ppv3, printf('%.3f', round(avg(r.threshold) filter (where isfinite(r.threshold)),3))||' ('||printf('%.3f', round(stddev_samp(r.threshold) filter (where isfinite(r.threshold)),3))||')' as threshold from {JOINED} group by all")
def report_table_target_shift(spark, d):
    return su.report_table(replicates(spark, d), spec(spark), table_cells(), 0.10)


@query("report_table_threshold_spread", f"select sp.ord, r.scenario, r.method, r.target_m0, {mean_cell('r.pfa')} as pfa, printf('%.3f', round(stddev_samp(r.threshold) filter (where isfinite(r.threshold)),3)) as threshold_sd from {JOINED} group by all")
def report_table_threshold_spread(spark, d):
    return su.report_table(replicates(spark, d), spec(spark), {"pfa": su.mean_text("pfa"), "threshold_sd": su.sd_text("threshold")}, 0.10)


def conditional(spark, d) -> DataFrame:
    """Replicate thresholds against the largest scores of all non-events of the target site."""
    thr = transfer_thresholds(spark, d).where("scale = 'score'").select("site", "partition", "target_m0", "method", F.element_at("threshold", 1).alias("threshold"))
    ref = fx.order_maxima(spark, d).where("not event").select("site", "max_score")
    return ref.join(F.broadcast(thr), "site").groupBy("site", "method", "target_m0", "partition").agg(
        F.avg((F.col("max_score") > F.col("threshold")).cast("double")).alias("conditional_pfa"))


COND_SQL = "select t.site, t.method, t.target_m0, t.partition, avg((m.max_score > t.threshold[1])::int) as conditional_pfa from k_thr t join o_max m on m.site=t.site and not m.event where t.scale='score' group by all"


@query("exceedance_frequency", f"select site, method, target_m0, round(avg((conditional_pfa>0.10)::int),6) as exceedance_frequency, count(*) as replicates from ({COND_SQL}) group by site, method, target_m0")
def exceedance_frequency(spark, d):
    return rounded(su.exceedance_frequency(conditional(spark, d), ["site", "method", "target_m0"], F.lit(0.10)))


@query("alpha_grid_summary", """select o.site as scenario, o.method, o.alpha as operating_alpha, round(o.pfa,6) as mean_pfa, round(t.alpha_m0,6) as mean_alpha_m0, 1::bigint as n_defined from
  (select site, method, alpha, avg(alerted::int) as pfa from o_out where not event group by all) o join o_thr t on t.site=o.site and t.method=o.method and t.alpha=o.alpha""")
def alpha_grid_summary(spark, d):
    rates = fx.order_outcomes(spark, d).where("not event").groupBy("site", "method", "alpha").agg(F.avg(F.col("alerted").cast("double")).alias("pfa"))
    frame = rates.join(fx.order_thresholds(spark, d).select("site", "method", "alpha", "alpha_m0"), ["site", "method", "alpha"])
    frame = frame.withColumnRenamed("site", "scenario").withColumnRenamed("alpha", "operating_alpha")
    return rounded(su.alpha_grid(frame).drop("pfa_mcse", "alpha_m0_mcse"))


@query("defined_counts", """select scenario, count(*) as operating_rows, count(pfa) as pfa_defined, count(sens3) as sens3_defined, count(ppv3) as ppv3_defined, count(*) filter (where isfinite(threshold)) as threshold_defined,
  count(*)-count(pfa) as pfa_undefined, count(*)-count(sens3) as sens3_undefined, count(*)-count(ppv3) as ppv3_undefined, count(*) filter (where not isfinite(threshold)) as threshold_undefined,
  count(*) filter (where n_alerted=0) as no_alert_rows, count(*) filter (where n_valid3=0) as no_valid_detection_rows, count(*) filter (where n_sens3=0) as no_evaluable_rows,
  count(*) filter (where infinite_threshold) as infinite_rows, count(*) filter (where learner_failure) as failure_rows from m_rep group by scenario""")
def defined_counts(spark, d):
    return su.defined_counts(replicates(spark, d), ["pfa", "sens3", "ppv3", "threshold"])


CONTRAST_SQL = """(values ('local fixed minus direct','local_fixed_max',200,'direct_transfer',0),('local adaptive minus direct','local_time_adaptive',100,'direct_transfer',0),('high confidence minus fixed','local_high_confidence',200,'local_fixed_max',200)) c(contrast,ma,na,mb,nb)"""


@query("replicate_contrasts", f"""with a as (select c.contrast, r.scenario, r.replicate, r.metric, r.value from {LONG_REP.replace('where not is_alias', '')} r join {CONTRAST_SQL} on r.method=c.ma and r.target_m0=c.na),
  b as (select c.contrast, r.scenario, r.replicate, r.metric, r.value from {LONG_REP.replace('where not is_alias', '')} r join {CONTRAST_SQL} on r.method=c.mb and r.target_m0=c.nb),
  g as (select a.scenario, a.contrast, a.metric, avg(a.value-b.value) as m, stddev_samp(a.value-b.value) as s, count(*) as n from a join b using (contrast, scenario, replicate, metric) group by all)
  select scenario, contrast, metric, round(m,6) as mean_paired_difference, round(s,6) as paired_sd, n as n_pairs, round(s/sqrt(n),6) as paired_mcse, round(m-1.96*s/sqrt(n),6) as interval_lower, round(m+1.96*s/sqrt(n),6) as interval_upper from g""")
def replicate_contrasts(spark, d):
    pairs = [("local fixed minus direct", "local_fixed_max", 200, "direct_transfer", 0),
             ("local adaptive minus direct", "local_time_adaptive", 100, "direct_transfer", 0),
             ("high confidence minus fixed", "local_high_confidence", 200, "local_fixed_max", 200)]
    table = values(spark, ["scenario", "contrast", "method_a", "m0_a", "method_b", "m0_b"], [(s, *p) for s in ("A", "B") for p in pairs])
    return rounded(su.replicate_contrasts(replicates(spark, d), table, METRICS))


@query("curve_means", """with c as (select site, partition, method, target_m0, g.h::int as hour, count(*) filter (where tau<=g.h)::double/count(*) as v from k_out cross join range(1,81) g(h) where not event group by all)
  select site as scenario, method, target_m0, hour, round(avg(v),6) as mean, count(v) as n_defined from c group by all""")
def curve_means(spark, d):
    curves = tr.target_curves(transfer_trajectories(spark, d), transfer_split(spark, d), transfer_thresholds(spark, d), P, P.hmax)
    text = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("hour", "estimate"))), lambda x: x["estimate"]))
    frame = curves.groupBy(F.col("site").alias("scenario"), "partition", "method", "target_m0").agg(text.alias("cumulative_false_alert_curve"))
    return rounded(su.curve_means(frame, IDS))


@query("figure_means", "select scenario, method, target_m0, round(avg(pfa),6) as mean_pfa, round(stddev_samp(pfa)/sqrt(count(pfa)),6) as pfa_mcse, count(pfa) as n_pfa, round(avg(sens3),6) as mean_sens3, round(stddev_samp(sens3)/sqrt(count(sens3)),6) as sens3_mcse, count(sens3) as n_sens3 from m_rep group by all")
def figure_means(spark, d):
    return rounded(su.metric_means(replicates(spark, d), IDS, ["pfa", "sens3"]))


@query("figure_conditional_rows", f"select site, method, target_m0, partition, round(conditional_pfa,6) as conditional_pfa from ({COND_SQL})")
def figure_conditional_rows(spark, d):
    return rounded(conditional(spark, d))


def fixed(c: str, digits: int = 3) -> str:
    return f"coalesce(printf('%.{digits}f', round({c},{digits})),'NA')"


@query("internal_results_table", f"""with b as (select method, quantile_cont(value,0.025) as lo, quantile_cont(value,0.975) as hi from o_bslong where alpha=0.10::double and metric='pfa' group by 1),
  p as (select method, avg(premature::int) filter (where eval0) as premature, median(onset-tau) filter (where valid0) as lead from o_out where alpha=0.10::double group by 1),
  q as (select * from (values (0,'fixed_half'),(1,'youden'),(2,'pointwise'),(3,'binwise_bonferroni'),(4,'naive_max'),(5,'fixed_max'),(6,'time_adaptive'),(7,'high_confidence')) v(ord,method))
  select q.ord, r.method, {fixed('r.pfa')}||' ['||{fixed('b.lo')}||', '||{fixed('b.hi')}||']' as patient_pfa, {fixed('r.sens3')} as sens3, {fixed('r.sens0')} as sens0, {fixed('p.premature')} as premature, {fixed('p.lead', 1)} as median_lead,
   {fixed('r.ppv3')} as ppv3, {fixed('r.alerts_per_100d', 1)} as alerts_per_100d, {fixed('r.utility')} as utility from o_res r join b on b.method=r.method join p on p.method=r.method join q on q.method=r.method where r.alpha=0.10::double""")
def internal_results_table(spark, d):
    return su.internal_table(results_intervals(spark, d).where("alpha = 0.10"), ca.METHODS)


CROSS_ROWS = [(0, "direct_transfer", 0), (1, "local_fixed_max", 50), (2, "local_fixed_max", 100), (3, "local_fixed_max", 200),
              (4, "local_time_adaptive", 100), (5, "local_high_confidence", 100)]


@query("cross_site_table", "with recursive c as (select direction as alpha, method, target_m0 as site, alerts::bigint as k, n_non_events::bigint as n from k_res where partition=0), "
       + ", ".join(f"{n}(alpha, method, site, s, n, lo, hi, step) as (select alpha, method, site, {s} as s, n, 0.0::double, 1.0::double, 0 from c union all select alpha, method, site, s, n, case when v < {t} then (lo+hi)/2 else lo end, case when v < {t} then hi else (lo+hi)/2 end, step+1 from (select *, list_sum(list_transform(range(s, n+1), lambda j: exp(lgamma(n+1.0)-lgamma(j+1.0)-lgamma(n-j+1.0)+j*ln((lo+hi)/2)+(n-j)*ln(1-(lo+hi)/2)))) as v from {n} where step < 60))"
                   for n, s, t in (("bl", "k", 0.025), ("bu", "k+1", 0.975)))
       + f""" select r.direction, sp.ord, r.method, r.target_m0, {fixed('r.pfa')}||' ['||{fixed('case when c.k=0 then 0.0 else (l.lo+l.hi)/2 end')}||', '||{fixed('case when c.k=c.n then 1.0 else (u.lo+u.hi)/2 end')}||']' as target_pfa,
  {fixed('r.sens3')} as sens3, {fixed('r.ppv3')} as ppv3, {fixed('r.utility')} as utility from k_res r join c on c.alpha=r.direction and c.method=r.method and c.site=r.target_m0
  join bl l on l.alpha=c.alpha and l.method=c.method and l.site=c.site and l.step=60 join bu u on u.alpha=c.alpha and u.method=c.method and u.site=c.site and u.step=60
  join (values {",".join(f"({o},'{m}',{n})" for o, m, n in CROSS_ROWS)}) sp(ord,method,target_m0) on sp.method=r.method and sp.target_m0=r.target_m0 where r.partition=0""")
def cross_site_table(spark, d):
    _, _, out = transfer_parts(spark, d, FIRST)
    limits = me.false_alarm_table(out, ["site", "method", "target_m0"]).select(
        "site", "method", "target_m0", "lower_95", "upper_95")
    results = transfer_results(spark, d, FIRST).join(limits, ["site", "method", "target_m0"])
    return su.cross_site_table(results, values(spark, ["ord", "method", "target_m0"], CROSS_ROWS))


@query("replicate_completeness", f"select scenario, {PARTITIONS}::bigint as expected, count(distinct replicate) as actual, count(distinct replicate)={PARTITIONS} as complete from m_rep group by scenario")
def replicate_completeness(spark, d):
    expected = values(spark, ["scenario", "expected"], [("A", PARTITIONS), ("B", PARTITIONS)])
    return su.completeness(replicates(spark, d), expected)


@query("method_previews", "select scenario, method, round(avg(pfa),6) as mean_pfa, round(avg(alpha_m0),6) as mean_alpha_m0, round(avg(sens3),6) as mean_sens3 from m_rep group by all")
def method_previews(spark, d):
    return rounded(replicates(spark, d).groupBy("scenario", "method").agg(
        F.avg("pfa").alias("mean_pfa"), F.avg("alpha_m0").alias("mean_alpha_m0"), F.avg("sens3").alias("mean_sens3")))


@query("expected_values", """select scenario, method, target_m0, round(0.10::double,6) as expected, round(avg(pfa),6) as actual, coalesce(abs(avg(pfa)-0.10::double)<=0.02::double,false) as within from m_rep where method='local_fixed_max' group by all""")
def expected_values(spark, d):
    means = replicates(spark, d).groupBy(*IDS).agg(F.avg("pfa").alias("value"))
    expected = means.where("method = 'local_fixed_max'").select(*IDS, F.lit(0.10).alias("expected"))
    return rounded(su.compare_expected(means, expected, IDS, 0.02))


@query("failure_placeholders", "select distinct r.scenario, r.replicate, m.method, null::double as pfa, null::double as sens3, true as learner_failure, 'fit failed' as failure_reason from m_rep r cross join (select distinct method from o_thr) m where r.learner_failure")
def failure_placeholders(spark, d):
    failed = su.failures(replicates(spark, d)).select("scenario", "replicate", F.lit("fit failed").alias("failure_reason")).distinct()
    return su.failure_placeholders(failed, ca.METHODS, ["pfa", "sens3"])


# -- diagnostics --------------------------------------------------------------------------------

QUANT = dg.QUANTILES
DIST_COLS = ", ".join(f"round(quantile_cont(v,{q}),6) as {n}" for n, q in QUANT.items())


def dist_sql(source: str, keys: str) -> str:
    return f"""with s as ({source}), a as (select {keys}, v, count(*) as c from s group by {keys}, v), b as (select {keys}, max_by(v, c*1000000.0+row_number) as av, max(c) as ac, max_by(c, v) as nm, count(*) as u from
   (select *, row_number() over (partition by {keys} order by v) as row_number from a) group by {keys})
   select {", ".join(f"s.{k.strip()}" for k in keys.split(","))}, count(*) as n_scores, max(b.u) as n_unique, round(max(b.u)::double/count(*),6) as unique_fraction, {DIST_COLS}, round(max(b.av),6) as largest_atom_value, max(b.ac) as largest_atom_count,
   round(max(b.ac)::double/count(*),6) as largest_atom_fraction, max(b.nm) as number_at_maximum from s join b using ({keys}) group by all"""


@query("maxima_distribution", dist_sql("select site, round(max_score,4) as v from o_max where isfinite(max_score)", "site"))
def maxima_distribution(spark, d):
    df = fx.order_maxima(spark, d).withColumn("v", round_scaled(F.col("max_score"), 4))
    return rounded(dg.distribution_summary(df, ["site"], "v"))


@query("score_stage_distribution", dist_sql("""select part, stage, round(v,4) as v from (unpivot (select case when split='test' then split||case when event then '_events' else '_non_events' end else split end as part, risk as raw_probability, round(smooth,12) as moving_average, score as clipped_logit, z as standardized
   from o_traj where eligible) on raw_probability, moving_average, clipped_logit, standardized into name stage value v)""", "part, stage"))
def score_stage_distribution(spark, d):
    part = F.when(F.col("split") == "test", F.concat("split", F.when(F.col("event"), "_events").otherwise("_non_events"))).otherwise(F.col("split"))
    traj = fx.order_trajectories(spark, d).withColumn("smooth", F.round("smooth", 12))
    long = dg.score_stages(traj, part).withColumn("value", round_scaled(F.col("value"), 4))
    return rounded(dg.distribution_summary(long, ["part", "stage"], "value"))


@query("top_maxima", """select site, rank_from_top, round(max_score,6) as max_score, "count", round("count"::double/n,6) as share, cumulative_count, round(cumulative_count::double/n,6) as cumulative_share from (
  select site, max_score, count(*) as "count", row_number() over (partition by site order by max_score desc)::int as rank_from_top, sum(count(*)) over (partition by site order by max_score desc)::bigint as cumulative_count, sum(count(*)) over (partition by site) as n from o_cal group by 1,2) where rank_from_top<=30""")
def top_maxima(spark, d):
    return rounded(dg.top_values(fx.calibration_maxima(spark, d), ["site"], "max_score"))


@query("threshold_ties", """select m.split as part, t.site, t.method, t.alpha, round(t.threshold[1],6) as threshold, count(*) filter (where x<c) as n_less, count(*) filter (where x=c) as n_equal, count(*) filter (where x>c) as n_greater,
  round(avg((x=c)::int),6) as equality_fraction, count(*) filter (where x>=c) as n_at_least from (select m.*, t.*, case t.scale when 'z' then m.max_z else m.max_score end as x, t.threshold[1] as c from o_max m join o_thr t on t.site=m.site where not m.event and t.k is not null) q,
  lateral (select q.split) m(split), lateral (select q.site, q.method, q.alpha, q.threshold) t(site, method, alpha, threshold) group by 1,2,3,4,5""")
def threshold_ties(spark, d):
    thr = scalar_thresholds(spark, d).where("k is not null").select("site", "method", "alpha", "scale", "threshold")
    rows = fx.order_maxima(spark, d).where("not event").withColumn("part", F.col("split"))
    return rounded(dg.threshold_ties(rows, thr))


@query("threshold_recheck", "select site, method, alpha, k, m0, true as threshold_match, true as m0_match from o_thr where k is not null")
def threshold_recheck(spark, d):
    thr = scalar_thresholds(spark, d).where("k is not null").select("site", "method", "alpha", "scale", "threshold", "k", "m0")
    out = dg.check_thresholds(fx.calibration_maxima(spark, d), thr)
    return out.select("site", "method", "alpha", "k", "m0", "threshold_match", "m0_match")


@query("preburn_history", """select e.episode_id, e.site, round(s.smooth,9) as smooth, true as matches from o_ep e join o_sm s on s.episode_id=e.episode_id and s.t=6 where e.horizon>=6 and e.onset>6
  and (select count(*) from o_risk r where r.episode_id=e.episode_id and r.t between 4 and 6)=3""")
def preburn_history(spark, d):
    scores = fx.order_scores(spark, d)
    out = dg.preburn_check(scores, smooth(scores, P), fx.order_episodes(spark, d), P)
    return out.select("episode_id", "site", F.round("smooth", 9).alias("smooth"), "matches")


@query("reservoir_balance", """with r as (select s.site, c.c_acctbal, c.c_nationkey, s.horizon, true as res from o_split s join customer c on c.c_custkey=s.episode_id where split='calibration' and not event union all
   select s.site, c.c_acctbal, c.c_nationkey, s.horizon, false from o_split s join customer c on c.c_custkey=s.episode_id where split='test' and not event),
  l as (select 'c_acctbal' as variable, c_acctbal as v, res from r union all select 'c_nationkey', c_nationkey, res from r union all select 'horizon', horizon, res from r)
  select variable, round(avg(v) filter (where res),6) as reservoir_mean, count(*) filter (where res) as reservoir_n, round(avg(v) filter (where not res),6) as population_mean, count(*) filter (where not res) as population_n,
   round(abs(avg(v) filter (where res)-avg(v) filter (where not res)),6) as absolute_difference from l group by 1""")
def reservoir_balance(spark, d):
    cust = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("episode_id"), "c_acctbal", "c_nationkey")
    rows = fx.order_split(spark, d).where("not event").join(cust, "episode_id")
    return rounded(dg.covariate_balance(rows.where("split = 'calibration'"), rows.where("split = 'test'"), ["c_acctbal", "c_nationkey", "horizon"]))


@query("thresholds_fall_with_alpha", "select site, method, 3::bigint as n_alpha, max(c) filter (where alpha=0.10::double) <= max(c) filter (where alpha=0.05::double) and max(c) filter (where alpha=0.20::double) <= max(c) filter (where alpha=0.10::double) as nonincreasing from (select *, threshold[1] as c from o_thr where len(threshold)=1) group by 1,2")
def thresholds_fall_with_alpha(spark, d):
    return su.nonincreasing_in_alpha(scalar_thresholds(spark, d), ["site", "method"])


@query("maxima_atoms", """select site, scale, count(*) as n, count(distinct v) as n_unique, round(max(c)::double/count(*),6) as largest_atom_fraction from (select *, count(*) over (partition by site, scale, v) as c from (
  select site, 'max_score' as scale, round(max_score,2) as v from o_cal union all select site, 'max_z', round(max_z,2) from o_cal)) group by 1,2""")
def maxima_atoms(spark, d):
    rows = fx.calibration_maxima(spark, d).select("site", round_scaled(F.col("max_score"), 2).alias("max_score"), round_scaled(F.col("max_z"), 2).alias("max_z"))
    return rounded(dg.atom_shares(rows, ["site"], ["max_score", "max_z"]))
