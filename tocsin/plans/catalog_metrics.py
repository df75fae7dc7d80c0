"""Queries on operating metrics, resampling, transfer and subgroups (``orders``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import age_group, eligible_hours, unit_type, window_evaluable
from tocsin.functions.tables import each
from tocsin.operators import alerts as al
from tocsin.operators import calibrate as ca
from tocsin.operators import metrics as me
from tocsin.operators import ranking as rk
from tocsin.operators import resample as rs
from tocsin.operators import split as sp
from tocsin.operators import subgroups as sg
from tocsin.operators import transfer as tr
from tocsin.operators.template import add_standardized, fit_time_templates
from tocsin.operators.trajectory import flat_eligible, maxima, trajectories
from tocsin.plans import fixtures as fx
from tocsin.plans.fixtures import ORDERS as P
from tocsin.plans.fixtures import SEED
from tocsin.plans.oracle import BOOT_SLOTS, INTERNAL_SPLITS, METRICS_SQL, PARTITIONS, REPLICATES, TARGET_SIZES
from tocsin.plans.registry import query

SITES = {"A": "B", "B": "A"}
METRICS = list(me.RATIO_METRICS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def out10(spark, d) -> DataFrame:
    return fx.order_outcomes(spark, d).where("alpha = 0.10")


# -- the flagship: trajectories to false alarms ----------------------------------------

@query("site_false_alarm", """select t.site, t.m0, t.k, round(t.alpha_m0,6) as alpha_m0, round(t.threshold[1],6) as threshold,
  count(*) filter (where not o.event) as n_non_events, round(count(*) filter (where not o.event and o.alerted)::double/count(*) filter (where not o.event),6) as pfa
  from o_thr t join o_out o on o.site=t.site and o.method=t.method and o.alpha=t.alpha where t.method='fixed_max' and t.alpha=0.10::double group by all""")
def site_false_alarm(spark, d):
    """Scores to smoothed trajectories, calibration maxima, the marginal threshold per
    site, and its false-alarm probability on the test episodes."""
    split = fx.order_split(spark, d)
    traj = fx.order_plain(spark, d)
    calibration = maxima(traj.where("split = 'calibration' and not event"), split.where("split = 'calibration' and not event"),
                         {"max_score": "score"})
    thresholds = ca.calibrate(calibration, traj, P, alphas=[0.10], methods=["fixed_max"])
    rows = al.outcomes(traj.where("split = 'test'"), split.where("split = 'test'"), thresholds, P)
    pfa = rows.where("not event").groupBy("site").agg(
        F.count("*").alias("n_non_events"), F.round(F.avg(F.col("alerted").cast("double")), 6).alias("pfa"))
    return thresholds.join(pfa, "site").select(
        "site", "m0", "k", F.round("alpha_m0", 6).alias("alpha_m0"),
        F.round(F.element_at("threshold", 1), 6).alias("threshold"), "n_non_events", "pfa")


# -- metrics -----------------------------------------------------------------------------

@query("episode_outcomes", """select episode_id, site, method, alpha, tau, n_ep::int as n_alert_episodes, eval3, eval0, valid3, valid0, premature, alerted,
  round(exposure_days,6) as exposure_days from o_out where alpha=0.10::double""")
def episode_outcomes(spark, d):
    return rounded(out10(spark, d).select("episode_id", "site", "method", "alpha", "tau", "n_alert_episodes", "eval3", "eval0",
                                          "valid3", "valid0", "premature", "alerted", "exposure_days"))


@query("false_alarm_probability", "select method, alpha, site, round(avg(alerted::int),6) as pfa from o_out where not event group by all")
def false_alarm_probability(spark, d):
    return rounded(fx.order_outcomes(spark, d).where("not event").groupBy("method", "alpha", "site").agg(
        F.avg(F.col("alerted").cast("double")).alias("pfa")))


@query("long_stay_false_alarm", """with e as (select episode_id, xh, row_number() over (order by xh desc, episode_id) as r, count(*) over () as n from (select distinct episode_id, exposure_hours as xh from o_out where not event))
  select method, alpha, round(avg(alerted::int),6) as long_stay_pfa, count(*) as n_long_stay from o_out o join e on e.episode_id=o.episode_id where e.r<=ceil(e.n/4.0) group by all""")
def long_stay_false_alarm(spark, d):
    episodes = fx.order_split(spark, d).where("split = 'test'").withColumn("exposure_hours", eligible_hours(P))
    return rounded(me.long_stay_pfa(fx.order_outcomes(spark, d), me.long_stay_flags(episodes)))


@query("warning_windows", """select episode_id, event and greatest(6, ceil(onset-6)) <= least(horizon, 80, ceil(onset)-1, floor(onset)) as eval0,
  event and greatest(6, ceil(onset-6)) <= least(horizon, 80, ceil(onset)-1, floor(onset-3)) as eval3 from o_ep""")
def warning_windows(spark, d):
    return fx.order_episodes(spark, d).select("episode_id", window_evaluable(P, 0).alias("eval0"), window_evaluable(P, 3).alias("eval3"))


@query("sensitivity", """select method, alpha, count(*) filter (where eval3) as n_sens3, count(*) filter (where eval0) as n_sens0,
  round(avg(valid3::int) filter (where eval3),6) as sens3, round(avg(valid0::int) filter (where eval0),6) as sens0 from o_out group by all""")
def sensitivity(spark, d):
    return rounded(me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", "n_sens3", "n_sens0", "sens3", "sens0"))


@query("premature_rate", "select method, alpha, round(avg(premature::int) filter (where eval0),6) as premature from o_out group by all")
def premature_rate(spark, d):
    return rounded(me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", "premature"))


@query("median_lead", "select method, alpha, round(median(onset-tau) filter (where valid0),6) as median_lead from o_out group by all")
def median_lead(spark, d):
    return rounded(me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", "median_lead"))


COMPONENTS_SQL = """select method, alpha, avg(alerted::int) filter (where not event) as a0, avg(alerted::int) filter (where event) as a1,
  avg(valid3::int) filter (where event) as v3, avg(valid0::int) filter (where event) as v0, avg(n_ep) filter (where not event) as e0, avg(n_ep) filter (where event) as e1,
  avg(exposure_days) filter (where not event) as x0, avg(exposure_days) filter (where event) as x1 from o_out group by all"""


@query("standardized_ppv", f"""select method, alpha, round(0.1::double*v3/nullif(0.1::double*a1+0.9::double*a0,0),6) as ppv3_standardized,
  round(0.1::double*v0/nullif(0.1::double*a1+0.9::double*a0,0),6) as ppv0_standardized from ({COMPONENTS_SQL})""")
def standardized_ppv(spark, d):
    return rounded(me.standardized_summary(fx.order_outcomes(spark, d), P).select("method", "alpha", "ppv3_standardized", "ppv0_standardized"))


@query("raw_ppv", """select method, alpha, round(count(*) filter (where valid3)::double/nullif(count(*) filter (where alerted),0),6) as ppv3,
  round(count(*) filter (where valid0)::double/nullif(count(*) filter (where alerted),0),6) as ppv0 from o_out group by all""")
def raw_ppv(spark, d):
    return rounded(me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", "ppv3", "ppv0"))


@query("standardized_burden", f"select method, alpha, round(100*(0.1::double*e1+0.9::double*e0)/(0.1::double*x1+0.9::double*x0),6) as alert_burden_100d from ({COMPONENTS_SQL})")
def standardized_burden(spark, d):
    return rounded(me.standardized_summary(fx.order_outcomes(spark, d), P).select("method", "alpha", "alert_burden_100d"))


@query("raw_burden", "select method, alpha, round(100.0*sum(n_ep)/sum(exposure_days),6) as alerts_per_100d from o_out group by all")
def raw_burden(spark, d):
    return rounded(me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", "alerts_per_100d"))


@query("class_components", f"""select method, alpha, round(a0,6) as any_alert_rate_non_event, round(a1,6) as any_alert_rate_event, round(v3,6) as valid3_rate_all_events,
  round(v0,6) as valid0_rate_all_events, round(e0,6) as mean_episodes_non_event, round(e1,6) as mean_episodes_event, round(x0,6) as mean_exposure_days_non_event,
  round(x1,6) as mean_exposure_days_event from ({COMPONENTS_SQL})""")
def class_components(spark, d):
    df = rounded(me.class_components(fx.order_outcomes(spark, d)))
    return df.drop("n_non_events", "n_events", "n_event_evaluable3", "n_event_evaluable0")


@query("restandardized_prevalence", f"""select method, alpha, p as prevalence, round(p*v3/nullif(p*a1+(1-p)*a0,0),6) as ppv3_standardized,
  round(100*(p*e1+(1-p)*e0)/(p*x1+(1-p)*x0),6) as alert_burden_100d from ({COMPONENTS_SQL}) cross join (values (0.02::double),(0.05::double),(0.10::double)) v(p)""")
def restandardized_prevalence(spark, d):
    out = me.standardize_prevalence(me.class_components(fx.order_outcomes(spark, d)), [0.02, 0.05, 0.10])
    return rounded(out.select("method", "alpha", "prevalence", "ppv3_standardized", "alert_burden_100d"))


@query("cumulative_false_alerts", """select method, g.h::int as hour, round(count(*) filter (where tau<=g.h)::double/count(*),6) as estimate, count(*) as denominator
  from o_out cross join range(1,81) g(h) where alpha=0.10::double and not event group by method, g.h""")
def cumulative_false_alerts(spark, d):
    return rounded(me.cumulative_false_alerts(out10(spark, d), P.hmax, ["method"]).select("method", "hour", "estimate", "denominator"))


AUC_SQL = """with r as (select value, sum(w*label) as p, sum(w*(1-label)) as n from (select *, 1.0::double/count(*) over (partition by episode_id) as w from (
    select episode_id, risk as value, case when event and onset-t>0 and onset-t<=6 then 1 else 0 end as label from o_plain where split='test' and eligible and risk is not null)) group by value),
  c as (select *, sum(p) over (order by value desc) as tp, sum(n) over (order by value desc) as fp, sum(p) over () as pt, sum(n) over () as nt, row_number() over (order by value desc) as k from r),
  g as (select *, lag(tp,1,0) over (order by k) as tp0, lag(fp,1,0) over (order by k) as fp0 from c)"""


@query("weighted_auroc", AUC_SQL + " select round(sum((fp-fp0)*(tp+tp0)/2)/max(pt*nt),6) as auroc from g")
def weighted_auroc(spark, d):
    return rounded(me.threshold_free(flat_eligible(fx.order_plain(spark, d).where("split = 'test'"), P)).select("auroc"))


@query("weighted_pr_auc", AUC_SQL + " select round(sum((tp-tp0)/pt*(tp/(tp+fp) + case when k=1 then 1 else tp0/(tp0+fp0) end)/2),6) as pr_auc from g")
def weighted_pr_auc(spark, d):
    return rounded(me.threshold_free(flat_eligible(fx.order_plain(spark, d).where("split = 'test'"), P)).select("pr_auc"))


@query("episode_utility", "select episode_id, method, round(uo,6) as utility_observed, round(ui,6) as utility_inactive, round(ub,6) as utility_best from o_out where alpha=0.10::double")
def episode_utility(spark, d):
    return rounded(out10(spark, d).select("episode_id", "method", "utility_observed", "utility_inactive", "utility_best"))


@query("normalized_utility", "select method, alpha, round((sum(uo)-sum(ui))/(sum(ub)-sum(ui)),6) as utility, round(sum(uo),6) as raw_utility from o_out group by all")
def normalized_utility(spark, d):
    return rounded(me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", "utility", "raw_utility"))


def bisect_cte(name: str, s: str, target: float) -> str:
    tail = ("list_sum(list_transform(range(s, n+1), lambda j: exp(lgamma(n+1.0)-lgamma(j+1.0)-lgamma(n-j+1.0)"
            "+j*ln((lo+hi)/2)+(n-j)*ln(1-(lo+hi)/2))))")
    return (f"{name}(alpha, method, site, s, n, lo, hi, step) as (select alpha, method, site, {s} as s, n, 0.0::double, 1.0::double, 0 from c "
            f"union all select alpha, method, site, s, n, case when v < {target} then (lo+hi)/2 else lo end, case when v < {target} then hi else (lo+hi)/2 end, step+1 "
            f"from (select *, {tail} as v from {name} where step < 60))")


@query("false_alarm_limits", "with recursive c as (select alpha, method, site, count(*) filter (where alerted)::bigint as k, count(*)::bigint as n from o_out where not event group by all), "
       + ", ".join([bisect_cte("bl", "k", 0.025), bisect_cte("bu", "k+1", 0.975), bisect_cte("bo", "k+1", 0.95)])
       + """ select c.alpha, c.method, c.site, c.k as alerts, c.n as n_non_events, round(c.k::double/c.n,6) as pfa, round(case when c.k=0 then 0.0 else (l.lo+l.hi)/2 end,6) as lower_95,
  round(case when c.k=c.n then 1.0 else (u.lo+u.hi)/2 end,6) as upper_95, round(case when c.k=c.n then 1.0 else (o.lo+o.hi)/2 end,6) as upper_one_sided_95
  from c join bl l using (alpha, method, site) join bu u using (alpha, method, site) join bo o using (alpha, method, site) where l.step=60 and u.step=60 and o.step=60""")
def false_alarm_limits(spark, d):
    return rounded(me.false_alarm_table(fx.order_outcomes(spark, d)))


@query("operating_results", f"""select method, alpha, {METRICS_SQL}, count(*) filter (where not event) as n_non_events, count(*) filter (where event) as n_events,
  count(*) filter (where alerted) as n_alerted, sum(n_ep)::bigint as total_alert_episodes, round(sum(exposure_days),6) as exposure_days from o_out group by all""")
def operating_results(spark, d):
    return rounded(me.summary(fx.order_outcomes(spark, d)).select(
        "method", "alpha", *METRICS, "n_non_events", "n_events", "n_alerted", "total_alert_episodes", "exposure_days"))


@query("ratio_metrics_by_site", f"select method, alpha, site, {METRICS_SQL} from o_out group by all")
def ratio_metrics_by_site(spark, d):
    return rounded(fx.order_outcomes(spark, d).groupBy("method", "alpha", "site").agg(*me.ratio_metrics()))


# -- resampling ---------------------------------------------------------------------------

def test_episodes(spark, d) -> DataFrame:
    return fx.order_split(spark, d).where("split = 'test'")


def pooled_outcomes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Outcomes numbered by (method, alpha) alone, and the table of these numbers."""
    def build() -> DataFrame:
        names = fx.order_thresholds(spark, d).select("method", "alpha").distinct()
        return names.withColumn("op", F.row_number().over(Window.orderBy("method", "alpha")))
    names = fx.shared(spark, d, "pooled-ops", build)
    return fx.order_outcomes(spark, d).drop("op").join(F.broadcast(names), ["method", "alpha"]), F.broadcast(names)


def samples(spark, d) -> DataFrame:
    def build() -> DataFrame:
        rows, names = pooled_outcomes(spark, d)
        return rs.bootstrap_metrics(rows, names, ["site", "event"], REPLICATES, SEED, BOOT_SLOTS).drop("op")
    return fx.shared(spark, d, "order-bootstrap", build)


@query("bootstrap_draws", "select bootstrap, stratum, position, multiplicity from o_mult")
def bootstrap_draws(spark, d):
    indexed = rs.indexed_episodes(test_episodes(spark, d), ["site", "event"], SEED)
    return rs.multiplicities(indexed, REPLICATES, SEED, BOOT_SLOTS).select("bootstrap", "stratum", "position", "multiplicity")


@query("bootstrap_custom_statistic", """select d.bootstrap, round(sum(d.multiplicity*e.horizon)::double/sum(d.multiplicity),6) as mean_horizon, round(sum(case when e.event then d.multiplicity else 0 end)::double/sum(d.multiplicity),6) as event_share
  from o_mult d join o_bidx i on i.stratum=d.stratum and i.position=d.position join o_teste e on e.episode_id=i.episode_id group by d.bootstrap""")
def bootstrap_custom_statistic(spark, d):
    return rounded(rs.bootstrap_statistics(test_episodes(spark, d), {
        "mean_horizon": lambda w: F.sum(F.col("horizon") * w) / F.sum(w),
        "event_share": lambda w: F.sum(F.col("event").cast("double") * w) / F.sum(w),
    }, ["site", "event"], REPLICATES, SEED, BOOT_SLOTS))


@query("bootstrap_samples", "select bootstrap, method, alpha, pfa, sens3, sens0, ppv3, alerts_per_100d, utility from o_bs")
def bootstrap_samples(spark, d):
    return rounded(rounded(samples(spark, d), 10))


@query("bootstrap_summary", """select r.method, r.alpha, r.metric, round(r.value,6) as observed, round(stddev_samp(b.value),6) as bootstrap_se, round(quantile_cont(b.value,0.025),6) as lower_95,
  round(quantile_cont(b.value,0.975),6) as upper_95, count(b.value) as valid_bootstrap from o_reslong r left join o_bslong b on b.method=r.method and b.alpha=r.alpha and b.metric=r.metric group by r.method, r.alpha, r.metric, r.value""")
def bootstrap_summary(spark, d):
    observed = me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", *METRICS)
    return rounded(rs.summarize_bootstrap(samples(spark, d), observed, ["method", "alpha"]))


@query("method_contrasts", """with s as (select b.bootstrap, b.alpha, b.method, b.metric, b.value-f.value as diff from o_bslong b join o_bslong f on f.bootstrap=b.bootstrap and f.alpha=b.alpha and f.metric=b.metric and f.method='fixed_max' where b.method not in ('fixed_max','naive_max')),
  o as (select b.alpha, b.method, b.metric, b.value-f.value as diff from o_reslong b join o_reslong f on f.alpha=b.alpha and f.metric=b.metric and f.method='fixed_max' where b.method not in ('fixed_max','naive_max'))
  select o.alpha, o.method||' minus fixed_max' as comparison, o.metric, round(o.diff,6) as observed_difference, round(stddev_samp(s.diff),6) as bootstrap_se, round(quantile_cont(s.diff,0.025),6) as lower_95,
  round(quantile_cont(s.diff,0.975),6) as upper_95, count(s.diff) as valid_bootstrap from o left join s on s.alpha=o.alpha and s.method=o.method and s.metric=o.metric group by o.alpha, o.method, o.metric, o.diff""")
def method_contrasts(spark, d):
    observed = me.summary(fx.order_outcomes(spark, d)).select("method", "alpha", *METRICS)
    out = rs.paired_contrasts(samples(spark, d), observed, "fixed_max", exclude=["naive_max"])
    return rounded(out)


@query("curve_bands", """with hits as (select m.bootstrap, m.multiplicity as w, i.site, o.method, o.tau from c_mult m join c_bidx i on i.stratum=m.stratum and i.position=m.position
    join o_out o on o.episode_id=i.episode_id and o.alpha=0.10::double),
  steps as (select bootstrap, p.panel, method, tau, sum(w) as w from hits cross join lateral (values ('overall'),(site)) p(panel) group by all),
  tot as (select bootstrap, panel, method, sum(w) as n from steps group by all),
  grid as (select t.*, g.h::int as hour, coalesce(a.w, 0) as w from tot t cross join range(1,81) g(h) left join steps a on a.bootstrap=t.bootstrap and a.panel=t.panel and a.method=t.method and a.tau=g.h),
  cv as (select panel, method, hour, sum(w) over (partition by bootstrap, panel, method order by hour)::double/n as p from grid),
  ob as (select p.panel, method, g.h::int as hour, round(count(*) filter (where tau<=g.h)::double/count(*),6) as estimate, count(*) as denominator
    from o_out cross join lateral (values ('overall'),(site)) p(panel) cross join range(1,81) g(h) where alpha=0.10::double and not event group by all)
  select cv.panel, cv.method, cv.hour, estimate, denominator, round(quantile_cont(p,0.025),6) as lower_95, round(quantile_cont(p,0.975),6) as upper_95
  from cv join ob using (panel, method, hour) group by all""")
def curve_bands(spark, d):
    rows, names = pooled_outcomes(spark, d)
    names = names.where("alpha = 0.10").select("op", "method")
    out = rs.curve_bands(rows.where("alpha = 0.10"), names, P.hmax, REPLICATES, SEED, BOOT_SLOTS)
    return rounded(out.select("panel", "method", "hour", "estimate", "denominator", "lower_95", "upper_95"))


@query("results_with_intervals", """select r.method, r.alpha, round(r.pfa,6) as pfa, round(quantile_cont(b.value,0.025),6) as pfa_lower_95, round(quantile_cont(b.value,0.975),6) as pfa_upper_95
  from o_res r join o_bslong b on b.method=r.method and b.alpha=r.alpha and b.metric='pfa' group by r.method, r.alpha, r.pfa""")
def results_with_intervals(spark, d):
    return rounded(results_intervals(spark, d).select("method", "alpha", "pfa", "pfa_lower_95", "pfa_upper_95"))


def results_intervals(spark, d) -> DataFrame:
    results = me.summary(fx.order_outcomes(spark, d))
    spread = rs.summarize_bootstrap(samples(spark, d), results.select("method", "alpha", "pfa"), ["method", "alpha"], ["pfa"])
    return results.join(spread.select("method", "alpha", F.col("lower_95").alias("pfa_lower_95"), F.col("upper_95").alias("pfa_upper_95")),
                        ["method", "alpha"], "left")


# -- transfer and robustness -----------------------------------------------------------------

ALL_PARTITIONS, FIRST = tuple(range(PARTITIONS)), (0,)


def transfer_tag(partitions, sizes) -> str:
    return f"{len(partitions)}-{'-'.join(map(str, sizes))}"


def transfer_split(spark, d, partitions=ALL_PARTITIONS) -> DataFrame:
    """Target partitions; each one is drawn by itself, so one of them is the same alone."""
    return fx.shared(spark, d, f"target-split-{len(partitions)}", lambda: tr.repeated_splits(
        fx.order_episodes(spark, d), partitions, tr.TARGET_SHARES, SEED, "target"))


def transfer_trajectories(spark, d) -> DataFrame:
    source = {SITES[s]: t for s, t in fx.order_site_templates(spark, d).items()}
    return add_standardized(fx.order_plain(spark, d), source, P, key="site")


def direct_source(spark, d, partitions=ALL_PARTITIONS) -> DataFrame:
    def build() -> DataFrame:
        keep = "split = 'calibration' and not event"
        peaks = maxima(fx.order_plain(spark, d).where(keep), fx.order_split(spark, d).where(keep), {"max_score": "score"})
        return ca.calibrate(peaks, fx.order_plain(spark, d).where(keep), P, alphas=[0.10], methods=["fixed_max"])
    return tr.direct_thresholds(fx.shared(spark, d, "direct-source", build), partitions, SITES)


def transfer_thresholds(spark, d, partitions=ALL_PARTITIONS, sizes=TARGET_SIZES) -> DataFrame:
    def build() -> DataFrame:
        peaks = maxima(transfer_trajectories(spark, d), fx.order_episodes(spark, d), {"max_score": "score", "max_z": "z"})
        local = tr.local_thresholds(tr.reservoir_prefixes(transfer_split(spark, d, partitions), sizes, SEED), peaks, 0.10, P.delta)
        return tr.transfer_thresholds(direct_source(spark, d, partitions), local)
    return fx.shared(spark, d, f"target-thresholds-{transfer_tag(partitions, sizes)}", build)


def transfer_parts(spark, d, partitions=ALL_PARTITIONS, sizes=TARGET_SIZES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split, thresholds, outcomes) of the target partitions, written once per setting. Outcomes have a
    row per test episode and threshold; results and curves of all partitions do without them."""
    split, thr = transfer_split(spark, d, partitions), transfer_thresholds(spark, d, partitions, sizes)
    out = fx.shared(spark, d, f"target-outcomes-{transfer_tag(partitions, sizes)}", lambda: tr.target_outcomes(
        transfer_trajectories(spark, d), split, thr, P))
    return split, thr, out


def transfer_results(spark, d, partitions=ALL_PARTITIONS) -> DataFrame:
    def build() -> DataFrame:
        thr = transfer_thresholds(spark, d, partitions)
        res = tr.target_summary(transfer_trajectories(spark, d), transfer_split(spark, d, partitions), thr, P)
        return res.withColumn("direction", tr.direction(SITES))
    return fx.shared(spark, d, f"transfer-results-{len(partitions)}", build)


@query("direct_transfer_thresholds", "select case when site='A' then 'B_to_A' else 'A_to_B' end as direction, round(threshold[1],6) as threshold, m0, k from k_thr where method='direct_transfer' and partition=0")
def direct_transfer_thresholds(spark, d):
    return direct_source(spark, d, FIRST).select(tr.direction(SITES).alias("direction"), F.round(F.element_at("threshold", 1), 6).alias("threshold"), "m0", "k")


@query("local_recalibration_thresholds", "select site, partition, target_m0, method, round(threshold[1],6) as threshold, m0, k, round(alpha_m0,6) as alpha_m0 from k_thr where method<>'direct_transfer' union all select site, partition, target_m0, method, null, m0, null, null from k_short")
def local_recalibration_thresholds(spark, d):
    found = transfer_thresholds(spark, d).where("method <> 'direct_transfer'").select(
        "site", "partition", "target_m0", "method", F.element_at("threshold", 1).alias("threshold"), "m0", "k", "alpha_m0")
    return rounded(found.unionByName(transfer_shortfalls(spark, d), allowMissingColumns=True))


def transfer_shortfalls(spark, d, partitions=ALL_PARTITIONS) -> DataFrame:
    """Partitions whose reservoir is too small for a calibration size: (site, partition, target_m0, method, m0)."""
    return tr.shortfalls(transfer_split(spark, d, partitions), TARGET_SIZES)


def with_shortfalls(results: DataFrame, short: DataFrame) -> DataFrame:
    """Results with a row of undefined metrics for every shortfall."""
    named = short.select("site", "partition", "target_m0", "method").withColumn("direction", tr.direction(SITES))
    return results.unionByName(named, allowMissingColumns=True)


@query("cross_site_transfer", f"""select case when site='A' then 'B_to_A' else 'A_to_B' end as direction, method, target_m0, {METRICS_SQL} from k_out where partition=0 group by site, method, target_m0
  union all select case when site='A' then 'B_to_A' else 'A_to_B' end, method, target_m0, null, null, null, null, null, null from k_short where partition=0""")
def cross_site_transfer(spark, d):
    rows = with_shortfalls(transfer_results(spark, d, FIRST), transfer_shortfalls(spark, d, FIRST))
    return rounded(rows.select("direction", "method", "target_m0", *METRICS))


@query("target_partitions", f"""select case when site='A' then 'B_to_A' else 'A_to_B' end as direction, partition, method, target_m0, {METRICS_SQL} from k_out group by site, partition, method, target_m0
  union all select case when site='A' then 'B_to_A' else 'A_to_B' end, partition, method, target_m0, null, null, null, null, null, null from k_short""")
def target_partitions(spark, d):
    rows = with_shortfalls(transfer_results(spark, d), transfer_shortfalls(spark, d))
    return rounded(rows.select("direction", "partition", "method", "target_m0", *METRICS))


@query("target_bootstrap", """select case when r.site='A' then 'B_to_A' else 'A_to_B' end as direction, r.method, r.target_m0, r.metric, round(r.value,6) as observed, round(stddev_samp(b.value),6) as bootstrap_se,
  round(quantile_cont(b.value,0.025),6) as lower_95, round(quantile_cont(b.value,0.975),6) as upper_95, count(b.value) as valid_bootstrap
  from t_reslong r left join t_long b on b.site=r.site and b.method=r.method and b.target_m0=r.target_m0 and b.metric=r.metric group by r.site, r.method, r.target_m0, r.metric, r.value""")
def target_bootstrap(spark, d):
    """Intervals of every strategy on the target test episodes, from draws by site and event."""
    _, thr, rows = transfer_parts(spark, d, FIRST)
    keys = ["site", "target_m0", "method"]
    ops = thr.select("op", *keys)
    draws = rs.bootstrap_metrics(rows, ops, ["site", "event"], REPLICATES, SEED, BOOT_SLOTS, by=["site"])
    observed = rows.groupBy(*keys).agg(*me.ratio_metrics())
    return rounded(rs.summarize_bootstrap(draws.drop("op"), observed, keys).withColumn("direction", tr.direction(SITES)).drop("site"))


@query("target_discrimination", """with w as (select site, risk as value, case when event and onset-t>0 and onset-t<=6 then 1 else 0 end as label, 1.0::double/count(*) over (partition by site, episode_id) as w
    from k_test where partition=0 and eligible and risk is not null),
  r as (select site, value, sum(w*label) as p, sum(w*(1-label)) as n from w group by all),
  c as (select *, sum(p) over s as tp, sum(n) over s as fp, sum(p) over (partition by site) as pt, sum(n) over (partition by site) as nt, row_number() over (partition by site order by value desc) as k from r window s as (partition by site order by value desc)),
  g as (select *, lag(tp,1,0) over (partition by site order by k) as tp0, lag(fp,1,0) over (partition by site order by k) as fp0 from c)
  select case when site='A' then 'B_to_A' else 'A_to_B' end as direction, round(sum((fp-fp0)*(tp+tp0)/2)/max(pt*nt),6) as auroc,
    round(sum((tp-tp0)/pt*(tp/(tp+fp) + case when k=1 then 1 else tp0/(tp0+fp0) end)/2),6) as pr_auc from g group by site""")
def target_discrimination(spark, d):
    """Threshold-free measures of the target test episodes of the first partition."""
    test = transfer_split(spark, d, FIRST).where("split = 'test'").select("episode_id")
    rows = fx.order_plain(spark, d).join(test, "episode_id").select("site", "episode_id", "t", "risk", "eligible", "event", "onset")
    flat = flat_eligible(rows, P)
    return rounded(me.threshold_free(flat, ["site"]).select(tr.direction(SITES).alias("direction"), "auroc", "pr_auc"))


@query("repeated_internal_splits", f"""select split_no, method, site, {METRICS_SQL} from i_out where method='fixed_max' group by all
  union all select split_no, method, 'overall' as site, {METRICS_SQL} from i_out where method='pooled' group by split_no, method""")
def repeated_internal_splits(spark, d):
    numbers = tuple(range(1, INTERNAL_SPLITS + 1))
    split = fx.shared(spark, d, "internal-splits", lambda: tr.repeated_splits(
        fx.order_episodes(spark, d), numbers, fx.SHARES, SEED, "internal", number="split_no"))
    peaks = split.where("split = 'calibration' and not event").select("split_no", "site", "episode_id").join(
        fx.order_maxima(spark, d).select("episode_id", "max_score"), "episode_id")
    alphas = [0.10]
    by_site = ["site", "split_no"]
    local = ca.marginal_thresholds(rk.distinct_values(peaks, by_site, "max_score"), rk.group_sizes(peaks, by_site), alphas, by_site, "max_score")
    pooled = ca.marginal_thresholds(rk.distinct_values(peaks, ["split_no"], "max_score"), rk.group_sizes(peaks, ["split_no"]), alphas, ["split_no"], "max_score", "pooled")
    thr = ca.number_ops(local.unionByName(each(pooled, "site", SITES)).withColumn("target_m0", F.lit(0)), by_site)
    out = tr.target_outcomes(fx.order_plain(spark, d), split, thr, P, number="split_no")
    level = F.when(F.col("method") == "pooled", "overall").otherwise(F.col("site"))
    return rounded(out.withColumn("_level", level).groupBy("split_no", "method", "_level").agg(*me.ratio_metrics()).withColumnRenamed("_level", "site"))


def evaluate_setting(spark, d, p, plain: DataFrame, episodes: DataFrame, methods: list[str], template_hmax: int | None = None) -> DataFrame:
    """Template, thresholds and outcomes at alpha 0.10 under changed parameters."""
    keep = "split = 'validation' and not event"
    cal = "split = 'calibration' and not event"
    if "time_adaptive" in methods:
        q = p.with_(hmax=template_hmax or p.hmax)
        plain = add_standardized(plain, fit_time_templates(plain.where(keep), episodes.where(keep), q), p)
        columns = {"max_score": "score", "max_z": "z"}
    else:
        columns = {"max_score": "score"}
    peaks = maxima(plain.where(cal), episodes.where(cal), columns)
    thr = ca.calibrate(peaks, plain.where(cal), p, alphas=[0.10], methods=methods)
    return al.outcomes(plain.where("split = 'test'"), episodes.where("split = 'test'"), thr, p)


@query("horizon_sweep", "\n union all ".join(f"select '{h}' as setting, method, {METRICS_SQL} from h{h}_out group by method" for h in (40, 60, 80)))
def horizon_sweep(spark, d):
    parts = []
    for h in (40, 60, 80):
        p = P.with_(hmax=h)
        out = evaluate_setting(spark, d, p, fx.order_plain(spark, d).where(F.col("t") <= h), fx.order_split(spark, d),
                               ["fixed_max", "time_adaptive", "high_confidence"])
        parts.append(out.groupBy(F.lit(str(h)).alias("setting"), "method").agg(*me.ratio_metrics()))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("uncapped_horizon", f"select method, {METRICS_SQL} from h80_out group by method")
def uncapped_horizon(spark, d):
    p = P.with_(hmax=None)
    plain = trajectories(fx.order_scores(spark, d), fx.order_split(spark, d), p)
    longest = fx.order_split(spark, d).agg(F.max("horizon")).first()[0]
    out = evaluate_setting(spark, d, p, plain, fx.order_split(spark, d), ["fixed_max", "time_adaptive", "high_confidence"], longest)
    return rounded(out.groupBy("method").agg(*me.ratio_metrics()))


@query("pooled_threshold_sensitivity", """with t as (select max_score as c from (select max_score, row_number() over (order by max_score) as r, count(*) over () as m0 from o_cal) where r=ceil((m0+1)*(1.0::double-0.10::double)))
  select round(avg((max_score > c)::int) filter (where not event),6) as pfa, count(*) filter (where max_score > c) as n_alerted, count(*) as n_patients from o_max cross join t where split='test'""")
def pooled_threshold_sensitivity(spark, d):
    peaks = fx.calibration_maxima(spark, d)
    thr = ca.marginal_thresholds(rk.distinct_values(peaks, [], "max_score"), peaks.agg(F.count("*").alias("m0")), [0.10], [], "max_score")
    thr = ca.number_ops(each(thr, "site", SITES), ["site"])
    out = al.outcomes(fx.order_plain(spark, d).where("split = 'test'"), test_episodes(spark, d), thr, P)
    return rounded(out.agg(me.ratio_metrics()[0], F.count(F.when(F.col("alerted"), 1)).alias("n_alerted"), F.count("*").alias("n_patients")))


@query("all_recorded_false_alarm", """with x as (select site, floor(0.2::double*count(*)+0.5::double)::bigint as n from o_ep where not event and horizon<44 group by site),
  b as (select count(*) filter (where alerted) as a, count(*) as n from o_out where method='fixed_max' and alpha=0.10::double and not event and horizon>=44)
  select round(b.a::double/(b.n+e.n),6) as pfa, (b.n+e.n)::bigint as n_non_events, b.a as n_alerted, e.n::bigint as below_landmark from b cross join (select sum(n) as n from x) e""")
def all_recorded_false_alarm(spark, d):
    excluded = fx.order_episodes(spark, d).where("not event and horizon < 44")
    extra = sp.sample_fraction(excluded, 0.2, SEED)
    patients = out10(spark, d).where("method = 'fixed_max' and horizon >= 44")
    return rounded(tr.all_recorded_pfa(patients, extra))


@query("no_smoothing", f"select site, {METRICS_SQL} from l1_out group by site")
def no_smoothing(spark, d):
    p = P.with_(smooth_length=1)
    plain = trajectories(fx.order_scores(spark, d), fx.order_split(spark, d), p)
    out = evaluate_setting(spark, d, p, plain, fx.order_split(spark, d), ["fixed_max"])
    return rounded(out.groupBy("site").agg(*me.ratio_metrics()))


@query("partition_spread", """select direction, method, target_m0, metric, count(value) as n_defined, round(median(value),6) as median, round(quantile_cont(value,0.25),6) as q1,
  round(quantile_cont(value,0.75),6) as q3, round(min(value),6) as minimum, round(max(value),6) as maximum from (select direction, method, target_m0, metric, case metric when 'pfa' then pfa when 'sens3' then sens3 when 'ppv3' then ppv3 else alerts_per_100d end as value from k_res cross join (values ('pfa'),('sens3'),('ppv3'),('alerts_per_100d')) m(metric)) group by all""")
def partition_spread(spark, d):
    return rounded(tr.descriptive_summary(transfer_results(spark, d), ["direction", "method", "target_m0"], ["pfa", "sens3", "ppv3", "alerts_per_100d"]))


# -- subgroups -------------------------------------------------------------------------------

BASE_SQL = """select c_custkey as episode_id, case when c_acctbal>=0 then c_acctbal/100 end as age, (c_nationkey%2)::int as gender,
  case when c_nationkey%3=0 then 1 else 0 end as unit1, case when c_nationkey%3=1 or c_nationkey%5=0 then 1 end as unit2 from customer"""
AGE_SQL = "case when age is null then 'missing' when age<50 then '<50' when age<65 then '50-64' when age<80 then '65-79' else '>=80' end"
UNIT_SQL = "case when unit1=1 and coalesce(unit2,0)=1 then 'both' when unit1=1 then 'Unit1 only' when coalesce(unit2,0)=1 then 'Unit2 only' else 'neither/missing' end"


def customer_baseline(spark, d) -> DataFrame:
    n, bal = F.col("c_nationkey"), F.col("c_acctbal")
    return fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("episode_id"), F.when(bal >= 0, bal / 100).alias("age"), (n % 2).cast("int").alias("gender"),
        F.when(n % 3 == 0, 1).otherwise(0).alias("unit1"), F.when((n % 3 == 1) | (n % 5 == 0), 1).alias("unit2"))


@query("age_groups", f"select {AGE_SQL} as age_group, count(*) as n from ({BASE_SQL}) group by 1")
def age_groups(spark, d):
    return customer_baseline(spark, d).groupBy(age_group("age").alias("age_group")).agg(F.count("*").alias("n"))


@query("unit_types", f"select {UNIT_SQL} as unit_type, count(*) as n from ({BASE_SQL}) group by 1")
def unit_types(spark, d):
    return customer_baseline(spark, d).groupBy(unit_type("unit1", "unit2").alias("unit_type")).agg(F.count("*").alias("n"))


QUARTILE_CTE = """with p as (select * from o_out where method='fixed_max' and alpha=0.10::double),
  q as (select quantile_cont(exposure_days,0.25) as q1, quantile_cont(exposure_days,0.5) as q2, quantile_cont(exposure_days,0.75) as q3 from p where not event),
  s as (select p.*, case when not event then case when exposure_days<=q1 then 'Q1 shortest' when exposure_days<=q2 then 'Q2' when exposure_days<=q3 then 'Q3' else 'Q4 longest' end end as exposure_quartile from p cross join q)"""


@query("exposure_quartiles", QUARTILE_CTE + " select episode_id, exposure_quartile from s where not event")
def exposure_quartiles(spark, d):
    rows = sg.with_subgroups(out10(spark, d).where("method = 'fixed_max'"), customer_baseline(spark, d))
    return rows.where("not event").select("episode_id", "exposure_quartile")


@query("subgroup_summary", QUARTILE_CTE + f""", j as (select s.*, b.gender, {AGE_SQL.replace('age ', 'b.age ').replace('age<', 'b.age<')} as age_group, {UNIT_SQL} as unit_type from s left join ({BASE_SQL}) b on b.episode_id=s.episode_id),
  l as (select 'site' as subgroup_variable, coalesce(site::varchar,'missing') as subgroup, * exclude (site) from j union all select 'gender', coalesce(gender::varchar,'missing'), * exclude (site) from j
    union all select 'unit_type', coalesce(unit_type,'missing'), * exclude (site) from j union all select 'age_group', coalesce(age_group,'missing'), * exclude (site) from j
    union all select 'exposure_quartile', coalesce(exposure_quartile,'missing'), * exclude (site) from j)
  select subgroup_variable, subgroup, count(*) as n_patients, count(*) filter (where not event) as n_non_events, count(*) filter (where event) as n_events,
   round(avg(alerted::int) filter (where not event),6) as pfa, round(avg(valid3::int) filter (where eval3),6) as sens3,
   round(count(*) filter (where valid3)::double/nullif(count(*) filter (where alerted),0),6) as ppv3 from l group by all""")
def subgroup_summary(spark, d):
    rows = sg.with_subgroups(out10(spark, d).where("method = 'fixed_max'"), customer_baseline(spark, d))
    return rounded(sg.subgroup_summary(rows))
