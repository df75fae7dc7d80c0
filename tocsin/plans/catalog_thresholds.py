"""Queries on trajectories, calibration and alerts (driver table ``orders``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.functions.binomial import hc_index
from tocsin.functions.exprs import (
    achieved_bound, clipped_logit, eligible, expit, marginal_index, minimum_m0, threshold_state,
)
from tocsin.functions.tables import each
from tocsin.operators import alerts as al
from tocsin.operators import calibrate as ca
from tocsin.operators import ranking as rk
from tocsin.operators import template as tp
from tocsin.operators import trajectory as tj
from tocsin.plans import fixtures as fx
from tocsin.plans.fixtures import ORDERS as P
from tocsin.plans.oracle import ALPHAS
from tocsin.plans.oracle import INF as SQL_INF
from tocsin.plans.registry import query

ALPHA_GRID = (0.02, 0.05, 0.10, 0.15, 0.20)
GRID_SQL = "(values (0.02::double),(0.05::double),(0.10::double),(0.15::double),(0.20::double)) al(alpha)"


def r(c, digits: int = 6) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def test_part(spark: SparkSession, d: str) -> DataFrame:
    return fx.order_trajectories(spark, d).where("split = 'test'")


def scalar_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return fx.order_thresholds(spark, d).where("size(threshold) = 1").withColumn("threshold", F.element_at("threshold", 1))


# -- trajectories --------------------------------------------------------------------

@query("smoothed_risk", "select episode_id, t, round(smooth,12) as smooth from o_sm where smooth is not null")
def smoothed_risk(spark, d):
    return tj.smooth(fx.order_scores(spark, d), P).select("episode_id", "t", r("smooth", 12).alias("smooth"))


@query("clipped_logit_score", """select episode_id, t, round(ln(least(greatest(risk,1e-6),1-1e-6))-ln(1-least(greatest(risk,1e-6),1-1e-6)),6) as score from o_risk""")
def clipped_logit_score(spark, d):
    return fx.order_scores(spark, d).select("episode_id", "t", r(clipped_logit("risk")).alias("score"))


@query("eligible_hours", """select e.episode_id, r.t, r.t>=6 and r.t<=e.horizon and r.t<e.onset and r.t<=80 as eligible from o_risk r join o_ep e on r.episode_id=e.episode_id""")
def eligible_hours(spark, d):
    return fx.order_scores(spark, d).join(fx.order_episodes(spark, d), "episode_id").select(
        "episode_id", "t", eligible(P).alias("eligible"))


@query("trajectory_maxima", "select episode_id, site, max_score, max_z from o_max")
def trajectory_maxima(spark, d):
    return fx.order_maxima(spark, d).select("episode_id", "site", "max_score", "max_z")


@query("logistic_risk", "select episode_id, t, round(1.0::double/(1.0+exp(-((o_totalprice-250000.0)/80000.0))),9) as risk from o_months")
def logistic_risk(spark, d):
    return fx.order_months(spark, d).select("episode_id", "t", r(expit((F.col("o_totalprice") - 250000.0) / 80000.0), 9).alias("risk"))


@query("trajectory_subset", "select episode_id, t, score from o_plain where split='test' and event")
def trajectory_subset(spark, d):
    ids = fx.order_split(spark, d).where("split = 'test' and event")
    return tj.subset(fx.order_plain(spark, d), ids).select("episode_id", "t", "score")


@query("flat_eligible_rows", "select episode_id, value, label from o_flatval")
def flat_eligible_rows(spark, d):
    return tj.flat_eligible(fx.order_plain(spark, d).where("split = 'validation'"), P).select("episode_id", "value", "label")


@query("clipped_horizon", "select episode_id, t, score from o_plain where t<=40")
def clipped_horizon(spark, d):
    return tj.clip_horizon(fx.order_plain(spark, d), 40).select("episode_id", "t", "score")


# -- order statistics and thresholds --------------------------------------------------

@query("minimum_calibration_size", f"select alpha, (ceil(1.0::double/alpha)-1)::bigint as minimum_m0, m0 >= ceil(1.0::double/alpha)-1 as enough, site from o_m0 cross join {GRID_SQL}")
def minimum_calibration_size(spark, d):
    sizes = rk.group_sizes(fx.calibration_maxima(spark, d), ["site"])
    return each(sizes, "alpha", ALPHA_GRID).select(
        "alpha", minimum_m0("alpha").alias("minimum_m0"), (F.col("m0") >= minimum_m0("alpha")).alias("enough"), "site")


@query("marginal_rank", f"""select site, alpha, m0, k, round((m0+1-k)::double/(m0+1),9) as alpha_m0 from (
  select site, alpha, m0, ceil((m0+1)*(1.0::double-alpha))::bigint as k from o_m0 cross join {GRID_SQL})""")
def marginal_rank(spark, d):
    sizes = rk.group_sizes(fx.calibration_maxima(spark, d), ["site"])
    return (each(sizes, "alpha", ALPHA_GRID).withColumn("k", marginal_index("m0", "alpha"))
            .withColumn("alpha_m0", r(achieved_bound("m0", "k"), 9)))


def method_thresholds(spark, d, method: str) -> DataFrame:
    return scalar_thresholds(spark, d).where(F.col("method") == method).select(
        "site", "alpha", r("threshold", 9).alias("threshold"), "m0", "k")


def method_sql(method: str) -> str:
    return f"select site, alpha, round(threshold[1],9) as threshold, m0, k from o_thr where method='{method}'"


@query("fixed_max_threshold", method_sql("fixed_max"))
def fixed_max_threshold(spark, d):
    maxima = fx.calibration_maxima(spark, d)
    counts = rk.distinct_values(maxima, ["site"], "max_score")
    out = ca.marginal_thresholds(counts, rk.group_sizes(maxima, ["site"]), P.alphas, ["site"], "max_score")
    return out.select("site", "alpha", r(F.element_at("threshold", 1), 9).alias("threshold"), "m0", "k")


@query("high_confidence_rank", "select site, alpha, m0, k from o_hck")
def high_confidence_rank(spark, d):
    sizes = rk.group_sizes(fx.calibration_maxima(spark, d), ["site"])
    return each(sizes, "alpha", P.alphas).select(
        "site", "alpha", "m0", hc_index(F.col("m0"), F.col("alpha"), P.delta).alias("k"))


@query("high_confidence_threshold", method_sql("high_confidence"))
def high_confidence_threshold(spark, d):
    return method_thresholds(spark, d, "high_confidence")


@query("initial_boundaries", f"""select site, list_sort(list(distinct c)) as boundaries from (select distinct site, unnest([6,12,24,48,72,80]) as c from o_ep) group by site""")
def initial_boundaries(spark, d):
    return fx.order_episodes(spark, d).select("site").distinct().withColumn("boundaries", F.array(*[F.lit(b) for b in P.boundaries]))


@query("bin_membership", f"select episode_id, t, {'case when t<=12 then 0 when t<=24 then 1 when t<=48 then 2 when t<=72 then 3 else 4 end'} as bin from o_plain")
def bin_membership(spark, d):
    from tocsin.functions.exprs import bin_index

    return fx.order_plain(spark, d).select("episode_id", "t", bin_index("t", P.boundaries).alias("bin"))


@query("bin_episode_counts", "select bin, lo, hi, n_episodes from op_bins")
def bin_episode_counts(spark, d):
    return tp.bin_episode_counts(fx.order_split(spark, d).where("split = 'validation' and not event"), P)


@query("merged_bins", "select site, bin, lo, hi, n_episodes from os_tpl")
def merged_bins(spark, d):
    table = tp.template_table(spark, fx.order_site_templates(spark, d), "site")
    return table.select("site", "bin", "lo", "hi", F.col("n_episodes").cast("long").alias("n_episodes"))


@query("weighted_score_quantile", """select site, prob, round(min(score),9) as quantile from (select site, score, sum(w) over (partition by site order by score) as cum,
   sum(w) over (partition by site) as tot from (select site, score, sum(w) as w from o_calrows group by site, score)) cross join (values (0.25::double),(0.5::double),(0.75::double)) v(prob)
   where cum >= (prob - 1e-12)*tot group by site, prob""")
def weighted_score_quantile(spark, d):
    rows = fx.order_plain(spark, d).where("split = 'calibration' and not event and eligible")
    rows = rows.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("episode_id")))
    probs = [(q, q) for q in (0.25, 0.5, 0.75)]
    return rk.weighted_quantile(rows, ["site"], "score", "w", probs).withColumn("quantile", r("quantile", 9))


@query("time_template", "select bin, lo, hi, round(loc,6) as loc, round(scale,6) as scale, n_episodes from op_tpl")
def time_template(spark, d):
    return tp.template_table(spark, fx.order_templates(spark, d)).select(
        "bin", "lo", "hi", r("loc").alias("loc"), r("scale").alias("scale"), F.col("n_episodes").cast("long").alias("n_episodes"))


@query("standardized_scores", "select episode_id, t, round(z,6) as z from o_traj")
def standardized_scores(spark, d):
    return fx.order_trajectories(spark, d).select("episode_id", "t", r("z").alias("z"))


@query("time_adaptive_threshold", method_sql("time_adaptive").replace(",9)", ",6)"))
def time_adaptive_threshold(spark, d):
    return method_thresholds(spark, d, "time_adaptive").withColumn("threshold", r("threshold"))


@query("pointwise_threshold", method_sql("pointwise"))
def pointwise_threshold(spark, d):
    return method_thresholds(spark, d, "pointwise")


@query("naive_max_threshold", method_sql("naive_max").replace(",9)", ",6)"))
def naive_max_threshold(spark, d):
    return method_thresholds(spark, d, "naive_max").withColumn("threshold", r("threshold"))


@query("binwise_thresholds", "select site, alpha, bin, lo, hi, k, c from o_binc")
def binwise_thresholds(spark, d):
    maxima = fx.calibration_maxima(spark, d)
    traj = fx.order_plain(spark, d).where("split = 'calibration' and not event")
    out = ca.binwise_values(traj, rk.group_sizes(maxima, ["site"]), P.alphas, ["site"], P)
    return out.select("site", "alpha", "bin", "lo", "hi", "k", "c")


@query("hourly_thresholds", "select site, alpha, g.h::int as hour, threshold[g.h] as threshold from o_thr, range(1,81) g(h) where method='binwise_bonferroni'")
def hourly_thresholds(spark, d):
    rows = fx.order_thresholds(spark, d).where("method = 'binwise_bonferroni'")
    return rows.select("site", "alpha", F.posexplode("threshold").alias("hour", "threshold")).withColumn("hour", F.col("hour") + 1)


@query("youden_threshold", "select round(threshold,9) as threshold from o_youden")
def youden_threshold(spark, d):
    flat = tj.flat_eligible(fx.order_plain(spark, d).where("split = 'validation'"), P)
    return ca.youden_threshold(flat).select(r("threshold", 9).alias("threshold"))


@query("fixed_half_alerts", "select episode_id, min(t) as tau from o_plain where split='test' and eligible and risk > 0.5 group by episode_id")
def fixed_half_alerts(spark, d):
    return (fx.order_plain(spark, d).where("split = 'test' and eligible and risk > 0.5")
            .groupBy("episode_id").agg(F.min("t").alias("tau")))


@query("all_thresholds", "select site, method, alpha, scale, round(threshold[1],6) as first_threshold, len(threshold)::int as n_thresholds, m0, k, round(alpha_m0,9) as alpha_m0 from o_thr")
def all_thresholds(spark, d):
    return fx.order_thresholds(spark, d).select(
        "site", "method", "alpha", "scale", r(F.element_at("threshold", 1)).alias("first_threshold"),
        F.size("threshold").alias("n_thresholds"), "m0", "k", r("alpha_m0", 9).alias("alpha_m0"))


@query("row_thresholds", "select s.episode_id, s.t, round(h.threshold[1],9) as threshold, s.score > h.threshold[1] as above from o_test s join o_thr h on s.site=h.site where h.method='fixed_max' and h.alpha=0.10::double")
def row_thresholds(spark, d):
    thr = scalar_thresholds(spark, d).where("method = 'fixed_max' and alpha = 0.10").select("site", "threshold")
    return test_part(spark, d).join(F.broadcast(thr), "site").select(
        "episode_id", "t", r("threshold", 9).alias("threshold"), (F.col("score") > F.col("threshold")).alias("above"))


@query("alpha_grid_thresholds", f"""select k.site, k.alpha, k.k, round(case when k.k>k.m0 then {SQL_INF} else o.max_score end,9) as threshold from (
   select site, m0, alpha, ceil((m0+1)*(1.0::double-alpha))::bigint as k from o_m0 cross join {GRID_SQL}) k left join o_ord o on o.site=k.site and o.rs=k.k""")
def alpha_grid_thresholds(spark, d):
    maxima = fx.calibration_maxima(spark, d)
    counts = rk.distinct_values(maxima, ["site"], "max_score")
    out = ca.marginal_thresholds(counts, rk.group_sizes(maxima, ["site"]), ALPHA_GRID, ["site"], "max_score")
    return out.select("site", "alpha", "k", r(F.element_at("threshold", 1), 9).alias("threshold"))


SIZES = (20, 50, 100, 200)


@query("calibration_size_sweep", f"""with ranked as (select site, max_score, row_number() over (partition by site order by md5('42|reservoir|'||episode_id), episode_id) as pos from o_cal),
  pre as (select site, s.m as target_m0, max_score, row_number() over (partition by site, s.m order by max_score) as rr, count(*) over (partition by site, s.m) as m0
     from ranked join (values (20),(50),(100),(200)) s(m) on pos<=s.m),
  ks as (select distinct site, target_m0, m0, alpha, ceil((m0+1)*(1.0::double-alpha))::bigint as k from pre cross join {ALPHAS})
  select k.site, k.target_m0, k.alpha, k.m0, k.k, round(case when k.k>k.m0 then {SQL_INF} else p.max_score end,9) as threshold
  from ks k left join pre p on p.site=k.site and p.target_m0=k.target_m0 and p.rr=k.k""")
def calibration_size_sweep(spark, d):
    from tocsin.operators.split import nested_prefixes, non_event_order

    rows = nested_prefixes(non_event_order(fx.calibration_maxima(spark, d), fx.SEED), SIZES)
    keys = ["site", "target_m0"]
    out = ca.marginal_thresholds(rk.distinct_values(rows, keys, "max_score"), rk.group_sizes(rows, keys),
                                 P.alphas, keys, "max_score")
    return out.select(*keys, "alpha", "m0", "k", r(F.element_at("threshold", 1), 9).alias("threshold"))


@query("raw_time_boundary", "select h.site, h.alpha, p.bin, round(p.loc + h.threshold[1]*p.scale,6) as raw_boundary from op_tpl p cross join (select * from o_thr where method='time_adaptive') h")
def raw_time_boundary(spark, d):
    thr = fx.order_thresholds(spark, d).where("method = 'time_adaptive'").select("site", "alpha", "threshold")
    out = tp.raw_boundary(fx.order_templates(spark, d)[None], thr)
    return out.select("site", "alpha", "bin", r("raw_boundary").alias("raw_boundary"))


@query("pooled_threshold", f"""with c as (select max_score, row_number() over (order by max_score) as rr, count(*) over () as m0 from o_cal),
  ks as (select distinct m0, alpha, ceil((m0+1)*(1.0::double-alpha))::bigint as k from c cross join {ALPHAS})
  select k.alpha, k.m0, k.k, round(c.max_score,9) as threshold from ks k join c on c.rr=k.k""")
def pooled_threshold(spark, d):
    maxima = fx.calibration_maxima(spark, d)
    counts = rk.distinct_values(maxima, [], "max_score")
    out = ca.marginal_thresholds(counts, maxima.agg(F.count("*").alias("m0")), P.alphas, [], "max_score")
    return out.select("alpha", "m0", "k", r(F.element_at("threshold", 1), 9).alias("threshold"))


@query("reference_order_statistic", f"""with c as (select max_score, row_number() over (order by max_score) as rr, count(*) over () as n from o_max where not event),
  ks as (select distinct n as n_reference, alpha, ceil(n*(1.0::double-alpha))::bigint as k from c cross join {ALPHAS})
  select k.alpha, k.n_reference, k.k, round(c.max_score,9) as threshold from ks k join c on c.rr=k.k""")
def reference_order_statistic(spark, d):
    ref = fx.order_maxima(spark, d).where("not event").select(F.col("max_score").alias("maximum"))
    return ca.reference_order_statistic(ref, P.alphas).withColumn("threshold", r("threshold", 9))


@query("conditional_exceedance", """select h.site, h.method, h.alpha, round(avg(case when m.max_score > h.threshold[1] then 1.0 else 0.0 end),6) as conditional_pfa
  from o_max m cross join o_thr h where not m.event and h.method in ('fixed_max','high_confidence','naive_max','pointwise') group by all""")
def conditional_exceedance(spark, d):
    ref = fx.order_maxima(spark, d).where("not event").select(F.col("max_score").alias("maximum"))
    thr = scalar_thresholds(spark, d).where("method in ('fixed_max','high_confidence','naive_max','pointwise')").select("site", "method", "alpha", "threshold")
    return ca.conditional_exceedance(ref, thr).select("site", "method", "alpha", r("conditional_pfa").alias("conditional_pfa"))


STATE_SQL = f"""select site, method, alpha, case when n>0 and p>0 then 'mixed_inf' when n>0 then 'neg_inf' when p>0 then 'pos_inf' else 'finite' end as threshold_state,
  (n+p)::int as nonfinite_count, n>0 as has_neg_inf, p>0 as has_pos_inf from (select *, len(list_filter(threshold, lambda v: v=-{SQL_INF})) as n, len(list_filter(threshold, lambda v: v={SQL_INF})) as p from o_thr)"""


@query("threshold_states", STATE_SQL)
def threshold_states(spark, d):
    return fx.order_thresholds(spark, d).select("site", "method", "alpha", *threshold_state(F.col("threshold")))


@query("nonfinite_threshold_diagnostics", f"""select site, method, alpha, len(threshold)::int as n_thresholds, case when len(list_filter(threshold, lambda v: v=-{SQL_INF}))>0 then
   'empty bins map to -inf before the order statistic' else 'order statistic beyond the sample gives +inf' end as origin from o_thr where len(list_filter(threshold, lambda v: isinf(v)))>0""")
def nonfinite_threshold_diagnostics(spark, d):
    rows = fx.order_thresholds(spark, d).select("*", *threshold_state(F.col("threshold"))).where("threshold_state <> 'finite'")
    origin = F.when(F.col("has_neg_inf"), "empty bins map to -inf before the order statistic").otherwise(
        "order statistic beyond the sample gives +inf")
    return rows.select("site", "method", "alpha", F.size("threshold").alias("n_thresholds"), origin.alias("origin"))


@query("method_descriptions", """select method, scale, max(len(threshold)) > 1 as per_hour,
  case when count(k) > 0 then 'rank' when scale = 'risk' then 'outside' else 'quantile' end as source,
  scale = 'z' as standardized, false as recalibrated from o_thr group by method, scale""")
def method_descriptions(spark, d):
    return ca.describe_methods(fx.order_thresholds(spark, d))


# -- alerts ---------------------------------------------------------------------------

@query("first_alerts", "select episode_id, method, alpha, tau from o_out")
def first_alerts(spark, d):
    return fx.order_outcomes(spark, d).select("episode_id", "method", "alpha", "tau")


@query("alert_hours_by_threshold_kind", """select episode_id, t, method, start from o_hit where alpha=0.10::double and method in ('fixed_max','binwise_bonferroni','time_adaptive') and eligible""")
def alert_hours_by_threshold_kind(spark, d):
    thr = fx.order_thresholds(spark, d).where("alpha = 0.10 and method in ('fixed_max','binwise_bonferroni','time_adaptive')")
    hours = al.alert_hours(test_part(spark, d), thr).where("eligible")
    return hours.join(F.broadcast(thr.select("op", "method")), "op").select("episode_id", "t", "method", "start")


@query("alerts_by_episode_hour_threshold", """select s.episode_id, coalesce(min(s.t) filter (where s.eligible and s.score > (case when s.t<=24 then 1.5::double else 2.5::double end) + (s.episode_id%3)/10.0::double)::double, 'infinity'::double) as tau from o_test s group by 1""")
def alerts_by_episode_hour_threshold(spark, d):
    limit = F.when(F.col("t") <= 24, 1.5).otherwise(2.5) + (F.col("episode_id") % 3) / 10.0
    return al.first_alert_by_row(test_part(spark, d).withColumn("limit", limit), "score", "limit")


@query("alert_episode_counts", "select episode_id, method, alpha, n_ep::int as n_alert_episodes from o_out where n_ep>0")
def alert_episode_counts(spark, d):
    return fx.order_outcomes(spark, d).where("n_alert_episodes > 0").select("episode_id", "method", "alpha", "n_alert_episodes")


@query("hourly_predictions", "select episode_id, t, method, eligible from o_hit where alpha=0.10::double")
def hourly_predictions(spark, d):
    thr = fx.order_thresholds(spark, d).where("alpha = 0.10")
    hours = al.alert_hours(test_part(spark, d), thr)
    return hours.join(F.broadcast(thr.select("op", "method")), "op").select("episode_id", "t", "method", "eligible")
