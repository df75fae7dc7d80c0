"""Queries on episode files, record quality and cohorts (driver table ``events``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions.exprs import INF
from tocsin.operators import quality as qu
from tocsin.operators.split import non_event_order
from tocsin.plans import fixtures as fx
from tocsin.plans.catalog_metrics import rounded, transfer_results
from tocsin.plans.fixtures import EVENTS as P
from tocsin.plans.fixtures import ORDERS
from tocsin.plans.registry import query
from tocsin.session import scratch_path
from tocsin.sources import episode_files as ef
from tocsin.sources import results as rt
from tocsin.sources import versioned as vt

OBSERVED = ef.LONGITUDINAL
GLOB = "*.csv"


def file_root(spark: SparkSession, d: str) -> str:
    """The records as one delimited file per episode in the shared folder."""
    def build() -> str:
        path = scratch_path(spark, "episode-files")
        rows = fx.records(spark, d).withColumnRenamed("t", ef.TIME).withColumnRenamed("label", ef.LABEL)
        ef.write_episode_files(rows, path)
        return path
    return fx.shared(spark, d, "episode-file-root", build)


def file_manifest(spark, d) -> DataFrame:
    return fx.shared(spark, d, "file-manifest", lambda: ef.audit_files(spark, file_root(spark, d), GLOB))


# -- sources and sinks ---------------------------------------------------------------------

@query("list_episode_files", "select distinct site, episode_id::varchar as episode_id from e_rec")
def list_episode_files(spark, d):
    return ef.list_files(spark, file_root(spark, d), GLOB).select("site", "episode_id")


@query("read_episode_files", f"""select site, episode_id::varchar as episode_id, row_number() over (partition by episode_id order by row_no) as n, t as hour, {', '.join(OBSERVED)}, Age, Unit1, label from e_rec""")
def read_episode_files(spark, d):
    rows = ef.as_records(ef.read_episodes(spark, file_root(spark, d), GLOB))
    n = F.row_number().over(Window.partitionBy("episode_id").orderBy("row_no")).cast("long")
    return rows.select("site", "episode_id", n.alias("n"), F.col("t").alias("hour"), *OBSERVED, "Age", "Unit1", "label")


@query("audit_episode_files", """select count(distinct episode_id) as total_files, 0::bigint as empty, 0::bigint as corrupt, 0::bigint as schema_mismatch, 0::bigint as duplicate_ids,
  count(distinct episode_id) filter (where site='A') as "A_files", count(distinct episode_id) filter (where site='B') as "B_files", true as passed from e_rec""")
def audit_episode_files(spark, d):
    expected = {r["site"]: r["n"] for r in fx.records(spark, d).groupBy("site").agg(F.count_distinct("episode_id").alias("n")).collect()}
    return ef.audit_counts(file_manifest(spark, d), expected)


@query("changed_episode_files", "select distinct episode_id::varchar as episode_id, case when episode_id%10=0 then 'changed' else 'missing' end as problem from e_rec where episode_id%10=0 or episode_id%10=1")
def changed_episode_files(spark, d):
    man = file_manifest(spark, d)
    digit = F.col("episode_id").cast("long") % 10
    now = man.where(digit != 1).withColumn("size_bytes", F.col("size_bytes") + F.when(digit == 0, 1).otherwise(0))
    return ef.changed_files(man, now).select(F.regexp_extract("path", ef.ID_PATTERN, 1).alias("episode_id"), "problem")


@query("duplicate_episode_ids", "select episode_id, count(*) as n from (select distinct site, episode_id from e_rec union all select distinct case site when 'A' then 'B' else 'A' end, episode_id from e_rec where episode_id%20=0) group by 1 having count(*)>1")
def duplicate_episode_ids(spark, d):
    ids = fx.records(spark, d).select("site", "episode_id").distinct()
    other = ids.where(F.col("episode_id") % 20 == 0).withColumn("site", F.when(F.col("site") == "A", "B").otherwise("A"))
    return ef.duplicate_ids(ids.unionByName(other))


REPLICATE_SCHEMA = T.StructType([T.StructField("method", T.StringType()), T.StructField("target_m0", T.IntegerType()),
                                 T.StructField("pfa", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
                                 T.StructField("partition", T.IntegerType())])


@query("read_replicate_files", "select site, partition, method, target_m0, round(pfa,6) as pfa from k_res")
def read_replicate_files(spark, d):
    path = scratch_path(spark, "replicates")
    rows = transfer_results(spark, d).select("site", "method", "target_m0", "pfa", "threshold", "partition")
    rt.write_table(rows, path, "csv", ["site"])
    back = rt.read_replicates(spark, path, REPLICATE_SCHEMA, "*.csv.gz")
    site = F.regexp_extract(F.col("_metadata.file_path"), ef.SITE_PATTERN, 1)
    return rounded(back.select(site.alias("site"), "partition", "method", "target_m0", "pfa"))


@query("write_and_read_table", "select site, event, count(*) as n, sum(horizon)::bigint as hours from o_ep group by all")
def write_and_read_table(spark, d):
    """The table is replaced; readers follow the newest committed version."""
    path = scratch_path(spark, "episodes-table")
    vt.replace_table(fx.order_episodes(spark, d).where("event"), path)
    vt.replace_table(fx.order_episodes(spark, d), path)
    back = vt.read_table(spark, path)
    return back.groupBy("site", "event").agg(F.count("*").alias("n"), F.sum("horizon").alias("hours"))


@query("pending_replicates", "select partition, site from (select distinct partition, site from k_res) where not (partition < 2 and site='A') and not (partition < 1 and site='B')")
def pending_replicates(spark, d):
    """Units are committed with their rows, number and hash; one more was made under other settings."""
    path = scratch_path(spark, "replicate-store")
    key, keys = rt.config_key(ORDERS, 0.10), ["partition", "site"]
    rows = transfer_results(spark, d).select(*keys, "method", "target_m0", "pfa", "sens3")
    for finished in ("partition < 2 and site = 'A'", "partition < 1 and site = 'B'"):
        vt.append_units(rows.where(finished), path, keys, key)
    vt.append_units(rows.where("partition = 2 and site = 'A'"), path, keys, rt.config_key(ORDERS, 0.20))
    return vt.pending_units(rows.select(*keys).distinct(), path, keys, key).select(*keys)


@query("table_fingerprint", """with h as (select ('0x'||substr(md5(o_orderkey::varchar||'|'||o_custkey::varchar||'|'||o_orderstatus||'|'||o_orderpriority),1,12))::bigint as h from orders)
  select count(*) as n_rows, sum(h)::varchar as hash_sum, bit_xor(h) as hash_xor from h""")
def table_fingerprint(spark, d):
    return rt.fingerprint(fx.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("maxima_store", "select 'calibration_non_events' as origin, site, episode_id, row_number() over (partition by site order by md5('42|reservoir|'||episode_id), episode_id) as patient_order, max_score as fixed_maximum, round(max_z,6) as time_maximum from o_cal")
def maxima_store(spark, d):
    path = scratch_path(spark, "maxima")
    ordered = non_event_order(fx.calibration_maxima(spark, d), fx.SEED)
    rt.write_table(rt.maxima_table(ordered, "calibration_non_events"), path, partition_by=["origin"])
    back = spark.read.parquet(path)
    return back.select(F.col("origin").cast("string").alias("origin"), "site", "episode_id", "patient_order", "fixed_maximum",
                       F.round("time_maximum", 6).alias("time_maximum"))


# -- record checks --------------------------------------------------------------------------

def man(spark, d) -> DataFrame:
    return fx.record_manifest(spark, d)


@query("baseline_consistency", "select episode_id, baseline_consistent, Age, Gender, Unit1, Unit2, HospAdmTime from e_man")
def baseline_consistency(spark, d):
    return man(spark, d).select("episode_id", "baseline_consistent", "Age", "Gender", "Unit1", "Unit2", "HospAdmTime")


@query("label_checks", "select episode_id, label_valid, label_monotone from e_man")
def label_checks(spark, d):
    return man(spark, d).select("episode_id", "label_valid", "label_monotone")


@query("time_axis_checks", "select episode_id, hours_integer, strictly_increasing, duplicate_hour, has_gap, first_hour, horizon, min_hour, max_hour from e_man")
def time_axis_checks(spark, d):
    return man(spark, d).select("episode_id", "hours_integer", "strictly_increasing", "duplicate_hour", "has_gap",
                                "first_hour", "horizon", "min_hour", "max_hour")


@query("onset_reconstruction", "select episode_id, first_positive_row, first_positive_hour, onset from e_man")
def onset_reconstruction(spark, d):
    return man(spark, d).select("episode_id", "first_positive_row", "first_positive_hour", "onset")


@query("truncation_flags", "select episode_id, left_truncated, onset_within_record, onset_reconstructable from e_man")
def truncation_flags(spark, d):
    return man(spark, d).select("episode_id", "left_truncated", "onset_within_record", "onset_reconstructable")


@query("primary_cohort", 'select episode_id, site, event, "primary" from e_man')
def primary_cohort(spark, d):
    return man(spark, d).select("episode_id", "site", "event", "primary")


@query("exclusion_reasons", "select episode_id, exclusion_reason from e_man")
def exclusion_reasons(spark, d):
    return man(spark, d).select("episode_id", "exclusion_reason")


@query("recorded_evaluability", """select m.episode_id, count(*) filter (where el) as eligible_hour_count, coalesce(bool_or(el and m.event and r.t>=m.onset-6 and r.t<=m.onset-3),false) as sens3_evaluable,
  coalesce(bool_or(el and m.event and r.t>=m.onset-6 and r.t<=m.onset),false) as sens0_evaluable from e_man m join (select r.*, r.t>=6 and r.t<=least(mm.horizon,120) and r.t<mm.onset as el from e_rec r join e_man mm on mm.episode_id=r.episode_id) r on r.episode_id=m.episode_id group by 1""")
def recorded_evaluability(spark, d):
    return man(spark, d).select("episode_id", "eligible_hour_count", "sens3_evaluable", "sens0_evaluable")


@query("observation_counts", "select episode_id, n_rows, " + ", ".join(f"{v}_nobs, round(1-{v}_nobs::double/n_rows,6) as {v}_missing_fraction" for v in OBSERVED) + " from e_man")
def observation_counts(spark, d):
    cols = [c for v in OBSERVED for c in (f"{v}_nobs", f"{v}_missing_fraction")]
    return rounded(man(spark, d).select("episode_id", "n_rows", *cols))


@query("manifest_quality_gate", "select episode_id, exclusion_reason from e_man where not baseline_consistent or not label_valid or not label_monotone or not hours_integer or not strictly_increasing or duplicate_hour")
def manifest_quality_gate(spark, d):
    return qu.fatal_records(man(spark, d)).select("episode_id", "exclusion_reason")


@query("cohort_counts", 'select site, "primary", event, count(*) as n from e_man group by all')
def cohort_counts(spark, d):
    return qu.cohort_counts(man(spark, d))


@query("onset_listing", "select site, episode_id, first_positive_hour, onset, onset_within_record, left_truncated from e_man where event")
def onset_listing(spark, d):
    return qu.onset_listing(man(spark, d))


@query("stay_length", "select site, count(*) as n, max(horizon) as max_h, round(quantile_cont(horizon,0.25),6) as q1_h, round(median(horizon),6) as median_h, round(quantile_cont(horizon,0.75),6) as q3_h from e_man group by site")
def stay_length(spark, d):
    return rounded(qu.stay_length(man(spark, d)))


@query("missingness_summary", " union all ".join(f"select '{v}' as variable, round(avg(1-{v}_nobs::double/n_rows),6) as mean_missing_fraction, sum({v}_nobs)::bigint as total_observations from e_man" for v in OBSERVED))
def missingness_summary(spark, d):
    return rounded(qu.missingness(man(spark, d), OBSERVED))


@query("cohort_ids", """select episode_id, site, event from e_man where "primary" """)
def cohort_ids(spark, d):
    return qu.primary_ids(man(spark, d))


@query("exclusion_log", """select episode_id, site, exclusion_reason from e_man where not "primary" """)
def exclusion_log(spark, d):
    return qu.exclusion_log(man(spark, d))


@query("exclusion_combinations", """select exclusion_reason, count(*) as n from e_man where not "primary" group by 1""")
def exclusion_combinations(spark, d):
    return qu.exclusion_combinations(man(spark, d))


@query("cohort_flow", """select site, 'raw' as category, count(*) as value from e_man group by site
  union all select site, 'primary non-event', count(*) filter (where "primary" and not event) from e_man group by site
  union all select site, 'primary event', count(*) filter (where "primary" and event) from e_man group by site
  union all select site, 'below landmark', count(*) filter (where exclusion_reason like '%below_landmark%') from e_man group by site
  union all select site, 'left truncated', count(*) filter (where exclusion_reason like '%left_truncated%') from e_man group by site
  union all select site, 'onset unreconstructable/outside', count(*) filter (where exclusion_reason like '%onset_unreconstructable%' or exclusion_reason like '%onset_outside_record%') from e_man group by site""")
def cohort_flow(spark, d):
    return qu.cohort_flow(man(spark, d))


@query("length_histogram", """select s.site, b.bin, b.length, count(m.episode_id) as n from (select distinct site from e_man) s cross join (values (0,'<=6',-1,6),(1,'7-12',6,12),(2,'13-24',12,24),(3,'25-48',24,48),(4,'49-72',48,72),
  (5,'73-96',72,96),(6,'97-120',96,120),(7,'121-168',120,168),(8,'>168',168,1000000)) b(bin,length,lo,hi) left join e_man m on m.site=s.site and m.horizon>b.lo and m.horizon<=b.hi group by all""")
def length_histogram(spark, d):
    return qu.length_histogram(man(spark, d))


@query("duplicate_hours", "select episode_id, t as hour, count(*) as n from e_rec group by 1,2 having count(*)>1")
def duplicate_hours(spark, d):
    return qu.duplicate_keys(fx.records(spark, d), ["episode_id", "t"]).withColumnRenamed("t", "hour")


@query("cohort_coverage", """select episode_id, 'not_in_cohort' as problem from e_man where not "primary" """)
def cohort_coverage(spark, d):
    return qu.coverage_gaps(fx.records(spark, d), qu.primary_ids(man(spark, d)))


@query("post_onset_fitting_rows", "select site, count(*) filter (where fit) as fitting_rows, count(*) filter (where fit and t>=onset) as violations from e_rows group by site")
def post_onset_fitting_rows(spark, d):
    rows = fx.event_features(spark, d)
    bad = qu.post_onset_fitting_rows(rows).groupBy("site").agg(F.count("*").alias("violations"))
    return (rows.groupBy("site").agg(F.count(F.when(F.col("fit"), 1)).alias("fitting_rows")).join(bad, "site", "left")
            .withColumn("violations", F.coalesce("violations", F.lit(0))))


@query("history_gaps", """select episode_id, list_sort(list(h)) as missing_hours from (select e.episode_id, g.h::int as h from e_ep e cross join range(4,7) g(h) where e.horizon>=6 and e.onset>6
  and not exists (select 1 from e_meas m where m.episode_id=e.episode_id and m.t=g.h)) group by 1""")
def history_gaps(spark, d):
    return qu.history_gaps(fx.measurements(spark, d), fx.event_episodes(spark, d), P).withColumn("missing_hours", F.array_sort("missing_hours"))


@query("frozen_count_gate", """select s.site, s.event, (case when s.event then 25 else 50 end)::bigint as expected, count(*) as actual, count(*) = case when s.event then 25 else 50 end as passed from e_ep s group by 1,2""")
def frozen_count_gate(spark, d):
    expected = (fx.event_episodes(spark, d).select("site", "event").distinct()
                .withColumn("expected", F.when(F.col("event"), 25).otherwise(50).cast("long")))
    return qu.count_gate(fx.event_episodes(spark, d), expected)


@query("result_checks", """with r as (select *, partition = 48 as bad from k_res), m as (select * from r where method in ('direct_transfer', 'local_fixed_max', 'local_time_adaptive'))
  select *, n_failed = 0 as passed from (
    select 'probabilities_in_range' as "check", count(*) filter (where bad or not (coalesce(pfa between 0 and 1,true) and coalesce(sens3 between 0 and 1,true) and coalesce(sens0 between 0 and 1,true) and coalesce(ppv3 between 0 and 1,true))) as n_failed from r
    union all select 'burden_nonnegative', count(*) filter (where bad or alerts_per_100d < 0) from r
    union all select 'index_matches_formula', count(*) filter (where bad) from m union all select 'bound_matches_index', count(*) filter (where bad) from m
    union all select 'infinite_means_silent', count(*) filter (where bad and n_alerted > 0) from r)""")
def result_checks(spark, d):
    """All rules on the transfer results; the rows of the last partition break every one of them."""
    bad = F.col("partition") == 48
    rows = transfer_results(spark, d).withColumns({
        "pfa": F.when(bad, 1.5).otherwise(F.col("pfa")), "alerts_per_100d": F.when(bad, -1.0).otherwise(F.col("alerts_per_100d")),
        "k": F.when(bad, F.col("k") + 1).otherwise(F.col("k")), "threshold": F.when(bad, INF).otherwise(F.col("threshold"))})
    return qu.result_checks(rows, qu.standard_result_checks())


@query("expected_feature_rows", "select e.site, sum(greatest(0, least(horizon,120)-4+1))::bigint as expected_rows, max(a.n) as actual_rows, sum(greatest(0, least(horizon,120)-4+1)) = max(a.n) as matches from e_ep e join (select site, count(*) as n from e_rows group by site) a on a.site=e.site group by e.site")
def expected_feature_rows(spark, d):
    return qu.expected_feature_rows(fx.event_episodes(spark, d), fx.event_features(spark, d), P)
