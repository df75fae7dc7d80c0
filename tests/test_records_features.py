"""Record checks, files, splits, features and resampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF
from tocsin.functions.tables import values
from tocsin.operators import features as fe
from tocsin.operators import model as ml
from tocsin.operators import multinomial as mn
from tocsin.operators import quality as qu
from tocsin.operators import ranking as rk
from tocsin.operators import resample as rs
from tocsin.operators import split as sp
from tocsin.operators import subgroups as sg
from tocsin.operators import summarize as su
from tocsin.operators import transfer as tr
from tocsin.params import Params
from tocsin.sources import episode_files as ef
from tocsin.sources import results as rt

P = Params(tmin=6, hmax=168)


def records(spark, episodes):
    rows = [("A", name, i, float(t), float(y), 60.0, 80.0 + i) for name, (hours, labels) in episodes.items()
            for i, (t, y) in enumerate(zip(hours, labels))]
    return values(spark, ["site", "episode_id", "row_no", "t", "label", "Age", "HR"], rows)


CASES = {
    "late": ([1, 2, 5, 6], [0, 0, 1, 1]), "truncated": ([5, 6], [1, 1]), "outside": ([5, 6], [0, 1]),
    "short": ([1, 2], [0, 0]), "fall": ([1, 2, 3, 4, 5, 6, 7], [0, 1, 0, 0, 0, 0, 0]),
    "swap": ([1, 3, 2, 7], [0, 0, 0, 0]), "twice": ([1, 2, 2, 7], [0, 0, 0, 0]),
    "clean": (list(range(1, 21)), [0] * 5 + [1] * 15),
}


@pytest.mark.parametrize("chunk", [4096, 2])
def test_manifest_cases(spark, chunk, monkeypatch):
    monkeypatch.setattr(qu.order_checks, "__defaults__", (chunk,))
    got = {r["episode_id"]: r for r in qu.manifest(records(spark, CASES), P, ["HR"], ["Age"]).collect()}
    assert got["late"]["onset"] == 11 and got["late"]["first_positive_row"] == 2 and got["late"]["has_gap"]
    assert got["truncated"]["left_truncated"] and not got["truncated"]["primary"]
    assert not got["outside"]["onset_within_record"] and got["outside"]["exclusion_reason"] == "onset_outside_record"
    assert got["short"]["exclusion_reason"] == "below_landmark" and got["short"]["onset"] == INF
    assert not got["fall"]["label_monotone"]
    assert not got["swap"]["strictly_increasing"] and not got["swap"]["duplicate_hour"]
    assert got["twice"]["duplicate_hour"] and not got["twice"]["strictly_increasing"]
    clean = got["clean"]
    assert clean["primary"] and clean["onset"] == 12 and clean["eligible_hour_count"] == 6
    assert clean["sens3_evaluable"] and clean["sens0_evaluable"] and clean["HR_nobs"] == 20 and clean["exclusion_reason"] == ""
    with pytest.raises(ValueError):
        qu.require_clean(qu.manifest(records(spark, CASES), P, ["HR"], ["Age"]))


def test_files_round_trip_and_audit(spark, tmp_path):
    root = tmp_path / "raw"
    header = "|".join(ef.FILE_COLUMNS)
    line = lambda t, y: "|".join(["80", "NaN", "", " "] + ["nan"] * 30 + ["60", "1", "NaN", "NaN", "-2", str(t), str(y)])
    for site, name, text in (
        ("A", "p1", "\n".join([header, line(1, 0), line(2, 1)]) + "\n"), ("B", "p2", header + "\n" + line(1, 0) + "\n"),
        ("B", "p1", header + "\n" + line(3, 0) + "\n"), ("A", "empty", ""), ("B", "odd", "a|b\n1|2\n")):
        (root / site).mkdir(parents=True, exist_ok=True)
        (root / site / f"{name}.psv").write_text(text)
    roots = {"A": str(root / "A"), "B": str(root / "B")}
    man = ef.audit_files(spark, roots).cache()
    counts = ef.audit_counts(man, {"A": 2, "B": 3}).first()
    assert (counts["total_files"], counts["empty"], counts["schema_mismatch"], counts["duplicate_ids"]) == (5, 1, 2, 1)
    assert not counts["passed"]
    assert [r["episode_id"] for r in ef.duplicate_ids(man).collect()] == ["p1"]
    assert [(r["site"], r["episode_id"]) for r in ef.list_files(spark, roots).collect()][:2] == [("A", "empty"), ("A", "p1")]
    (root / "A" / "empty.psv").unlink()
    (root / "B" / "odd.psv").unlink()
    rows = ef.read_episodes(spark, roots).orderBy("site", "episode_id", "row_no").collect()
    assert len(rows) == 4 and rows[0]["HR"] == 80.0 and rows[0]["O2Sat"] is None and rows[0]["Temp"] is None and rows[0]["SBP"] is None
    assert [r[ef.TIME] for r in rows] == [1.0, 2.0, 3.0, 1.0]
    (root / "B" / "p2.psv").write_text(header + "\n" + line(1, 1) + "\n")
    changed = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in ef.changed_files(man, ef.audit_files(spark, roots)).collect()}
    assert changed == {"empty.psv": "missing", "odd.psv": "missing", "p2.psv": "changed"}


def test_wrong_header_fails(spark, tmp_path):
    (tmp_path / "x.psv").write_text("a|b\n1|2\n")
    with pytest.raises(Exception):
        ef.read_episodes(spark, {"A": str(tmp_path)}).collect()


def test_resume_and_fingerprint(spark, tmp_path):
    units = values(spark, ["rep", "site"], [(0, "A"), (1, "A"), (2, "B")])
    key, path = rt.config_key(P, 0.1), str(tmp_path / "store")
    rt.append_units(units.where("rep = 1").withColumn("config_key", key), path, ["rep"])
    left = rt.pending_units(units, spark.read.parquet(path), ["rep", "site"], key)
    assert sorted(r["rep"] for r in left.collect()) == [0, 2]
    assert rt.pending_units(units, spark.read.parquet(path), ["rep", "site"], rt.config_key(P, 0.2)).count() == 3
    assert rt.fingerprint(units).first() == rt.fingerprint(units.repartition(3).orderBy(F.desc("rep"))).first()
    assert rt.fingerprint(units).first() != rt.fingerprint(units.withColumn("rep", F.col("rep") + 1)).first()


def test_replicate_files_keep_infinity(spark, tmp_path):
    df = values(spark, ["method", "threshold"], [("a", INF), ("b", -INF), ("c", 1.5)])
    rt.write_table(df, str(tmp_path / "r"), "csv")
    back = rt.read_replicates(spark, str(tmp_path / "r"), df.schema, "*.csv.gz")
    assert {r["method"]: r["threshold"] for r in back.collect()} == {"a": math.inf, "b": -math.inf, "c": 1.5}


def cohort(spark, n=40):
    return values(spark, ["episode_id", "site", "event"], [(f"{s}{e}{i}", s, bool(e)) for s in "AB" for e in (0, 1) for i in range(n)])


def test_split_is_complete_disjoint_and_reproducible(spark):
    episodes, shares = cohort(spark), {"train": .5, "validation": .15, "calibration": .15, "test": .2}
    split = sp.stratified_split(episodes, shares, 7).cache()
    assert all(r["violations"] == 0 for r in sp.validate_split(split, episodes, list(shares)).collect())
    assert {(r["split"], r["n"]) for r in sp.split_counts(split).collect()} == {("train", 20), ("validation", 6), ("calibration", 6), ("test", 8)}
    again = sp.stratified_split(episodes.repartition(5), shares, 7)
    assert split.select("episode_id", "split").exceptAll(again.select("episode_id", "split")).count() == 0
    bad = split.unionByName(split.limit(1))
    assert {r["check"]: r["violations"] for r in sp.validate_split(bad, episodes, list(shares)).collect()}["episode_overlap"] == 1


def test_prefixes_are_nested_non_events(spark):
    pool = values(spark, ["episode_id", "site", "event"], [(f"p{i}", "A", False) for i in range(1200)] + [(f"e{i}", "A", True) for i in range(10)])
    ordered = sp.non_event_order(pool, 8)
    rows = sp.nested_prefixes(ordered, [100, 250, 500, 1000]).collect()
    sets = {m: {r["episode_id"] for r in rows if r["target_m0"] == m} for m in (100, 250, 500, 1000)}
    assert all(len(s) == m for m, s in sets.items()) and sets[100] < sets[250] < sets[500] < sets[1000]
    assert not any(x.startswith("e") for x in sets[1000])
    assert [r["target_m0"] for r in sp.prefix_shortfalls(ordered, [100, 2000]).collect()] == [2000]


def measured(spark, hr):
    return values(spark, ["episode_id", "site", "t"], [(1, "A", t) for t in range(1, len(hr) + 1)]).join(
        spark.createDataFrame([(t, v) for t, v in enumerate(hr, 1)], "t int, HR double"), "t")


EPISODE = ["episode_id", "site", "event", "onset", "horizon"]


def feature_map(spark, hr, horizon=12):
    eps = values(spark, EPISODE, [(1, "A", False, INF, horizon)])
    return {r["t"]: r.asDict() for r in fe.window_features(fe.hour_grid(measured(spark, hr), eps, P), ["HR"]).collect()}


def test_window_edge_and_causality(spark):
    hr = [1., 2., None, 4., 5., 6., 7., 8., 9., 10., 11., 12.]
    a = feature_map(spark, hr)
    assert a[7]["HR_mean_6h"] == pytest.approx((2 + 4 + 5 + 6 + 7) / 5) and a[7]["HR_count_6h"] == 5
    assert a[3]["HR_last"] == 2 and a[3]["HR_since"] == 1 and a[3]["HR_current"] == 0 and a[1]["HR_sd_6h"] is None
    assert a[12]["HR_slope_6h"] == pytest.approx(1.0) and a[12]["HR_change_6h"] == 5
    b = feature_map(spark, hr[:8] + [999.] * 4)
    assert all(a[t] == b[t] for t in range(1, 9)) and a[9] != b[9]


def test_grid_covers_gaps_and_empty_episodes(spark):
    eps = values(spark, EPISODE, [(1, "A", False, INF, 5), (2, "B", False, INF, 3)])
    m = values(spark, ["episode_id", "site", "t", "HR"], [(1, "A", 3, 7.0), (1, "A", 9, 8.0)])
    got = {(r["episode_id"], r["t"]): r["HR"] for r in fe.hour_grid(m, eps, P).collect()}
    assert got == {(1, 1): None, (1, 2): None, (1, 3): 7.0, (1, 4): None, (1, 5): None, (2, 1): None, (2, 2): None, (2, 3): None}


def test_as_of_rows_equal_windows(spark):
    hr = [None, 3., None, 4., 9., None, 1., 8., None, None, 2., 6.]
    a = feature_map(spark, hr)
    for r in fe.features_as_of(measured(spark, hr), values(spark, ["episode_id", "q"], [(1, q) for q in (1, 6, 10, 12)]), ["HR"]).collect():
        for name in fe.feature_names(["HR"], site=None)[1:]:
            want = a[r["t"]][name]
            assert (r[name] is None) == (want is None) and (want is None or r[name] == pytest.approx(want)), (r["t"], name)


def test_medians_come_from_training_rows(spark):
    rows = spark.createDataFrame([(1., None), (3., 2.)], "x_last double, z_mean_6h double")
    med = fe.read_medians(fe.fit_medians(rows, ["x_last", "z_mean_6h"]))
    assert med == {"x_last": 2.0, "z_mean_6h": 2.0}
    out = fe.apply_medians(spark.createDataFrame([(999., None)], "x_last double, z_mean_6h double"), med)
    assert out.first().asDict() == {"x_last": 999., "z_mean_6h": 2., "x_last__missing": 0., "z_mean_6h__missing": 1.}
    assert all(r["n_missing"] == 0 for r in fe.missing_counts(out, out.columns).collect())


def test_row_weights(spark):
    rows = values(spark, ["episode_id", "label"], [(0, 0), (0, 1), (1, 1), (1, 0), (1, 0)])
    assert ml.positive_fraction(rows).first()["pi_y"] == pytest.approx((.5 + 1 / 3) / 2)
    assert ml.training_weights(rows).agg(F.avg("weight")).first()[0] == pytest.approx(1)
    sums = {r["episode_id"]: r["s"] for r in ml.validation_weights(rows).groupBy("episode_id").agg(F.sum("weight").alias("s")).collect()}
    assert sums[0] == pytest.approx(sums[1])


def test_grid_selection_order(spark):
    grid = values(spark, ["grid_no", "best_score", "max_depth", "eta", "min_child", "trees_used"],
                  [(0, .5, 3, .05, 1, 9), (1, .5, 2, .1, 1, 9), (2, .5, 2, .05, 1, 9), (3, .5, 2, .05, 5, 9), (4, .4, 1, .01, 9, 1)])
    assert ml.select_setting(grid).first()["grid_no"] == 3


def test_bootstrap_draws_whole_episodes_per_stratum(spark):
    episodes = cohort(spark, 15)
    rows = rs.resampled(episodes, ["site", "event"], 8, 3).cache()
    sizes = rows.groupBy("bootstrap", "stratum").agg(F.sum("multiplicity").alias("n")).collect()
    assert len(sizes) == 32 and all(r["n"] == 15 for r in sizes)
    assert rows.where("multiplicity > 1").count() > 0


def test_binomial_inversion_has_the_binomial_law():
    rng = np.random.default_rng(1)
    for trials, share in ((1, .5), (7, .3), (12, .95), (40, .01)):
        got = np.bincount(mn.binomial(np.full(40_000, trials), share, rng.random(40_000)), minlength=trials + 1)
        want = np.array([math.comb(trials, k) * share**k * (1 - share)**(trials - k) for k in range(trials + 1)]) * 40_000
        seen = want > 5
        assert (((got - want) ** 2 / want)[seen]).sum() < 2 * seen.sum() + 20 and got.sum() == 40_000
    exact = mn.binomial(np.full(2_000, 10**8), 0.5, rng.random(2_000))
    assert abs(exact.mean() - 5e7) < 600 and 4_500 < exact.std() < 5_500
    assert mn.binomial(np.array([0, 0]), .4, np.array([0., .999])).tolist() == [0, 0]


def test_split_draws_have_the_multinomial_law():
    size, slots, replicates = 11, 2, 30_000
    split = mn.Splitter("s", size, replicates, 5, slots)
    times = np.concatenate([split.multiplicities(b) for b in range(6)], axis=1)
    assert times.shape == (replicates, size) and (times.sum(axis=1) == size).all()
    # of a multinomial with equal shares: mean 1, variance 1 - 1/n, covariance -1/n
    want = np.full((size, size), -1 / size)
    np.fill_diagonal(want, 1 - 1 / size)
    assert np.abs(times.mean(axis=0) - 1).max() < .03
    assert np.abs(np.cov(times.T) - want).max() < .04
    assert np.abs(np.bincount(times[:, 3], minlength=4)[:4] / replicates - [math.comb(11, k) * (1 / 11)**k * (10 / 11)**(11 - k) for k in range(4)]).max() < .01
    again = mn.Splitter("s", size, replicates, 5, slots)
    assert (again.multiplicities(4) == times[:, 8:10]).all()  # a bucket alone, without its neighbours


def test_replicate_sums_equal_drawn_rows(spark):
    episodes = cohort(spark, 37).withColumn("features", F.expr("array(named_struct('f', 0L, 'x', 1D), named_struct('f', hash(episode_id) % 3 + 3L, 'x', 0.5D))"))
    drawn = rs.resampled(episodes, ["site", "event"], 9, 3, slots=8).select("stratum", "bootstrap", "multiplicity", F.inline("features"))
    want = {tuple(r)[:3]: r["x"] for r in drawn.groupBy("stratum", F.col("f").alias("feature"), "bootstrap").agg(F.sum(F.col("x") * F.col("multiplicity")).alias("x")).collect()}
    got = {tuple(r)[:3]: r["x"] for r in rs.replicate_sums(episodes.repartition(7), ["site", "event"], 9, 3, slots=8).where("x <> 0").collect()}
    assert got == pytest.approx(want) and len(got) > 50
    plan = rs.resampled(episodes, ["site", "event"], 9, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")  # drawn rows are not exchanged


def test_subgroups_and_summaries(spark):
    rows = values(spark, ["episode_id", "site", "event", "alerted", "eval3", "valid3", "exposure_days"],
                  [(i, "A", i == 9, i % 2 == 0, i == 9, i == 9, float(i + 1)) for i in range(10)])
    base = spark.createDataFrame([(i, 45.0 + 10 * i if i else None, 1, 1, 1 if i % 2 else None) for i in range(10)],
                                 "episode_id int, age double, gender int, unit1 int, unit2 int")
    got = {(r["subgroup_variable"], r["subgroup"]): r for r in sg.subgroup_summary(sg.with_subgroups(rows, base)).collect()}
    assert got[("age_group", "missing")]["n_patients"] == 1 and got[("age_group", "50-64")]["n_patients"] == 1
    assert got[("unit_type", "both")]["n_patients"] == 5 and got[("exposure_quartile", "missing")]["n_events"] == 1
    assert got[("exposure_quartile", "Q1 shortest")]["n_patients"] == 3


def test_replicate_summary_excludes_aliases(spark):
    frame = spark.createDataFrame([("S", "direct", 0, .10, 1.0, False), ("S", "direct", 1, .12, 3.0, False), ("S", "copy", 0, .9, 1.0, True)],
                                  "scenario string, method string, replicate int, pfa double, threshold double, is_alias boolean")
    got = su.aggregate_results(frame, ["scenario", "method"], ["pfa"]).collect()
    assert [(r["method"], r["n_total"]) for r in got] == [("direct", 2)] and got[0]["mean"] == pytest.approx(.11)
    t = su.threshold_summary(frame, ["scenario", "method"]).first()
    assert t["threshold_mean"] == 2 and t["threshold_sd"] == pytest.approx(math.sqrt(2))
    with pytest.raises(ValueError):
        su.require_unique(frame, ["scenario", "replicate"])


def test_partition_spread_keeps_undefined(spark):
    frame = spark.createDataFrame([("x", 1.0, None), ("x", 3.0, None)], "g string, pfa double, sens3 double")
    got = {r["metric"]: r for r in tr.descriptive_summary(frame, ["g"], ["pfa", "sens3"]).collect()}
    assert got["pfa"]["median"] == 2 and got["sens3"]["n_defined"] == 0 and got["sens3"]["median"] is None


def test_audit_reports_undecodable_files(spark, tmp_path):
    from tocsin.sources import episode_files as ef

    (tmp_path / "a.psv").write_bytes(b"\xff\xfeHR|O2Sat\n1|2\n")
    (tmp_path / "b.psv").write_text("HR|O2Sat\n1|2\n")
    (tmp_path / "c.psv").write_text("")
    rows = {r["episode_id"]: r for r in ef.audit_files(spark, {"A": str(tmp_path)}, columns=["HR", "O2Sat"]).collect()}
    assert {k: (r["corrupt"], r["schema_ok"], r["read_error"]) for k, r in rows.items()} == {
        "a": (True, False, "undecodable"), "b": (False, True, ""), "c": (True, False, "empty")}


def test_append_keeps_units_of_earlier_appends(spark, tmp_path):
    from tocsin.sources import results as rt

    path = str(tmp_path / "units")
    for site in ("A", "B"):
        rt.append_units(spark.createDataFrame([(0, site, 1.0)], "partition int, site string, x double"), path, ["partition", "site"])
    assert {r["site"] for r in spark.read.parquet(path).collect()} == {"A", "B"}


def test_feature_names_and_indicators():
    names = fe.feature_names(["HR", "pH"], ["Age"])
    assert names[:3] == ["Age", "hour", "site_b"] and len(names) == 3 + 2 * 25 == len(set(names))
    flagged = fe.indicator_features(names)
    assert len(flagged) == 2 * (2 + 6 * 3) and not {"HR_never", "HR_current", "HR_count_6h", "Age", "hour"} & set(flagged)
    assert {"HR_last", "pH_since", "pH_slope_24h"} <= set(flagged)
    assert fe.statistic_of("x_last_6h") is None and fe.statistic_of("last") is None and fe.statistic_of("my_max_value_mean_12h").name == "mean"


def test_as_of_rows_equal_window_rows_across_long_gaps(spark):
    hours = {1: [1, 2, 3, 40, 41, 90, 91, 92, 120], 2: [5], 3: [], 4: list(range(1, 60, 7))}
    rows = [(e, t, float((7 * t + e) % 11) if (t + e) % 3 else None, float(t % 5) if t % 2 else None) for e, ts in hours.items() for t in ts]
    meas = spark.createDataFrame(rows, "episode_id int, t int, a double, b double")
    episodes = spark.createDataFrame([(e, "A", False, INF, 130) for e in hours], "episode_id int, site string, event boolean, onset double, horizon int")
    window = fe.window_features(fe.hour_grid(meas, episodes, P), ["a", "b"])
    names = [n for v in ("a", "b") for n in fe.variable_features(v)]
    asked = episodes.select("episode_id", F.explode(F.sequence(F.lit(1), F.lit(130))).alias("q"))
    of = lambda df: {(r["episode_id"], r["t"]): [r[n] for n in names] for r in df.collect()}
    got, want = of(fe.features_as_of(meas, asked, ["a", "b"])), of(window)
    assert got.keys() == want.keys() and len(got) == 520
    assert all(x == pytest.approx(y) for k in got for x, y in zip(got[k], want[k]))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("- Window [") == 2  # one of the hour grid, one for all features


def test_reservoirs_that_are_too_small_are_named(spark):
    split = cohort(spark, 12).withColumn("partition", F.lit(0)).withColumn("split", F.lit("reservoir"))
    short = {(r["site"], r["target_m0"], r["method"]): r["m0"] for r in tr.shortfalls(split, [5, 12, 13, 40]).collect()}
    assert short == {(s, m, x): 12 for s in ("A", "B") for m in (13, 40) for x in tr.LOCAL_METHODS}
    assert {r["target_m0"] for r in tr.reservoir_prefixes(split, [5, 12, 13, 40], 1).select("target_m0").distinct().collect()} == {5, 12}


def test_as_of_joins_send_no_table_through_the_driver(spark):
    meas = values(spark, ["episode_id", "t", "a"], [(e, t, float(t)) for e in (1, 2) for t in (3, 9, 40)])
    asked = values(spark, ["episode_id", "horizon"], [(1, 60), (2, 50)]).select("episode_id", F.explode(F.sequence(F.lit(1), "horizon")).alias("q"))
    rows = fe.features_as_of(meas, asked, ["a"])
    assert rows.count() == 110
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_parts_end_where_ranks_say(spark):
    rows = cohort(spark, 40).withColumn("site", F.when(F.col("site") == "B", F.col("site")))  # one site is NULL
    ranked = rk.hash_rank(rows, ["site", "event"], "episode_id", 7, "s", "r", "n")
    shares = {"a": 0.0, "b": 0.55, "c": 0.45}
    sizes = sp.rounded_counts(rows.groupBy("site", "event").agg(F.count("*").alias("n")), shares, ["site", "event"])
    want = {(r["site"], r["event"], r["part"]): r["upto"] for r in sizes.where("part_size > 0").collect()}
    split = {r["episode_id"]: r["split"] for r in sp.stratified_split(rows, shares, 7, "s").collect()}
    assert len(split) == rows.count()
    for r in ranked.collect():
        assert split[r["episode_id"]] == ("b" if r["r"] <= want[r["site"], r["event"], "b"] else "c")
    first = {r["episode_id"]: r["r"] for r in rk.hash_rank(rows, ["site", "event"], "episode_id", 7, "s", "r", "n", first=5).collect()}
    assert first == {r["episode_id"]: r["r"] for r in ranked.where("r <= 5").collect()}


def test_split_windows_hold_no_stratum(spark):
    plan = sp.stratified_split(cohort(spark, 40), {"a": 0.5, "b": 0.5}, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_target_summary_equals_summary_of_outcomes(spark):
    from tocsin.operators import metrics as me
    from tocsin.operators.trajectory import trajectories

    p = Params(tmin=2, hmax=30, smooth_length=1)
    ids = [(f"{s}{i}", s, i % 3 == 0, float(10 + i % 9) if i % 3 == 0 else INF, 20 + i % 12) for s in "AB" for i in range(24)]
    episodes = values(spark, ["episode_id", "site", "event", "onset", "horizon"], ids)
    scores = values(spark, ["episode_id", "t", "risk"], [(n, t, ((7 * t * t + 13 * int(n[1:]) + ord(n[0])) % 97) / 100 + 0.01) for n, *_ in ids for t in range(1, 21, 1 + int(n[1:]) % 3)])
    split = tr.repeated_splits(episodes, (0, 1, 2), tr.TARGET_SHARES, 5, "target")
    traj = trajectories(scores, episodes, p)
    thr = values(spark, ["op", "site", "partition", "target_m0", "method", "alpha", "scale", "threshold", "m0", "k", "alpha_m0"], [
        (100 * n + 10 * j + (s == "B") + 1, s, n, j, "m", 0.1, kind, c, 9, 9, 0.1) for n in range(3) for s in "AB"
        for j, (kind, c) in enumerate([("score", 0.5), ("risk", 0.6), ("risk", INF), ("score", -9.0)])]).withColumn("threshold", F.array("threshold"))
    keys = ["site", "partition", "target_m0", "method", "alpha"]
    want = {tuple(r[k] for k in keys): r for r in me.summary(tr.target_outcomes(traj, split, thr, p), keys).collect()}
    got = {tuple(r[k] for k in keys): r for r in tr.target_summary(traj, split, thr, p).collect()}
    assert got.keys() == want.keys() and len(got) == 24 and sum(r["n_valid3"] for r in want.values()) > 0
    for at, r in want.items():
        for name, x in r.asDict().items():
            assert got[at][name] == (x if not isinstance(x, float) else pytest.approx(x)), (at, name)
    curve = {(r["site"], r["partition"], r["target_m0"], r["hour"]): (r["estimate"], r["denominator"]) for r in tr.target_curves(traj, split, thr, p, 30).collect()}
    plain = me.cumulative_false_alerts(tr.target_outcomes(traj, split, thr, p), 30, ["site", "partition", "target_m0"]).collect()
    assert curve == {(r["site"], r["partition"], r["target_m0"], r["hour"]): (r["estimate"], r["denominator"]) for r in plain}


def test_scaled_rounding_equals_duckdb_on_halves(spark):
    import duckdb

    from tocsin.functions.exprs import round_scaled

    xs = [s * (i + 0.5) / 10**4 for i in range(0, 40000, 7) for s in (1, -1)] + [INF, -INF, 0.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in rows.select(round_scaled(F.col("x"), 4)).collect()]
    want = [duckdb.execute("select round(?::double, 4)", [x]).fetchone()[0] for x in xs]
    assert got == want and got != [r[0] for r in rows.select(F.round("x", 4)).collect()]


def test_attribute_rows_are_those_of_the_feature_table(spark):
    from tocsin.plans.fixtures import EVENTS

    episodes = spark.createDataFrame([(i, "AB"[i % 2], False, INF, h, 40.0 + i) for i, h in enumerate([0, 1, 3, 4, 50, 130])],
                                     "episode_id long, site string, event boolean, onset double, horizon int, age double")
    measured = spark.createDataFrame([(i, "AB"[i % 2], t, float(t)) for i in range(6) for t in range(1, 140, 9)], "episode_id long, site string, t int, v_x double")
    columns = ["episode_id", "t", "age", "hour", "site_b"]
    want = fe.feature_rows(measured, episodes, EVENTS, ["v_x"], ("age",)).select(*columns)
    got = fe.attribute_rows(episodes, EVENTS).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes
    assert "Window" not in got._jdf.queryExecution().toString()


def test_episode_files_are_whole_and_need_no_folder_or_move_each(spark, tmp_path):
    """One file per episode, the same bytes as Spark's own writer gives; folders do not grow with the episodes."""
    columns, n = ["HR", "Age"], 3 * ef.FOLDERS
    rows = [("AB"[i % 2], f"p.{i}" if i else "a=b c", r, None if i % 3 else i / 7, float(r)) for i in range(n) for r in range(1 + i % 4)]
    recs = values(spark, ["site", "episode_id", "row_no", *columns], rows).withColumn("HR", F.col("HR").cast("double"))
    root = tmp_path / "files"
    ef.write_episode_files(recs.orderBy(F.rand(3)), str(root), columns)
    files = [p for p in root.rglob("*") if p.is_file()]
    assert len(files) == n and {p.suffix for p in files} == {".csv"}
    assert len([p for p in root.rglob("*") if p.is_dir()]) <= 2 + 2 * ef.FOLDERS < n
    recs.orderBy("row_no").coalesce(1).drop("row_no").write.partitionBy("site", "episode_id").csv(str(tmp_path / "spark"), sep="|", header=True, nullValue="NaN")
    as_spark = {(p.parent.parent.name, p.parent.name): p.read_bytes() for p in (tmp_path / "spark").rglob("part-*.csv")}
    assert {(p.parent.parent.name, p.name[:-4]): p.read_bytes() for p in files} == as_spark
    listed = {(r["site"], r["episode_id"]) for r in ef.list_files(spark, str(root), "*.csv").collect()}
    assert listed == {(s, e.replace("=", "%3D")) for s, e, *_ in rows}
    with pytest.raises(FileExistsError):
        ef.write_episode_files(recs, str(root), columns)


def test_manifest_with_and_without_empty_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"e{i}.psv").write_text("HR\n1\n")
    full = {r["episode_id"]: r["size_bytes"] for r in ef.audit_files(spark, {"A": str(tmp_path)}, columns=["HR"]).collect()}
    (tmp_path / "none.psv").write_text("")
    (tmp_path / "ignored.txt").write_text("x")
    rows = ef.audit_files(spark, {"A": str(tmp_path)}, columns=["HR"]).collect()
    assert full == {f"e{i}": 5 for i in range(5)}
    assert {r["episode_id"]: r["size_bytes"] for r in rows} == {**full, "none": 0}
    assert {r["sha256"] for r in rows if r["empty"]} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}


def test_feature_runs_are_the_feature_table(spark):
    """Every value of every hour, and no more runs when an episode lasts longer."""
    from tocsin.plans.fixtures import EVENTS
    episodes = spark.createDataFrame([(i, "AB"[i % 2], False, INF, h, 40.0 + i if i else None) for i, h in enumerate((119, 130, 60, 4, 3, 30))],
                                     "episode_id long, site string, event boolean, onset double, horizon int, age double")
    rows = [(i, t, float((t * 37 + i) % 11) / 7 if (t + i) % 4 else None, float("nan") if t % 5 else t / 3) for i in range(5) for t in range(-1, 140, 1 + 5 * i)]
    measured = spark.createDataFrame(rows, "episode_id long, t int, v_x double, v_y double").withColumn("site", F.lit("A"))
    names = fe.feature_names(["v_x", "v_y"], ["age"])
    table = fe.feature_rows(measured, episodes, EVENTS, ["v_x", "v_y"], ["age"])
    want = {(r["episode_id"], r["t"], n): r[n] for r in table.collect() for n in names if r[n] is not None}
    runs = fe.feature_runs(fe.observations(measured, ["v_x", "v_y"]), episodes, EVENTS, ["v_x", "v_y"], ["age"])
    made = [((r["episode_id"], t, names[r["position"]]), r["value"] + r["step"] * (t - r["start"])) for r in runs.collect() for t in range(r["start"], r["stop"] + 1)]
    assert len(made) == len(want) and dict(made) == pytest.approx(want) and len(want) > 10_000

    one = measured.where("episode_id = 0 and t = 9")
    counts = {fe.feature_runs(fe.observations(one, ["v_x"]), episodes.where("episode_id = 0").withColumn("horizon", F.lit(h)), EVENTS, ["v_x"]).count() for h in (50, 110)}
    assert len(counts) == 1 and counts.pop() < 40
    assert "BroadcastExchange" not in runs._jdf.queryExecution().executedPlan().toString()


def test_draws_of_many_buckets_equal_sql_with_enough_halvings(spark, monkeypatch):
    """Seven halvings, as in the registered SQL, end at 128 buckets; beyond, it leaves out the last of two in a node."""
    import duckdb

    from tocsin.plans import oracle
    n, replicates = 9_000, 10
    monkeypatch.setattr(oracle, "CTES", {"many": f"select range as episode_id, 'A' as site, false as event from range({n})"})
    monkeypatch.setattr(oracle, "REPLICATES", replicates)
    drawn = {}
    for levels in (7, 8):
        oracle.draw_ctes(f"d{levels}", "many", "site||'|'||event::varchar", levels)
        drawn[levels] = duckdb.sql(oracle.with_ctes(f"select stratum, position, bootstrap, multiplicity from d{levels}_mult")).fetchall()
    episodes = spark.range(n).select(F.col("id").alias("episode_id"), F.lit("A").alias("site"), F.lit(False).alias("event"))
    got = rs.multiplicities(rs.indexed_episodes(episodes, ["site", "event"], 42), replicates, 42, oracle.BOOT_SLOTS)
    assert sorted(map(tuple, got.collect())) == sorted(drawn[8])
    positions = {levels: {r[1] for r in rows} for levels, rows in drawn.items()}
    assert len(positions[8]) > n - 20 and len(positions[7]) <= 128 * oracle.BOOT_SLOTS


def test_full_feature_table_lists_features_without_a_value(spark, tmp_path):
    from tocsin.plans.catalog_features import WIDE_NAMES, full_feature_table
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    rows = full_feature_table(spark, str(tmp_path)).collect()
    assert sorted(r["feature"] for r in rows) == sorted(WIDE_NAMES) and {(r["n"], r["total"], r["minimum"], r["maximum"]) for r in rows} == {(0, None, None, None)}
