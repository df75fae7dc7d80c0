"""Worked examples and properties of the threshold rules."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tocsin.functions.binomial import exact_limits, hc_index, tolerance_index
from tocsin.functions.exprs import INF, achieved_bound, marginal_index, minimum_m0
from tocsin.functions.tables import values
from tocsin.operators import calibrate as ca
from tocsin.operators import ranking as rk
from tocsin.operators.diagnostics import check_thresholds
from tocsin.operators.summarize import nonincreasing_in_alpha
from tocsin.operators.template import fit_time_templates, merge_bins
from tocsin.params import Params


def numbers(spark, n):
    return spark.range(1, n + 1).select(F.col("id").cast("double").alias("maximum"))


def marginal(spark, maxima, alphas):
    counts = rk.distinct_values(maxima, [], "maximum")
    sizes = maxima.agg(F.count("*").alias("m0"))
    out = ca.marginal_thresholds(counts, sizes, alphas, [], "maximum")
    return {r["alpha"]: (r["threshold"][0], r["k"], r["alpha_m0"]) for r in out.collect()}


def test_marginal_rank_and_threshold(spark):
    threshold, k, achieved = marginal(spark, numbers(spark, 500), [0.10])[0.10]
    assert (threshold, k) == (451.0, 451) and achieved == pytest.approx(50 / 501)


def test_small_samples_give_infinity(spark):
    assert marginal(spark, numbers(spark, 8), [0.10])[0.10][0] == INF
    assert math.isfinite(marginal(spark, numbers(spark, 9), [0.10])[0.10][0])
    assert values(spark, ["a"], [(0.10,)]).select(minimum_m0("a")).first()[0] == 9


@pytest.mark.parametrize("m0,alpha,expected", [(500, .10, 462), (100, .10, 96), (29, .10, 29), (28, .10, 29), (59, .05, 59), (58, .05, 59)])
def test_high_confidence_index(m0, alpha, expected):
    assert tolerance_index(m0, alpha, 0.05) == expected


def test_high_confidence_index_as_column(spark):
    rows = values(spark, ["m0", "alpha"], [(500, .10), (28, .10)])
    got = {r["m0"]: r["k"] for r in rows.withColumn("k", hc_index(F.col("m0"), F.col("alpha"), 0.05)).collect()}
    assert got == {500: 462, 28: 29}


def test_high_confidence_index_large_sample():
    k = tolerance_index(10**8, 0.10, 0.05)
    assert 0.9 * 10**8 < k < 0.9 * 10**8 + 10**4


def test_exact_limits():
    lower, upper, _ = exact_limits(5, 50, 0.95)
    assert (lower, upper) == (pytest.approx(.03328, abs=1e-5), pytest.approx(.21814, abs=1e-5))
    assert exact_limits(0, 20, 0.95)[:2] == (0.0, pytest.approx(.16843, abs=1e-5))
    assert exact_limits(20, 20, 0.95)[:2] == (pytest.approx(.83157, abs=1e-5), 1.0)
    assert all(math.isnan(x) for x in exact_limits(0, 0, 0.95))


def test_thresholds_fall_with_alpha(spark):
    maxima = spark.range(100).select(((F.col("id") - 50) / 25).alias("maximum"))
    got = marginal(spark, maxima, [.02, .05, .10, .15, .20])
    series = [got[a][0] for a in sorted(got)]
    assert series == sorted(series, reverse=True)
    frame = values(spark, ["g", "alpha", "threshold"], [("x", a, c[0]) for a, c in got.items()] + [("y", .1, 1.0), ("y", .2, 2.0)])
    flags = {r["g"]: r["nonincreasing"] for r in nonincreasing_in_alpha(frame, ["g"]).collect()}
    assert flags == {"x": True, "y": False}


def test_weighted_quantile_is_episode_equal(spark):
    df = values(spark, ["x", "w"], [(0., .5), (10., .125), (11., .125), (12., .125), (13., .125)])
    out = rk.weighted_quantile(df, [], "x", "w", [(.5, .5)])
    assert out.first()["quantile"] == 0.0


def test_youden_ties_and_single_class(spark):
    rows = values(spark, ["episode_id", "value", "label"], [(0, .1, 0), (1, .2, 0), (2, .8, 1), (3, .9, 1)])
    assert ca.youden_threshold(rows).first()["threshold"] == .2
    assert ca.youden_threshold(rows.where("label = 0")).first()["threshold"] == INF


def test_linear_quantile_matches_percentile(spark):
    df = spark.range(101).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 101).cast("double").alias("v"))
    probs = [(q, q) for q in (0.0, .1, .25, .9, 1.0)]
    got = {(r["g"], r["prob"]): r["quantile"] for r in rk.quantile_linear(rk.distinct_values(df, ["g"], "v"), ["g"], "v", probs).collect()}
    for g in (0, 1):
        for q in (0.0, .1, .25, .9, 1.0):
            want = df.where(F.col("g") == g).select(F.percentile("v", F.lit(q))).first()[0]
            assert got[(g, q)] == pytest.approx(want)


def skewed(spark):
    """One value holds a third of all rows; NULL keys; signs, zeros, infinities and neighbours."""
    odd = F.element_at(F.array(*[F.lit(x) for x in (INF, -INF, 0.0, -0.0, 1e-320, -2.5e-310, 1.0, 1.0 + 2**-52, 2.0**-1022, -1e308)]), (F.col("id") % 10 + 1).cast("int"))
    v = F.when(F.col("id") % 3 == 0, 1.5).when(F.col("id") % 7 == 0, odd).otherwise((F.col("id") * 7919 % 1000 - 400) / 7.0)
    return spark.range(6000).select(F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).alias("g"), v.alias("v"), "id")


def test_ordered_bits_order_all_doubles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(-2**63, 2**63 - 1, 20_000).view(np.float64)
    x = np.concatenate([x[np.isfinite(x)], [0.0, INF, -INF, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308], 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1024), 0)])
    got = [r[0] for r in spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "v double, i long").select(rk.ordered_bits(F.col("v")).alias("b"), "i").orderBy("i").collect()]
    bits = np.abs(x).view(np.int64)
    assert got == np.where(x < 0, -bits, bits).tolist()


def test_selected_ranks_equal_sorted_values(spark):
    df = skewed(spark)
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append(r["v"])
    wanted = [(g, k) for g, vs in groups.items() for k in (1, 2, 17, len(vs) // 2, len(vs) - 1, len(vs), len(vs) + 1)]
    out = rk.select_ranks(rk.distinct_values(df, ["g"], "v"), spark.createDataFrame(wanted, "g long, k long"), ["g"], "v")
    got = {(r["g"], r["k"]): r["threshold"] for r in out.collect()}
    assert len(got) == len(set(wanted))
    for (g, k), value in got.items():
        vs = sorted(groups[g])
        assert value == (vs[k - 1] if k <= len(vs) else None)


def test_weights_are_summed_exactly(spark):
    df = spark.range(3000).select((F.col("id") % 1000).cast("double").alias("x"), (F.lit(1.0) / 3).alias("w"))
    for q in (0.001, 0.25, 0.5, 0.999, 1.0):
        assert rk.weighted_quantile(df, [], "x", "w", [(q, q)]).first()["quantile"] == math.ceil(round(1000 * q, 9)) - 1


def test_ranged_sums_and_ranks_equal_windows(spark):
    """The distributed ranks and sums give the same rows as plain windows."""
    df = skewed(spark)
    w = Window.partitionBy("g").orderBy("v")
    distinct = df.groupBy("g", "v").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("g")
    sums = distinct.select("g", "v", "n", "s", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in "ns"], *[F.sum(c).over(whole).alias(f"total_{c}") for c in "ns"])
    ranks = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long"))
    order = lambda d: sorted((tuple(r) for r in d.select(*sorted(d.columns)).collect()), key=repr)
    assert order(rk.prefix_sums(df, ["g"], "v", {"n": F.lit(1).cast("long"), "s": F.col("id")})) == order(sums)
    assert order(rk.global_rank(df, ["g"], [F.col("v"), F.col("id")])) == order(ranks)


def test_hash_rank_is_dense_and_stable(spark):
    df = spark.range(3000).select(F.col("id").alias("episode_id"), (F.col("id") % 10 == 0).alias("event"))
    ranked = rk.hash_rank(df, ["event"], "episode_id", 1, "s")
    got = {(r["event"], r["rank"]) for r in ranked.collect()}
    assert got == {(True, i) for i in range(1, 301)} | {(False, i) for i in range(1, 2701)}
    again = {r["episode_id"]: r["rank"] for r in rk.hash_rank(df.repartition(7), ["event"], "episode_id", 1, "s").collect()}
    assert again == {r["episode_id"]: r["rank"] for r in ranked.collect()}


def test_primary_boundaries():
    assert Params(hmax=120).boundaries == (6, 12, 24, 48, 72, 120)
    assert Params(tmin=6, hmax=20).boundaries == (6, 12, 20)


def test_sparse_bins_merge_to_the_left():
    cuts, counts = merge_bins((6, 12, 24, 48, 72, 120), {2: 30, 4: 40, 5: 30}, 50)
    assert cuts == (6, 12, 24, 48, 120) and counts == (100, 100, 70, 70)
    cuts, counts = merge_bins((6, 12, 24), {1: 3}, 50)
    assert cuts == (6, 24) and counts == (3,)


def test_empty_template(spark):
    traj = values(spark, ["episode_id", "t", "score", "eligible"], [(1, 7, 0.0, False)])
    episodes = values(spark, ["episode_id", "horizon", "onset"], [(1, 3, INF)])
    tpl = fit_time_templates(traj, episodes, Params(tmin=6, hmax=20))[None]
    assert tpl.locations == (0.0,) and tpl.scales == (1.0,) and tpl.boundaries == (6, 20)


def test_threshold_check_finds_a_wrong_threshold(spark):
    maxima = numbers(spark, 50).select(F.lit("A").alias("site"), F.col("maximum").alias("max_score"), F.col("maximum").alias("max_z"))
    thr = values(spark, ["site", "method", "alpha", "scale", "threshold", "k", "m0"],
                 [("A", "right", .1, "score", 46.0, 46, 50), ("A", "wrong", .1, "score", 45.0, 46, 50)])
    got = {r["method"]: r["threshold_match"] for r in check_thresholds(maxima, thr).collect()}
    assert got == {"right": True, "wrong": False}


def test_exceedance_of_fresh_episodes_is_bounded(spark):
    """Mean exceedance of one further episode stays below the achieved bound, also with ties."""
    draws = spark.range(400 * 40).select((F.col("id") % 400).alias("rep"), (F.abs(F.xxhash64("id")) % 20).cast("double").alias("maximum"),
                                         F.floor(F.col("id") / 400).alias("i"))
    cal = draws.where("i < 39")
    counts = rk.distinct_values(cal, ["rep"], "maximum")
    thr = ca.marginal_thresholds(counts, rk.group_sizes(cal, ["rep"]), [.10], ["rep"], "maximum")
    fresh = draws.where("i = 39").join(thr.select("rep", F.element_at("threshold", 1).alias("c"), "alpha_m0"), "rep")
    rate, bound = fresh.agg(F.avg((F.col("maximum") > F.col("c")).cast("double")), F.max("alpha_m0")).first()
    assert rate < bound + 0.025


def test_achieved_bound(spark):
    row = values(spark, ["m0"], [(100,)]).select(marginal_index("m0", F.lit(.1)).alias("k")).withColumn("b", achieved_bound(F.lit(100), "k")).first()
    assert row["k"] == 91 and row["b"] == pytest.approx(10 / 101)
