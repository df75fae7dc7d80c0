"""Worked examples of smoothing, alerts and metrics."""

import pytest
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, clipped_logit, eligible, fitting_hour, utility_grid, window_evaluable
from tocsin.functions.tables import values
from tocsin.operators import alerts as al
from tocsin.operators import metrics as me
from tocsin.operators.trajectory import maxima, smooth
from tocsin.params import Params

P = Params(tmin=1, hmax=12, smooth_length=1)


def frame(spark, rows, horizon_onset):
    """Trajectories (score per hour; None is not eligible) and episodes."""
    data, eps = [], []
    for i, (scores, (event, onset, horizon)) in enumerate(zip(rows, horizon_onset)):
        eps.append((i, "A", event, float(onset), horizon))
        for t, s in enumerate(scores, 1):
            if s is not None:
                prev = scores[t - 2] if t > 1 else None
                data.append((i, "A", event, float(onset), horizon, t, float(s), float(s), None if prev is None else float(prev), True, True))
    schema = "episode_id int, site string, event boolean, onset double, horizon int, t int, risk double, score double, prev_score double, eligible boolean, in_grid boolean"
    traj = spark.createDataFrame(data, schema).withColumn("prev_risk", F.col("prev_score"))
    return traj, spark.createDataFrame(eps, "episode_id int, site string, event boolean, onset double, horizon int")


def threshold(spark, c, hourly=None):
    arr = F.array(*[F.lit(float(x)) for x in (hourly or [c])])
    from tocsin.session import materialize

    return materialize(values(spark, ["op", "site", "method", "alpha", "scale"], [(1, "A", "m", .1, "score")]).withColumn("threshold", arr), "t")


def run(spark, rows, eps, c, p=P, hourly=None):
    traj, episodes = frame(spark, rows, eps)
    return al.outcomes(traj, episodes, threshold(spark, c, hourly), p)


def test_smoothing_skips_missing_and_fills_gaps(spark):
    scores = values(spark, ["episode_id", "t", "risk"], [(1, t, t / 10) for t in range(1, 6)] + [(2, 1, .2), (2, 4, .6), (2, 9, .9)])
    got = {(r["episode_id"], r["t"]): r["smooth"] for r in smooth(scores, Params(tmin=1, hmax=10)).collect()}
    assert [got[(1, t)] for t in range(1, 6)] == pytest.approx([.1, .15, .2, .3, .4])
    assert got[(2, 3)] == pytest.approx(.2) and got[(2, 4)] == pytest.approx(.6) and got[(2, 6)] == pytest.approx(.6)
    assert (2, 7) not in got and (2, 11) not in got and got[(2, 10)] == pytest.approx(.9)


def test_logit_is_clipped_and_keeps_null(spark):
    rows = values(spark, ["r"], [(0.0,), (1.0,), (0.5,)]).select(clipped_logit("r").alias("u")).collect()
    assert rows[0]["u"] == pytest.approx(-13.815509557963774) and rows[1]["u"] == pytest.approx(13.8155095, abs=1e-6) and rows[2]["u"] == 0
    assert spark.sql("select cast(null as double) r").select(clipped_logit("r").alias("u")).first()["u"] is None


def test_eligibility_and_grids(spark):
    p = Params(tmin=6, hmax=168)
    rows = spark.range(1, 201).select(F.col("id").alias("t"), F.lit(200).alias("horizon"), F.lit(10.0).alias("onset"))
    assert [r["t"] for r in rows.where(eligible(p)).collect()] == [6, 7, 8, 9]
    hours = values(spark, ["t"], [(t,) for t in (6, 7, 8, 9)]).select("t", F.lit(10).alias("horizon"), F.lit(8.0).alias("onset"))
    assert [r[0] for r in hours.select(fitting_hour(p)).collect()] == [True, True, False, False]
    assert all(r[0] for r in hours.select(utility_grid(p)).collect())


def test_warning_windows(spark):
    p = Params(tmin=6, hmax=168)
    rows = values(spark, ["onset", "horizon"], [(12.0, 50), (7.0, 50), (9.0, 50), (8.0, 50)]).withColumn("event", F.lit(True))
    got = [(r["a"], r["b"]) for r in rows.select(window_evaluable(p, 0).alias("a"), window_evaluable(p, 3).alias("b")).collect()]
    assert got == [(True, True), (True, False), (True, True), (True, False)]


def test_missing_maximum_is_minus_infinity(spark):
    traj, episodes = frame(spark, [[1, 2], [None, None]], [(False, INF, 2), (False, INF, 2)])
    got = {r["episode_id"]: r["m"] for r in maxima(traj, episodes, {"m": "score"}).collect()}
    assert got == {0: 2.0, 1: -INF}


def test_nan_and_infinite_scores_are_missing(spark):
    traj, episodes = frame(spark, [[float("nan"), 2, INF]], [(False, INF, 3)])
    assert maxima(traj, episodes, {"m": "score"}).first()["m"] == 2.0


def test_strict_ties(spark):
    rows = run(spark, [[1, 1, 0], [0, 2, 3]], [(False, INF, 3), (False, INF, 3)], 1.0)
    assert {r["episode_id"]: r["tau"] for r in rows.collect()} == {0: INF, 1: 2.0}


def test_alert_episodes_need_return_and_six_hours(spark):
    row = run(spark, [[2, 2, 0, 0, 0, 0, 2, 2, 0, 2]], [(False, INF, 10)], 1.0).first()
    assert row["n_alert_episodes"] == 2 and row["tau"] == 1.0


def test_hourly_thresholds(spark):
    row = run(spark, [[2, 2, 2, 2]], [(False, INF, 4)], None, hourly=[5, 5, 1, 5] + [5] * 8).first()
    assert row["tau"] == 3.0 and row["n_alert_episodes"] == 1


def test_infinite_threshold_conventions(spark):
    rows = run(spark, [[0] * 10, [0] * 9], [(False, INF, 10), (True, 10.0, 10)], INF)
    got = me.summary(rows).first()
    assert got["pfa"] == 0 and got["sens0"] == 0 and got["sens3"] == 0 and got["ppv0"] is None and got["median_lead"] is None
    std = me.standardized_summary(rows, P).first()
    assert std["ppv0_standardized"] is None


def test_empty_sensitivity_denominator(spark):
    got = me.summary(run(spark, [[0, 0]], [(False, INF, 2)], INF)).first()
    assert got["sens0"] is None and got["sens3"] is None


def test_burden_is_a_ratio_of_mixtures(spark):
    rows = [[1 if t in (0, 7) else 0 for t in range(12)], [1, 0], [1] + [0] * 11, [0] * 6]
    out = run(spark, rows, [(False, INF, 12), (False, INF, 2), (True, 13.0, 12), (True, 13.0, 6)], 0.5)
    got = me.standardized_summary(out, P).first()
    num = .9 * got["mean_episodes_non_event"] + .1 * got["mean_episodes_event"]
    den = .9 * got["mean_exposure_days_non_event"] + .1 * got["mean_exposure_days_event"]
    assert got["mean_episodes_non_event"] == 1.5 and got["alert_burden_100d"] == pytest.approx(100 * num / den)


def test_ppv_uses_all_events(spark):
    base = values(spark, ["episode_id", "event", "onset", "tau", "eval0", "eval3", "n_alert_episodes", "exposure_days"], [
        (0, True, 10., 5., True, True, 1, 1.), (1, True, 10., INF, False, False, 0, 1.),
        (2, True, 10., 1., True, True, 1, 1.), (3, False, INF, 2., False, False, 1, 1.)])
    rows = al.classify(base, P).withColumn("method", F.lit("m")).withColumn("alpha", F.lit(.1))
    got = me.standardized_summary(rows, P).first()
    assert got["n_event_evaluable3"] == 2 and got["valid3_rate_all_events"] == pytest.approx(1 / 3)
    assert got["ppv3_standardized"] == pytest.approx(.1 / 3 / (.1 * 2 / 3 + .9))


def test_long_stay_ties_by_id(spark):
    eps = values(spark, ["episode_id", "event", "exposure_hours"], [(i, False, 10 if i < 6 else 5) for i in range(8)])
    assert sorted(r["episode_id"] for r in me.long_stay_flags(eps).collect()) == [0, 1]


def test_utility_of_perfect_and_silent_predictions(spark):
    p = Params(tmin=1, hmax=40, smooth_length=1)
    traj, episodes = frame(spark, [[1 if 8 <= t <= 23 else 0 for t in range(1, 31)], [0] * 30], [(True, 20.0, 30), (False, INF, 30)])
    rows = {r["episode_id"]: r for r in al.outcomes(traj, episodes, threshold(spark, .5), p).collect()}
    assert rows[0]["utility_observed"] == pytest.approx(rows[0]["utility_best"])
    assert rows[0]["utility_inactive"] == pytest.approx(sum(-2 * d / 9 for d in range(1, 10)))
    assert rows[1]["utility_observed"] == 0 == rows[1]["utility_best"]


def test_auroc_is_episode_equal(spark):
    rows = values(spark, ["episode_id", "value", "label"], [(0, .9, 1), (1, .1, 0), (1, .95, 0), (2, .5, 0), (2, .5, 1)])
    got = me.threshold_free(rows).first()
    # pairs weighted by 1/rows of the episode: positives (.9, w1) and (.5, w.5)
    pos, neg = [(.9, 1), (.5, .5)], [(.1, .5), (.95, .5), (.5, .5)]
    want = sum(a * b * (1 if x > y else .5 if x == y else 0) for x, a in pos for y, b in neg) / (1.5 * 1.5)
    assert got["auroc"] == pytest.approx(want)
