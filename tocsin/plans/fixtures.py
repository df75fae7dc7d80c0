"""Driver tables as episode tables.

Two derivations: ``events`` become irregular measurements (users, 6-hour steps), and
``orders`` become score trajectories (customers, months). Derived tables that many
queries share are written once per session and table folder; ``reset`` forgets them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF
from tocsin.operators import alerts as al
from tocsin.operators.calibrate import calibrate, youden_threshold
from tocsin.operators.split import stratified_split
from tocsin.operators.template import TimeTemplate, add_standardized, fit_time_templates
from tocsin.operators.trajectory import flat_eligible, maxima, trajectories
from tocsin.params import Params
from tocsin.session import materialize

SEED = 42
ORDERS = Params(tmin=6, hmax=80, smooth_length=3, alphas=(0.05, 0.10, 0.20), delta=0.05, score_digits=9)
EVENTS = Params(tmin=6, hmax=120, smooth_length=3, alphas=(0.05, 0.10, 0.20), delta=0.05, score_digits=9)
SHARES = {"validation": 0.30, "calibration": 0.40, "test": 0.30}
EVENT_TYPES = ("click", "purchase", "error", "signup", "view")

_shared: dict[tuple, object] = {}


def reset() -> None:
    """Forget the shared tables, so that the next query derives them again."""
    _shared.clear()


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        out = build()
        _shared[key] = materialize(out, name) if isinstance(out, DataFrame) else out
    return _shared[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_of(key) -> F.Column:
    return F.when(key % 2 == 0, "A").otherwise("B")


# -- orders: trajectories ------------------------------------------------------------

def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("episode_id"), t.cast("int").alias("t"), "o_totalprice", "o_orderpriority").where("t between 1 and 80")


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, t, risk): one row per customer and month with an order."""
    peak = order_months(spark, sf_dir).groupBy("episode_id", "t").agg(F.max("o_totalprice").alias("price"))
    risk = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("price") - 250000.0) / 80000.0))
    return peak.select("episode_id", "t", F.round(risk, 9).alias("risk"))


def order_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, site, event, onset, horizon)."""
    def build() -> DataFrame:
        big = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 375000) & (F.col("t") > 12)
        first = order_months(spark, sf_dir).groupBy("episode_id").agg(F.min(F.when(big, F.col("t"))).alias("_first"))
        horizon = F.least(F.lit(80), (40 + (F.col("episode_id") * 37) % 41)).cast("int")
        event = F.coalesce(F.col("_first") <= F.col("horizon"), F.lit(False))
        return (first.withColumn("horizon", horizon).withColumn("event", event)
                .select("episode_id", site_of(F.col("episode_id")).alias("site"), "event",
                        F.when(F.col("event"), F.col("_first").cast("double")).otherwise(F.lit(INF)).alias("onset"), "horizon"))
    return shared(spark, sf_dir, "order-episodes", build)


def order_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "order-split",
                  lambda: stratified_split(order_episodes(spark, sf_dir), SHARES, SEED))


def order_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories with the split column, before standardisation."""
    return shared(spark, sf_dir, "order-trajectories",
                  lambda: trajectories(order_scores(spark, sf_dir), order_split(spark, sf_dir), ORDERS))


def order_templates(spark: SparkSession, sf_dir: str) -> dict[object, TimeTemplate]:
    """The pooled template of the validation non-events."""
    def build():
        keep = "split = 'validation' and not event"
        return fit_time_templates(order_plain(spark, sf_dir).where(keep), order_split(spark, sf_dir).where(keep), ORDERS)
    return shared(spark, sf_dir, "order-templates", build)


def order_site_templates(spark: SparkSession, sf_dir: str) -> dict[object, TimeTemplate]:
    """One template per site, from its own validation non-events."""
    def build():
        keep = "split = 'validation' and not event"
        return fit_time_templates(order_plain(spark, sf_dir).where(keep), order_split(spark, sf_dir).where(keep), ORDERS, key="site")
    return shared(spark, sf_dir, "order-site-templates", build)


def order_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_standardized(order_plain(spark, sf_dir), order_templates(spark, sf_dir), ORDERS)


def order_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode with its largest score and standardised score."""
    return shared(spark, sf_dir, "order-maxima", lambda: maxima(
        order_trajectories(spark, sf_dir), order_split(spark, sf_dir), {"max_score": "score", "max_z": "z"}))


def calibration_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_maxima(spark, sf_dir).where("split = 'calibration' and not event")


def order_youden(spark: SparkSession, sf_dir: str) -> float:
    """Youden threshold on the raw risk of the pooled validation episodes."""
    def build() -> float:
        flat = flat_eligible(order_plain(spark, sf_dir).where("split = 'validation'"), ORDERS)
        return youden_threshold(flat).first()["threshold"]
    return shared(spark, sf_dir, "order-youden", build)


def order_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "order-thresholds", lambda: calibrate(
        calibration_maxima(spark, sf_dir),
        order_trajectories(spark, sf_dir).where("split = 'calibration' and not event"),
        ORDERS, youden=order_youden(spark, sf_dir)))


def order_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the test episodes under every method and alpha."""
    return shared(spark, sf_dir, "order-outcomes", lambda: al.outcomes(
        order_trajectories(spark, sf_dir).where("split = 'test'"),
        order_split(spark, sf_dir).where("split = 'test'"), order_thresholds(spark, sf_dir), ORDERS))


# -- events: irregular measurements ---------------------------------------------------

VARIABLES = tuple(f"v_{e}" for e in EVENT_TYPES)


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    t = (F.floor(seconds / 21600) + 1).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"), t.alias("t"), "event_id", "event_type", "value").where("t between 1 and 120")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, site, t, v_<type>..., risk): one row per user and 6-hour step; the
    latest event of a type counts."""
    def build() -> DataFrame:
        latest = [F.max_by("value", F.when(F.col("event_type") == e, F.col("event_id"))).alias(f"v_{e}") for e in EVENT_TYPES]
        risk = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.avg("value") - 60.0) / 30.0))
        rows = event_hours(spark, sf_dir).groupBy("episode_id", "t").agg(*latest, F.round(risk, 9).alias("risk"))
        return rows.withColumn("site", site_of(F.col("episode_id")))
    return shared(spark, sf_dir, "event-measurements", build)


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        bad = (F.col("event_type") == "error") & (F.col("value") > 150) & (F.col("t") > 12)
        per = event_hours(spark, sf_dir).groupBy("episode_id").agg(
            F.max("t").alias("_max"), F.min(F.when(bad, F.col("t"))).alias("_first"))
        per = per.withColumn("horizon", F.least(F.col("_max"), 48 + (F.col("episode_id") * 37) % 73).cast("int"))
        event = F.coalesce(F.col("_first") <= F.col("horizon"), F.lit(False))
        return per.select("episode_id", site_of(F.col("episode_id")).alias("site"), event.alias("event"),
                          F.when(event, F.col("_first").cast("double")).otherwise(F.lit(INF)).alias("onset"), "horizon",
                          (40 + F.col("episode_id") % 50).cast("double").alias("age"))
    return shared(spark, sf_dir, "event-episodes", build)


def event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "event-split", lambda: stratified_split(
        event_episodes(spark, sf_dir), {"train": 0.5, "validation": 0.25, "test": 0.25}, SEED))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of the 41 file columns from ``events``, with a few faulty users per
    kind of fault, chosen by user id."""
    from tocsin.sources.episode_files import LONGITUDINAL

    def build() -> DataFrame:
        u, t = F.col("episode_id"), F.col("t")
        bad = (F.col("event_type") == "error") & (F.col("value") > 150) & (F.col("t") > 12)
        first = event_hours(spark, sf_dir).groupBy("episode_id").agg(F.min(F.when(bad, F.col("t"))).alias("_first"))
        rows = measurements(spark, sf_dir).join(first, "episode_id").where(~((u % 37 == 2) & (t > 5)))
        others = wide_measurements(spark, sf_dir).select("episode_id", "t", *LONGITUDINAL[len(VARIABLES):])
        rows = rows.join(others, ["episode_id", "t"], "left")
        label = F.when(t >= F.col("_first") - 6, 1.0).otherwise(0.0)
        label = F.when((u % 47 == 3) & (t % 17 == 0), 2.0).when((u % 43 == 11) & (t % 19 == 0), 0.0).otherwise(label)
        hour = F.when((u % 67 == 9) & (t % 13 == 0), t + 0.5).when((u % 71 == 4) & (t % 11 == 0), t - 1.0).otherwise(t.cast("double"))
        order = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.when(u % 61 == 7, -t).otherwise(t))) - 1
        names = dict(zip(LONGITUDINAL, VARIABLES))
        return rows.select(
            "site", "episode_id", order.cast("long").alias("row_no"),
            *[F.col(names.get(c, c)).alias(c) for c in LONGITUDINAL],
            (40.0 + u % 50 + F.when((u % 53 == 5) & (t % 2 == 0), 1).otherwise(0)).cast("double").alias("Age"),
            (u % 2).cast("double").alias("Gender"),
            F.when(u % 3 == 0, 1.0).when(u % 3 == 1, 0.0).alias("Unit1"),
            F.when(u % 3 == 1, 1.0).when(u % 3 == 0, 0.0).alias("Unit2"),
            (-(u % 40)).cast("double").alias("HospAdmTime"), hour.alias("t"), label.alias("label"))
    return shared(spark, sf_dir, "event-records", build)


def record_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tocsin.operators.quality import manifest
    from tocsin.sources.episode_files import BASELINE, LONGITUDINAL

    return shared(spark, sf_dir, "event-manifest",
                  lambda: manifest(records(spark, sf_dir), EVENTS, LONGITUDINAL, BASELINE))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tocsin.operators.features import feature_rows

    return shared(spark, sf_dir, "event-features", lambda: feature_rows(
        measurements(spark, sf_dir), event_episodes(spark, sf_dir), EVENTS, VARIABLES, ("age",)))


# -- all 34 variables -------------------------------------------------------------------

def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``kind``, the number of their variable: by type and id modulo 7."""
    types = F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")) - 1
    return event_hours(spark, sf_dir).withColumn("kind", types * 7 + F.col("event_id") % 7)


def wide_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, t, variable, x): the values of ``wide_measurements``, a row for each."""
    from tocsin.sources.episode_files import LONGITUDINAL

    rows = event_kinds(spark, sf_dir).where(F.col("kind").between(0, len(LONGITUDINAL) - 1))
    return rows.groupBy("episode_id", "t", F.col("kind").cast("int").alias("variable")).agg(F.max_by("value", "event_id").alias("x"))


def wide_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, site, t, 34 variables): events by type and id modulo 7, the latest counts."""
    from tocsin.sources.episode_files import LONGITUDINAL

    def build() -> DataFrame:
        rows = event_kinds(spark, sf_dir)
        latest = [F.max_by("value", F.when(F.col("kind") == i, F.col("event_id"))).alias(v) for i, v in enumerate(LONGITUDINAL)]
        return rows.groupBy("episode_id", "t").agg(*latest).withColumn("site", site_of(F.col("episode_id")))
    return shared(spark, sf_dir, "wide-measurements", build)


def wide_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with the five baseline columns of the records."""
    u = F.col("episode_id")
    return event_episodes(spark, sf_dir).drop("age").select(
        "*", (40.0 + u % 50).alias("Age"), (u % 2).cast("double").alias("Gender"), F.when(u % 3 == 0, 1.0).when(u % 3 == 1, 0.0).alias("Unit1"),
        F.when(u % 3 == 1, 1.0).when(u % 3 == 0, 0.0).alias("Unit2"), (-(u % 40)).cast("double").alias("HospAdmTime"))
