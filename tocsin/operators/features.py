"""Causal features on irregular hourly measurements.

All trailing statistics of all variables use one window over (episode_id ordered by t): one
shuffle and one sort per episode serve every variable and window length. An episode has at
most hmax rows there, because hours are unique and cut at hmax.

``feature_runs`` gives the same table as runs of hours: a feature changes only where a value
enters or leaves its window, so rare values make few runs, whatever the number of hours.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import finite, first_score_hour, fitting_hour, lookahead_label
from tocsin.params import Params

WINDOWS = (6, 12, 24)


@dataclass(frozen=True)
class Statistic:
    """A statistic of one variable. ``fallible``: it has no value when nothing (or too little) was
    observed, so models get an indicator beside it, whatever the training data hold."""
    name: str
    trailing: bool
    fallible: bool

    def column(self, variable: str, hours: int | None = None) -> str:
        return f"{variable}_{self.name}" + (f"_{hours}h" if self.trailing else "")


#: What is computed for every variable, in the order of the feature table.
STATISTICS = (
    *(Statistic(name, False, fallible) for name, fallible in (("last", True), ("never", False), ("since", True), ("current", False))),
    *(Statistic(name, True, name != "count") for name in ("mean", "min", "max", "sd", "change", "slope", "count")),
)
STATS = tuple(s.name for s in STATISTICS if s.trailing)
RECENT = tuple(s.name for s in STATISTICS if not s.trailing)


def variable_features(variable: str, windows: Sequence[int] = WINDOWS) -> dict[str, Statistic]:
    """Feature columns of one variable, with their statistics."""
    recent = {s.column(variable): s for s in STATISTICS if not s.trailing}
    return recent | {s.column(variable, h): s for h in windows for s in STATISTICS if s.trailing}


def feature_names(variables: Sequence[str], baseline: Sequence[str] = (), windows: Sequence[int] = WINDOWS,
                  site: str | None = "site_b") -> list[str]:
    """Columns of the feature table: episode attributes, hour, site, then variable by variable."""
    attributes = [c for c in (*baseline, "hour", site) if c]
    return attributes + [name for v in variables for name in variable_features(v, windows)]


def statistic_of(name: str) -> Statistic | None:
    """The statistic at the end of a feature name; None for episode attributes."""
    stem, _, end = name.rpartition("_")
    if re.fullmatch(r"\d+h", end):
        stem, _, end = stem.rpartition("_")
        trailing = True
    else:
        trailing = False
    return next((s for s in STATISTICS if stem and s.name == end and s.trailing == trailing), None)


def indicator_features(names: Sequence[str]) -> list[str]:
    """Features that get a missing indicator."""
    return [n for n in names if (s := statistic_of(n)) is not None and s.fallible]


def hour_grid(measurements: DataFrame, episodes: DataFrame, p: Params) -> DataFrame:
    """One row per episode and hour 1..min(horizon, hmax), measurements where present.

    Measurements and episodes meet once, partitioned by episode_id. A measured hour then
    writes itself and the empty hours up to the next one, so no grid is shuffled, and the
    feature windows reuse the partitioning. The partition count is explicit because the
    rows grow after the shuffle.
    """
    n = int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.least(F.col("horizon"), F.lit(p.hmax)) if p.hmax is not None else F.col("horizon")
    values = [c for c in measurements.columns if c not in ("episode_id", "site", "t")]
    long = episodes.withColumn("_last", last.cast("int")).where("_last >= 1").repartition(n, "episode_id")
    rows = measurements.select("episode_id", F.col("t").cast("int").alias("_t"), *values).repartition(n, "episode_id")
    joined = long.join(rows, (long["episode_id"] == rows["episode_id"]) & (rows["_t"] >= 1) & (rows["_t"] <= long["_last"]), "left").drop(rows["episode_id"])
    w = Window.partitionBy("episode_id").orderBy("_t")
    first = F.row_number().over(w) == 1
    start = F.when(first, F.lit(1)).otherwise(F.col("_t"))
    stop = F.coalesce(F.lead("_t").over(w) - 1, F.col("_last"))
    spread = joined.withColumn("_hours", F.sequence(start, stop)).withColumn("t", F.explode("_hours"))
    own = F.col("t") == F.col("_t")
    return spread.select(*episodes.columns, "t", *[F.when(own, F.col(c)).alias(c) for c in values])


def baseline_values(rows: DataFrame, columns: Sequence[str], order: str = "row_no") -> DataFrame:
    """First finite value of each baseline column in record order."""
    return rows.groupBy("episode_id").agg(
        *[F.min_by(finite(c), F.when(finite(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _trailing(part: Column, t: Column, hours: int) -> Column:
    """Struct of the statistics of the last ``hours`` hours of one variable. ``part``: its observed (t, x), by t."""
    return _let(F.filter(part, lambda r: r["t"] > t - hours), _statistics)


def _statistics(inside: Column) -> Column:
    """Struct of the statistics of the observed (t, x), by t.

    Spread and slope are two-pass sums over deviations; they and the change need two values.
    """
    total = lambda f: F.aggregate(inside, F.lit(0.0), lambda a, r: a + f(r))
    n = F.size(inside)
    means = F.struct(n.alias("n"), (total(lambda r: r["x"]) / F.nullif(n, F.lit(0))).alias("x"),
                     (total(lambda r: r["t"].cast("double")) / F.nullif(n, F.lit(0))).alias("t"))

    def spread(m: Column) -> Column:
        xs, two = F.transform(inside, lambda r: r["x"]), lambda e: F.when(m["n"] >= 2, e)
        made = {
            "mean": m["x"], "min": F.array_min(xs), "max": F.array_max(xs),
            "sd": two(F.sqrt(total(lambda r: (r["x"] - m["x"]) * (r["x"] - m["x"])) / F.nullif(m["n"] - 1, F.lit(0)))),
            "change": two(F.get(inside, m["n"] - 1)["x"] - F.get(inside, F.lit(0))["x"]),
            "slope": two(total(lambda r: (r["t"] - m["t"]) * (r["x"] - m["x"])) / total(lambda r: (r["t"] - m["t"]) * (r["t"] - m["t"]))),
            "count": m["n"].cast("double"),
        }
        return F.struct(*[e.alias(stat) for stat, e in made.items()])

    return _let(means, spread)


def window_features(grid: DataFrame, variables: Sequence[str], windows: Sequence[int] = WINDOWS,
                    keep: Sequence[str] = ("site", "event", "onset", "horizon")) -> DataFrame:
    """Recent-value and trailing-window features of an hour grid.

    The variables of an hour are one array, and one window frame holds the arrays of the longest
    trailing window; higher-order functions reduce it for every variable and length. So there is
    one window node, and its size does not grow with variables, lengths and statistics. Only the
    last observed value and its hour are window functions of each variable.
    """
    w = Window.partitionBy("episode_id").orderBy("t")
    past, t = w.rowsBetween(Window.unboundedPreceding, 0), F.col("t")
    x = grid.select("episode_id", "t", *keep, *[finite(v).alias(v) for v in variables])
    x = x.withColumn("_x", F.array(*[F.col(v) for v in variables]))
    longest = F.collect_list(F.struct("t", F.col("_x").alias("x"))).over(w.rangeBetween(-(max(windows) - 1), 0))
    recent = [e for i, v in enumerate(variables) for e in (
        F.last(F.col(v), True).over(past).alias(f"_last{i}"), F.last(F.when(F.col(v).isNotNull(), t), True).over(past).alias(f"_at{i}"))]
    rows = x.select("episode_id", "t", *keep, "_x", longest.alias("_frame"), *recent)
    made = F.transform(F.sequence(F.lit(0), F.lit(len(variables) - 1)), lambda i: _all_trailing(i, t, windows))
    rows = rows.withColumn("_stats", made)
    out: list[Column] = []
    for i, v in enumerate(variables):
        at = F.col(f"_at{i}")
        values = {"last": F.col(f"_last{i}"), "never": at.isNull().cast("double"), "since": (t - at).cast("double"),
                  "current": F.get("_x", F.lit(i)).isNotNull().cast("double")}
        for name, stat in variable_features(v, windows).items():
            value = F.get("_stats", F.lit(i))[name.rpartition("_")[2]][stat.name] if stat.trailing else values[stat.name]
            out.append(value.alias(name))
    return rows.select("episode_id", "t", *keep, *out)


def _all_trailing(i: Column, t: Column, windows: Sequence[int]) -> Column:
    """Structs by window of the statistics of variable number ``i``, from the frame."""
    part = F.filter(F.transform("_frame", lambda r: F.struct(r["t"].alias("t"), F.get(r["x"], i).alias("x"))), lambda r: r["x"].isNotNull())
    return _let(part, lambda p: F.struct(*[_trailing(p, t, h).alias(f"{h}h") for h in windows]))


def attribute_rows(episodes: DataFrame, p: Params) -> DataFrame:
    """Rows of the feature table with what an episode and its hour alone give: ``episodes`` columns, t,
    hour, site_b. No measurement is read and nothing is shuffled: every episode writes its own hours."""
    last = F.least(F.col("horizon"), F.lit(p.hmax)) if p.hmax is not None else F.col("horizon")
    spread = episodes.withColumn("_last", last.cast("int")).where("_last >= 1")
    rows = spread.withColumn("t", F.explode(F.sequence(F.lit(1), F.col("_last")))).drop("_last").where(F.col("t") >= first_score_hour(p))
    return with_attributes(rows)


def with_attributes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hour", F.col("t").cast("double")).withColumn("site_b", (F.col("site") == "B").cast("double"))


def feature_rows(measurements: DataFrame, episodes: DataFrame, p: Params, variables: Sequence[str],
                 baseline: Sequence[str] = (), windows: Sequence[int] = WINDOWS, with_site: bool = True) -> DataFrame:
    """The complete feature table: score-history hours, features in a fixed order, and
    the look-ahead label. ``baseline`` columns come with ``episodes``."""
    keep = ["site", "event", "onset", "horizon", *baseline]
    grid = hour_grid(measurements, episodes.select("episode_id", *keep), p)
    rows = window_features(grid, variables, windows, keep).where(F.col("t") >= first_score_hour(p))
    rows = with_attributes(rows)
    names = feature_names(variables, baseline, windows, "site_b" if with_site else None)
    return rows.select("episode_id", "site", "event", "onset", "horizon", "t", *names,
                       lookahead_label(p).cast("int").alias("label"), fitting_hour(p).alias("fit"))


def observations(measurements: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(episode_id, t, variable, x): a row per value, ``variable`` the place among ``variables``."""
    cells = F.array(*[F.struct(F.lit(i).alias("variable"), finite(v).alias("x")) for i, v in enumerate(variables)])
    return measurements.select("episode_id", "t", F.inline(F.filter(cells, lambda c: c["x"].isNotNull())))


def feature_runs(values: DataFrame, episodes: DataFrame, p: Params, variables: Sequence[str],
                 baseline: Sequence[str] = (), windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The table of ``feature_rows`` as runs of hours, (episode_id, position, start, stop, value, step).

    ``values`` are ``observations``, with (episode_id, t, variable) unique. At the hours t of
    start..stop the feature at ``position`` of ``feature_names`` is value + step (t - start); hours
    without a value have no run. Values meet their episode once, as one sorted array; the runs of a
    variable begin where one of its values enters or leaves a window.
    """
    n = int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.lit(first_score_hour(p))
    last = F.least(F.col("horizon"), F.lit(p.hmax)) if p.hmax is not None else F.col("horizon")
    spans = episodes.withColumn("_last", last.cast("int")).where(F.col("_last") >= first)
    attributes = with_attributes(spans.withColumn("t", first))
    names = feature_names((), baseline)
    cells = F.array(*[F.struct(F.lit(i).alias("position"), finite(c).alias("value"), F.lit(int(c == "hour")).alias("step")) for i, c in enumerate(names)])
    whole = attributes.select("episode_id", first.alias("start"), F.col("_last").alias("stop"), F.inline(cells)).where("value is not null")

    seen = values.select("episode_id", F.col("t").cast("int").alias("t"), "variable", finite("x").alias("x")).where("x is not null and t >= 1")
    seen = seen.repartition(n, "episode_id").groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("t", "variable", "x"))).alias("_seen"))
    rows = spans.select("episode_id", "_last").repartition(n, "episode_id").join(seen.hint("merge"), "episode_id", "left")
    rows = rows.withColumn("_seen", F.coalesce("_seen", F.array().cast(seen.schema["_seen"].dataType)))
    of_variable = lambda i: F.filter("_seen", lambda r: (r["variable"] == i) & (r["t"] <= F.col("_last")))
    rows = rows.select("episode_id", "_last", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(variables) - 1)), of_variable)).alias("_variable", "_part"))

    # the recent features, marked by 0 hours, change with the same edges as a window of one hour
    kinds = [(0, 0), *[(h, len(RECENT) + i * len(STATS)) for i, h in enumerate(windows)]]
    rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(h).alias("_hours"), F.lit(at).alias("_offset")) for h, at in kinds])))
    edges = F.flatten(F.transform("_part", lambda r: F.array(r["t"], r["t"] + F.greatest(F.col("_hours"), F.lit(1)))))
    starts = F.sort_array(F.array_distinct(F.concat(F.array(first), F.filter(edges, lambda t: (t > first) & (t <= F.col("_last"))))))
    stretch = lambda begin: F.transform(begin, lambda t, i: F.struct(t.alias("start"), F.coalesce(F.get(begin, i + 1) - 1, F.col("_last")).alias("stop")))
    rows = rows.select("*", F.inline(_let(starts, stretch)))

    inside = F.filter("_part", lambda r: (r["t"] <= F.col("start")) & ((F.col("_hours") == 0) | (r["t"] > F.col("start") - F.col("_hours"))))
    rows = rows.select("episode_id", "start", "stop", "_variable", "_hours", "_offset", inside.alias("_inside"))
    none = F.array(*[F.lit(0.0 if name == "count" else None).cast("double") for name in STATS])
    trailing = F.when(F.size("_inside") == 0, none).otherwise(_let(_statistics(F.col("_inside")), lambda s: F.array(*[s[name] for name in STATS])))
    recent = _let(F.get("_inside", F.size("_inside") - 1), lambda at: _recent(at, F.col("start")))
    width = len(variable_features("", windows))
    made = rows.select("episode_id", "start", "stop", "_variable", "_hours", "_offset", F.posexplode(F.when(F.col("_hours") == 0, recent).otherwise(trailing)).alias("_stat", "value"))
    made = made.where("value is not null").select(
        "episode_id", "start", "stop", (F.lit(len(names)) + F.col("_variable") * width + F.col("_offset") + F.col("_stat")).alias("position"), "value",
        ((F.col("_hours") == 0) & (F.col("_stat") == RECENT.index("since"))).cast("int").alias("step"))
    return whole.unionByName(made)


def _recent(at: Column, t: Column) -> Column:
    """Array of the recent features at hour ``t`` from the last observed (t, x), or from NULL."""
    made = {"last": at["x"], "never": at.isNull().cast("double"), "since": (t - at["t"]).cast("double"),
            "current": F.coalesce(at["t"] == t, F.lit(False)).cast("double")}
    return F.array(*[made[name] for name in RECENT])


def features_as_of(measurements: DataFrame, queries: DataFrame, variables: Sequence[str],
                   windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The same features at chosen hours, by a bucketed as-of join instead of windows.

    ``queries`` has (episode_id, q). Hours are cut into buckets as long as the longest window, so
    a query only meets the rows of its own bucket and the one before. What was last observed
    earlier comes from one summary row per episode and bucket. Joins are on (episode, bucket);
    serves as an independent check of ``window_features``.

    All joins merge sorted rows: an estimate does not see the hours that a query table explodes
    from its episodes, and would send them to every worker through the driver.
    """
    width = max(windows)
    bucket = lambda t: F.floor(F.col(t) / width)
    asked = queries.select("episode_id", "q").distinct().withColumn("bucket", bucket("q"))
    rows = measurements.select("episode_id", F.col("t").cast("int").alias("t"), *[finite(v).alias(v) for v in variables]).withColumn("bucket", bucket("t"))
    seen = lambda v: F.when(F.col(v).isNotNull(), F.col("t"))

    near = asked.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))).join(rows.hint("merge"), ["episode_id", "bucket"]).where("t <= q")
    sums: list[Column] = []
    for v in variables:
        sums += [F.max_by(F.col(v), seen(v)).alias(f"_{v}_near"), F.max(seen(v)).alias(f"_{v}_near_at")]
        for h in windows:
            x = F.when(F.col("t") > F.col("q") - h, F.col(v))
            at = F.when(x.isNotNull(), F.col("t"))
            made = {"mean": F.avg(x), "min": F.min(x), "max": F.max(x), "sd": F.stddev_samp(x), "change": F.max_by(x, at) - F.min_by(x, at),
                    "slope": F.regr_slope(x, F.col("t").cast("double")), "count": F.count(x).cast("double")}
            two = F.count(x) >= 2
            sums += [(F.when(two, e) if stat in ("sd", "change", "slope") else e).alias(f"{v}_{stat}_{h}h") for stat, e in made.items()]
    near = near.groupBy("episode_id", "q").agg(*sums)

    lasts = rows.groupBy("episode_id", "bucket").agg(*[e for v in variables for e in (F.max_by(F.col(v), seen(v)).alias(f"_{v}_x"), F.max(seen(v)).alias(f"_{v}_at"))])
    earlier = asked.select("episode_id", "q", (F.col("bucket") - 1).alias("_before")).join(lasts.hint("merge"), "episode_id").where("bucket < _before")
    earlier = earlier.groupBy("episode_id", "q").agg(*[e for v in variables for e in (
        F.max_by(f"_{v}_x", f"_{v}_at").alias(f"_{v}_far"), F.max(f"_{v}_at").alias(f"_{v}_far_at"))])

    both = asked.select("episode_id", "q").join(near.hint("merge"), ["episode_id", "q"], "left").join(earlier.hint("merge"), ["episode_id", "q"], "left")
    out: list[Column] = []
    for v in variables:
        at = F.coalesce(f"_{v}_near_at", f"_{v}_far_at")
        out += [F.when(F.col(f"_{v}_near_at").isNotNull(), F.col(f"_{v}_near")).otherwise(F.col(f"_{v}_far")).alias(f"{v}_last"), at.isNull().cast("double").alias(f"{v}_never"),
                (F.col("q") - at).cast("double").alias(f"{v}_since"), F.coalesce(at == F.col("q"), F.lit(False)).cast("double").alias(f"{v}_current")]
        for h in windows:
            out += [(F.coalesce(n, F.lit(0.0)) if n == f"{v}_count_{h}h" else F.col(n)).alias(n) for n in (f"{v}_{stat}_{h}h" for stat in STATS)]
    return both.select("episode_id", F.col("q").alias("t"), *out)


def fit_medians(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exact medians of the finite training values, (feature, median, add_missing).

    Features without a value get 0. Values are pre-counted per distinct value, so a
    task holds distinct values and not rows.
    """
    from tocsin.functions.tables import values
    from tocsin.operators.ranking import distinct_values, quantile_linear

    spark = train.sparkSession
    names = list(names)
    long = train.select([finite(n).alias(n) for n in names]).unpivot([], names, "feature", "value").where("value is not null")
    med = quantile_linear(distinct_values(long, ["feature"], "value"), ["feature"], "value", [(0.5, 0.5)], out="median").drop("prob")
    flags = set(indicator_features(names))
    every = values(spark, ["position", "feature", "add_missing"], [(i, n, n in flags) for i, n in enumerate(names)])
    return every.join(med, "feature", "left").withColumn("median", F.coalesce("median", F.lit(0.0)))


def read_medians(medians: DataFrame) -> dict[str, float]:
    """Medians as literals: one number per feature column."""
    return {r["feature"]: r["median"] for r in medians.select("feature", "median").collect()}


def apply_medians(rows: DataFrame, medians: Mapping[str, float], drop: Sequence[str] = ()) -> DataFrame:
    """Replace missing values by frozen medians and append the missing indicators."""
    names = [n for n in medians if n in rows.columns]
    flagged = set(indicator_features(names))
    others = [c for c in rows.columns if c not in names]
    filled = [F.coalesce(finite(n), F.lit(float(medians[n]))).alias(n) for n in names if n not in drop]
    flags = [finite(n).isNull().cast("double").alias(f"{n}__missing") for n in names if n in flagged]
    return rows.select(*others, *filled, *flags)


def missing_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """NULLs per column, (feature, n_missing): zero after ``apply_medians``."""
    sums = rows.agg(*[F.sum(F.col(n).isNull().cast("long")).alias(n) for n in names])
    return sums.unpivot([], list(names), "feature", "n_missing")


def feature_family(name: Column) -> Column:
    """The statistic of a feature name; baseline for episode attributes."""
    part = F.regexp_extract(name, f"_({'|'.join(s.name for s in STATISTICS)})(_\\d+h)?$", 1)
    return F.when(part == "", "baseline").otherwise(part)


def feature_diagnostics(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per family: imputed share, and number and share of constant features."""
    names = list(names)
    per = rows.agg(
        F.count("*").alias("_rows"),
        *[F.struct(F.count(n).alias("n"), F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in names])
    long = per.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("feature"), F.col("_rows").alias("rows"), F.col(n)["n"].alias("n"),
        (F.col(n)["lo"] == F.col(n)["hi"]).alias("constant")) for n in names])))
    return long.groupBy(feature_family(F.col("feature")).alias("family")).agg(
        F.count("*").alias("n_features"),
        (100.0 * F.sum(F.col("rows") - F.col("n")) / F.sum("rows")).alias("imputed_percentage"),
        F.count(F.when(F.col("constant") & (F.col("n") == F.col("rows")), 1)).alias("n_constant"))
