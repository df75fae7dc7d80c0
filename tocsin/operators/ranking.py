"""Ranks, order statistics and prefix sums; the same path at every size.

A site or a stratum may hold a large share of all rows, so no window here is partitioned by
such a key alone:

* ``hash_rank`` orders by an md5 key; the leading digits of the key cut every stratum into
  even buckets, ranked apart and shifted by the bucket counts.
* ``select_ranks`` finds order statistics by radix selection: doubles become integers of the
  same order, and rounds of histograms over the next 12 bits narrow all wanted ranks of all
  groups at once. Nothing is sorted; a histogram has at most 4,096 cells per group and rank.
* ``global_rank`` and ``prefix_sums``, where every row needs its place, sort the table by
  range, write it once, and shift per-partition results by partition totals.

Values are summed per distinct value first, so one repeated value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import INF, hash_key
from tocsin.functions.tables import each_row
from tocsin.session import broadcast_if_small, materialize

#: Bits that are left below the cells of each round.
SHIFTS = (52, 40, 28, 16, 4, 0)


def hash_rank(
    df: DataFrame, strata: Sequence[str], id_col: str, seed: int, stream: Column | str,
    rank: str = "rank", total: str = "stratum_size", digits: int = 3, first: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in the hashed order of its stratum and
    the stratum size. ``digits`` hex digits give 16**digits buckets per stratum. With
    ``first``, only rows up to that position stay, and only buckets that hold them are ranked."""
    strata = list(strata)
    keyed = df.withColumn("_key", hash_key(seed, stream, F.col(id_col))).withColumn(
        "_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*strata).orderBy("_bucket")
    offsets = counts.select(
        *strata, "_bucket",
        (F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias(total),
    )
    local = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_key", id_col))
    if first is None:
        ranked = null_safe_join(keyed.withColumn("_local", local), offsets, [*strata, "_bucket"])
    else:
        near = materialize(offsets.where(F.col("_before") < first), "first-buckets")
        ranked = null_safe_join(keyed, broadcast_if_small(near, near), [*strata, "_bucket"]).withColumn("_local", local)
    out = ranked.withColumn(rank, F.col("_before") + F.col("_local")).drop("_key", "_bucket", "_local", "_before")
    return out if first is None else out.where(F.col(rank) <= first)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match each other."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _ranged(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Range-sort by (keys, order), fix the partition and position of every row."""
    placed = df.orderBy(*keys, *order).withColumn("_pos", F.monotonically_increasing_id())
    return materialize(placed, name).withColumn("_part", F.shiftright("_pos", 33))


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """1-based rank within ``keys`` by ``order``; the order should break ties."""
    keys = list(keys)
    placed = _ranged(df, keys, list(order), "rank")
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    return (null_safe_join(placed, offsets, [*keys, "_part"])
            .withColumn(rank, F.col("_before") + (F.col("_pos") - F.col("_first")) + 1)
            .drop("_pos", "_part", "_before", "_first"))


def prefix_sums(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (keys, distinct value), ascending cumulative sums and totals.

    Columns: keys, value, and for every entry s of ``sums``: s, cum_s, total_s.
    """
    keys = list(keys)
    distinct = df.groupBy(*keys, value).agg(*[F.sum(c).alias(s) for s, c in sums.items()])
    whole = Window.partitionBy(*keys)
    placed = _ranged(distinct, keys, [F.col(value)], "prefix")
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_p_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, "_part",
        *[F.coalesce(F.sum(f"_p_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_p_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    joined = null_safe_join(local, offsets, [*keys, "_part"])
    return joined.select(
        *keys, value, *[F.col(s) for s in sums],
        *[(F.col(f"_before_{s}") + F.col(f"_in_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def ordered_bits(value: Column) -> Column:
    """A long that orders doubles as their values do (both zeros alike); NULL stays NULL.

    Sign times (exponent, mantissa), as in the bits of the number: steps between neighbouring
    doubles are 1, so 64 bits tell all of them apart.
    """
    a = F.abs(value.cast("double"))
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(a)).cast("int")  # may be one off beside a power of two
    e = guess - (two(guess) > a).cast("int") + (two(guess + 1) <= a).cast("int")
    unit = F.lit(2.0**52)
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((a / two(e) - 1) * unit).cast("long")
    small = (a * F.lit(2.0**1022) * unit).cast("long")
    size = (F.when(a == INF, F.lit(2047 << 52)).when(a == 0, F.lit(0)).when(a < 2.0**-1022, small).otherwise(normal)).cast("long")
    return F.when(value < 0, -size).otherwise(size)


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Written table (keys, value, n): rows, or the sum of the DECIMAL ``weight``, per distinct value."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight.cast("decimal(28,18)"))
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    return materialize(rows.withColumn("_bits", ordered_bits(F.col(value))), "distinct-values")


def select_ranks(counts: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str, k: str = "k", out: str = "threshold") -> DataFrame:
    """``wanted`` (keys, any labels, k) with the smallest value whose cumulative n reaches k, NULL
    where the group's n does not. ``counts`` comes from ``distinct_values``; k has the type of n.

    A round counts the n of every cell of the next bits within the cells that hold a wanted
    rank, and goes on with the cell that the rank falls in and the rank inside it. It ends when
    every such cell holds one distinct value.
    """
    keys = list(keys)
    asked = materialize(wanted.withColumn("_id", F.monotonically_increasing_id()), "ranks")
    state, kind, known = asked.select("_id", *keys, F.lit(0).cast("long").alias("_cell"), F.col(k).alias("_rest")).where("_rest is not null"), wanted.schema[k].dataType, asked
    for at, shift in enumerate(SHIFTS):
        rows = counts.select(*keys, value, "n", F.shiftright("_bits", shift).alias("_next"),
                             (F.shiftright("_bits", SHIFTS[at - 1]) if at else F.lit(0).cast("long")).alias("_cell"))
        if at:
            rows = null_safe_join(rows, broadcast_if_small(state.select(*keys, "_cell").distinct(), known), [*keys, "_cell"])
        cells = rows.groupBy(*keys, "_cell", "_next").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_values"), F.min(value).alias("_value"))
        inside = Window.partitionBy(*keys, "_cell").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        met = null_safe_join(cells, broadcast_if_small(state.select("_id", *keys, "_cell", "_rest"), known), [*keys, "_cell"])
        met = met.where((F.col("_rest") > F.col("_before")) & (F.col("_rest") <= F.col("_before") + F.col("_n")))
        state = materialize(met.select("_id", *keys, F.col("_next").alias("_cell"), (F.col("_rest") - F.col("_before")).cast(kind).alias("_rest"), "_values", "_value"), "rank-cells")
        known = state
        if (state.agg(F.max("_values")).first()[0] or 1) == 1:
            break
    found = state.select(F.col("_id").alias("_found"), F.col("_value").alias(out))
    return asked.join(broadcast_if_small(found, state), F.col("_id") == F.col("_found"), "left").drop("_id", "_found")


def pick_ranks(counts: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str,
               k: str = "k", out: str = "threshold") -> DataFrame:
    """k-th smallest value per row of ``ranks`` (keys, any labels, k), +inf when k exceeds the count."""
    return select_ranks(counts, ranks, keys, value, k, out).withColumn(out, F.coalesce(out, F.lit(INF)))


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "m0") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str,
                      probs: Sequence[tuple[float, float]], label: str = "prob", out: str = "quantile",
                      tol: float = 1e-12) -> DataFrame:
    """Smallest value whose cumulative weight reaches probability * total, per key and per
    (label, probability) pair: columns keys, label, out.

    Weights are summed as decimals, so the order of rows does not matter; ``tol`` is relative
    to the total and absorbs their rounding, as of thirds.
    """
    valid = df.where(F.col(value).isNotNull() & (F.abs(F.col(value)) < F.lit(INF)) & (F.col(weight) >= 0))
    counts = distinct_values(valid, keys, value, F.col(weight))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total")).where("_total > 0")
    wanted = each_row(totals, [label, "_q"], [(name, float(q)) for name, q in probs])
    least = F.greatest((F.col("_q") - F.lit(tol)) * F.col("_total").cast("double"), F.lit(1e-18))
    wanted = wanted.withColumn("_k", least.cast("decimal(38,18)")).drop("_q", "_total")
    return select_ranks(counts, wanted, keys, value, "_k", out).drop("_k")


def quantile_linear(counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[tuple[object, float]],
                    label: str = "prob", out: str = "quantile") -> DataFrame:
    """Linear-interpolation (type 7) quantiles from ``distinct_values``, per key and per
    (label, probability) pair."""
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    wanted = each_row(totals, [label, "_q"], [(name, float(q)) for name, q in probs])
    span = F.col("_q") * (F.col("_total") - 1)
    wanted = wanted.withColumn("_part", span - F.floor(span)).withColumn(
        "_side", F.explode(F.array(F.struct((F.floor(span) + 1).alias("k"), F.lit(True).alias("low")), F.struct((F.ceil(span) + 1).alias("k"), F.lit(False).alias("low")))))
    wanted = wanted.select(*keys, label, "_part", F.col("_side.k").alias("_k"), F.col("_side.low").alias("_low"))
    got = select_ranks(counts, wanted, keys, value, "_k", "_v")
    a, b = (F.max(F.when(F.col("_low") == low, F.col("_v"))) for low in (True, False))
    part = F.max("_part")
    return got.groupBy(*keys, label).agg(F.when(part > 0, a + (b - a) * part).otherwise(a).alias(out))
