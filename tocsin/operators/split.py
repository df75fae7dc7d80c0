"""Hashed splits, samples and nested prefixes of episodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.exprs import hash_key
from tocsin.functions.tables import each, each_row, values
from tocsin.operators.ranking import null_safe_join, hash_rank
from tocsin.session import broadcast_if_small, materialize


def rounded_counts(sizes: DataFrame, proportions: Mapping[str, float], keys: Sequence[str],
                   n: str = "n") -> DataFrame:
    """Largest-remainder allocation of n to the parts, per key.

    Adds (part, position, part_size, upto): ``upto`` is the cumulative size.
    """
    if abs(sum(proportions.values()) - 1.0) > 1e-8:
        raise ValueError("split proportions must sum to one")
    keys = list(keys)
    parts = [(name, i, float(v)) for i, (name, v) in enumerate(proportions.items())]
    raw = F.col("share") * F.col(n)
    rows = each_row(sizes.select(*keys, n), ["part", "position", "share"], parts).withColumn("_base", F.floor(raw)).withColumn("_frac", raw - F.floor(raw))
    whole = Window.partitionBy(*keys)
    left = F.col(n) - F.sum("_base").over(whole)
    by_fraction = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_frac"), "position"))
    rows = rows.withColumn("part_size", F.col("_base") + F.when(by_fraction <= left, 1).otherwise(0))
    upto = F.sum("part_size").over(Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).drop("_base", "_frac", "share")


def stratified_split(episodes: DataFrame, proportions: Mapping[str, float], seed: int,
                     stream: Column | str = "split", strata: Sequence[str] = ("site", "event"),
                     extra: Sequence[str] = ()) -> DataFrame:
    """Assign every episode to one part, stratum by stratum, in hashed order.

    ``extra`` key columns (for example a partition number) make independent splits in
    one job; they belong in ``stream`` as well.
    """
    groups = [*extra, *strata]
    keyed = episodes.withColumn("_key", hash_key(seed, stream, F.col("episode_id")))
    last = last_members(keyed, proportions, groups)
    bounds = last.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("position", "part", "_last_key", "_last_id"))).alias("_parts"))
    key, name = F.col("_key"), F.col("episode_id")
    hit = F.element_at(F.filter("_parts", lambda b: (b["_last_key"] > key) | ((b["_last_key"] == key) & (b["_last_id"] >= name))), 1)
    return (null_safe_join(keyed, broadcast_if_small(bounds, last), groups).withColumn("split", hit["part"])
            .drop("_key", "_parts"))


def last_members(keyed: DataFrame, proportions: Mapping[str, float], groups: Sequence[str], digits: int = 3) -> DataFrame:
    """Written table (groups, position, part, _last_key, _last_id): the last episode of every part that
    is not empty, in the order of ``_key``.

    Bucket counts tell in which bucket a part ends, so only these buckets are ranked.
    """
    groups = list(groups)
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    counts = materialize(keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n")), "bucket-counts")
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    offsets = counts.withColumn("_before", upto - F.col("_n"))
    parts = rounded_counts(counts.groupBy(*groups).agg(F.sum("_n").alias("_size")), proportions, groups, "_size").where("part_size > 0")
    ends = null_safe_join(offsets, parts, groups).where("upto > _before and upto <= _before + _n")
    ends = materialize(ends.select(*groups, "_bucket", "position", "part", (F.col("upto") - F.col("_before")).alias("_rest")), "part-ends")
    rows = null_safe_join(keyed.select(*groups, "_bucket", "_key", "episode_id"), broadcast_if_small(ends.select(*groups, "_bucket").distinct(), ends), [*groups, "_bucket"])
    ranked = rows.withColumn("_rest", F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_key", "episode_id")))
    found = null_safe_join(ranked, broadcast_if_small(ends, ends), [*groups, "_bucket", "_rest"])
    return materialize(found.select(*groups, "position", "part", F.col("_key").alias("_last_key"), F.col("episode_id").alias("_last_id")), "part-last")


def validate_split(split: DataFrame, episodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per check with its number of violations: overlap, missing ids, and
    parts without both event classes."""
    dup = split.groupBy("episode_id").count().where("count > 1").agg(F.count("*").alias("violations"))
    ids = episodes.select("episode_id").distinct()
    placed = split.select("episode_id").distinct()
    lost = ids.join(placed, "episode_id", "left_anti").unionByName(placed.join(ids, "episode_id", "left_anti"))
    wanted = values(split.sparkSession, ["split"], [(n,) for n in names])
    classes = split.groupBy("split").agg(F.count_distinct("event").alias("c"))
    bad = wanted.join(classes, "split", "left").where("coalesce(c, 0) < 2")
    named = lambda df, name: df.select(F.lit(name).alias("check"), "violations")
    return (named(dup, "episode_overlap")
            .unionByName(named(lost.agg(F.count("*").alias("violations")), "union_differs"))
            .unionByName(named(bad.agg(F.count("*").alias("violations")), "class_missing")))


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "site", "event").agg(F.count("*").alias("n"))


def non_event_order(reservoir: DataFrame, seed: int, stream: Column | str = "reservoir",
                    keys: Sequence[str] = ("site",), first: int | None = None) -> DataFrame:
    """Non-event episodes in a fixed hashed order per key: adds ``position`` (1-based)
    and ``available``. ``first`` asks for the first positions alone."""
    return hash_rank(reservoir.where(~F.col("event")), keys, "episode_id", seed, stream, "position", "available", first=first)


def nested_prefixes(ordered: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Repeat each episode for every prefix size that holds it (column target_m0), so
    that smaller prefixes are contained in larger ones."""
    table = F.array(*[F.lit(int(s)) for s in sorted(set(sizes))])
    return ordered.withColumn("target_m0", F.explode(F.filter(table, lambda s: s >= F.col("position"))))


def prefix_shortfalls(ordered: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ("site",)) -> DataFrame:
    """Keys whose reservoir is smaller than a requested prefix."""
    pools = ordered.groupBy(*keys).agg(F.count("*").alias("available"))
    return each(pools, "target_m0", [int(s) for s in sorted(set(sizes))]).where("available < target_m0")


def sample_per_class(episodes: DataFrame, n: int, seed: int, strata: Sequence[str] = ("site", "event"),
                     stream: str = "sample") -> DataFrame:
    """A hashed sample of at most n episodes per stratum."""
    return hash_rank(episodes, strata, "episode_id", seed, stream, "_rank", "_n").where(F.col("_rank") <= n).drop("_rank", "_n")


def sample_fraction(episodes: DataFrame, fraction: float, seed: int, strata: Sequence[str] = ("site",),
                    stream: str = "excluded") -> DataFrame:
    """A hashed sample of floor(fraction * n + 0.5) episodes per stratum."""
    ranked = hash_rank(episodes, strata, "episode_id", seed, stream, "_rank", "_n")
    return ranked.where(F.col("_rank") <= F.floor(F.col("_n") * F.lit(fraction) + F.lit(0.5))).drop("_rank", "_n")


def acceptance(candidates: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Candidates, kept non-events and the acceptance rate."""
    kept = F.count(F.when(~F.col("event"), 1))
    return candidates.groupBy(*keys).agg(
        F.count("*").alias("candidates"), kept.alias("kept"), (kept / F.count("*")).alias("acceptance_rate"))
