"""Multinomial draws that are made where the episodes lie.

A stratum of n episodes is cut into buckets of ``SLOTS`` neighbouring positions. A replicate
draws n positions with replacement; how many of them fall into a bucket is settled on a binary
tree over the buckets: the draws of a node are divided between its halves by a binomial, found
by inversion from a uniform that is hashed from (replicate, stratum, node). A task walks only
the path to its own buckets, so the counts of all buckets add up to n exactly although no task
knows the others, and nothing about draws is exchanged. Inside a bucket every draw picks its
position by a 64-bit mix of a hashed key and its number.

The result depends on positions and the seed alone, not on partitions or task order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Positions of one bucket.
SLOTS = 1024

# Increment and multipliers of the 64-bit mix.
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def key60(*parts: object) -> int:
    """First 60 bits of the md5 of the parts, joined by ``|``."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def binomial(trials: np.ndarray, share: float, uniform: np.ndarray) -> np.ndarray:
    """Binomial(trials, share) for each uniform, by inversion in the order mode, mode + 1, mode - 1, ...

    Starting at the mode takes a number of steps like the standard deviation, not like the mean.
    """
    trials = trials.astype(np.int64)
    mode = np.floor((trials + 1) * share).astype(np.int64)
    mode = np.minimum(mode, trials)
    log = math.log(share), math.log1p(-share)
    top = [math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * log[0] + (m - k) * log[1]
           for m, k in zip(trials.tolist(), mode.tolist())]
    up = np.exp(np.array(top))
    down, left, out = up.copy(), uniform - up, mode.copy()
    at = np.flatnonzero(left >= 0)
    odds, step = share / (1 - share), 0
    while len(at):
        step += 1
        m, high, low = trials[at], mode[at] + step, mode[at] - step
        up[at] = np.where(high <= m, up[at] * (m - high + 1) / high * odds, 0.0)
        down[at] = np.where(low >= 0, down[at] * (low + 1) / (m - low) / odds, 0.0)
        for value, mass in ((high, up), (low, down)):
            hit = (left[at] >= 0) & (left[at] < mass[at])
            out[at[hit]] = value[hit]
            left[at] -= mass[at]
        # beyond both ends only rounding is left, and the mode stays
        at = at[(left[at] >= 0) & ((high <= m) | (low >= 0))]
    return out


class Splitter:
    """Draws that fall into each bucket of one stratum, for all replicates at once."""

    def __init__(self, stratum: str, size: int, replicates: int, seed: int, slots: int = SLOTS):
        self.stratum, self.size, self.replicates, self.seed, self.slots = stratum, size, replicates, seed, slots
        self.path: dict[tuple[int, int], np.ndarray] = {}

    def _positions(self, low: int, high: int) -> int:
        return min(high * self.slots, self.size) - low * self.slots

    def counts(self, bucket: int) -> np.ndarray:
        low, high = 0, -(-self.size // self.slots)
        draws = np.full(self.replicates, self.size, np.int64)
        path = {}
        while high - low > 1:
            middle = (low + high) // 2
            left = self.path.get((low, high))
            if left is None:
                uniform = np.array([key60(self.seed, "split", r, self.stratum, low, high) for r in range(self.replicates)]) / 2.0**60
                left = binomial(draws, self._positions(low, middle) / self._positions(low, high), uniform)
            path[low, high] = left
            if bucket < middle:
                draws, high = left, middle
            else:
                draws, low = draws - left, middle
        self.path = path  # buckets come in order, so the next one shares most of it
        return draws

    def multiplicities(self, bucket: int) -> np.ndarray:
        """Replicates by positions of the bucket: how often each position is drawn."""
        counts, size = self.counts(bucket), self._positions(bucket, bucket + 1)
        keys = np.array([key60(self.seed, "boot", r, self.stratum, bucket) for r in range(self.replicates)], np.uint64)
        replicate = np.repeat(np.arange(self.replicates), counts)
        number = np.arange(len(replicate)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        place = (mixed(keys[replicate] + number.astype(np.uint64) * _STEP) % np.uint64(size)).astype(np.int64)
        return np.bincount(replicate * size + place, minlength=self.replicates * size).reshape(self.replicates, size)


def _runs(batches) -> Iterator[pa.Table]:
    """Rows of one (stratum, bucket) at a time, from batches sorted by them."""
    held, key = [], None
    for batch in batches:
        keys = list(zip(batch.column("stratum").to_pylist(), batch.column("bucket").to_pylist()))
        start = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, start = [], k, i
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _drawn(batches, replicates: int, seed: int, slots: int) -> Iterator[tuple[pa.Table, str, np.ndarray]]:
    """(rows, stratum, multiplicities of these rows: replicates by rows) of every bucket."""
    split = None
    for rows in _runs(batches):
        stratum, bucket, size = (rows.column(c)[0].as_py() for c in ("stratum", "bucket", "stratum_size"))
        if split is None or split.stratum != stratum:
            split = Splitter(stratum, size, replicates, seed, slots)
        yield rows, stratum, split.multiplicities(bucket)[:, rows.column("slot").to_numpy()]


def with_draws(replicates: int, seed: int, slots: int):
    """mapInArrow function: adds ``draws``, the replicates that drew each row and how often."""
    def run(batches):
        for rows, _, times in _drawn(batches, replicates, seed, slots):
            row, replicate = np.nonzero(times.T)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=times.shape[1]))])
            pairs = pa.StructArray.from_arrays(
                [pa.array(replicate.astype(np.int32)), pa.array(times[replicate, row].astype(np.int64))], ["bootstrap", "multiplicity"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)
            yield from rows.append_column("draws", pa.chunked_array([lists])).combine_chunks().to_batches(max_chunksize=64)
    return run


def weighted_sums(replicates: int, seed: int, slots: int):
    """mapInArrow function: sums of the sparse ``features`` (f, x) weighted by the draws of every
    replicate, one matrix product per bucket; one row per stratum and feature of the task."""
    def run(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for rows, stratum, times in _drawn(batches, replicates, seed, slots):
            lists = rows.column("features").combine_chunks()
            pairs = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            used, column = np.unique(pairs.field("f").to_numpy(), return_inverse=True)
            dense = np.zeros((len(lists), len(used)))
            np.add.at(dense, (row, column), pairs.field("x").to_numpy())
            for feature, sums in zip(used.tolist(), (times.astype(np.float64) @ dense).T):
                at = (stratum, feature)
                totals[at] = totals[at] + sums if at in totals else sums
        for at in sorted(totals):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([totals[at]], pa.list_(pa.float64()))], names=["stratum", "feature", "sums"])
    return run
