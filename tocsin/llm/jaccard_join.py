"""Near duplicates by a parity-sketch join on word shingles, exact at the given threshold.

A document is the set of its distinct 64-bit shingle hashes, dealt over segments. Each shingle
is XORed into its segment twice: whole, which gives the 64-bit key of the segment, and as one
flipped bit of a parity sketch. A bit differs only if an odd number of differing shingles hit
it, so the Hamming distance of two sketches is at most the symmetric difference of the sets.
Sets of at most U shingles with Jaccard >= T differ in at most d = 2U(1-T)/(1+T) shingles;
of d+1 segments at least one is then untouched and has equal keys (pigeonhole). Sizes are cut
into bands [U/1.5, U] (short sets: pairs of sizes); a set also writes the segments of the next
band if a partner can be there. Segments of few shingles are the ones that unrelated texts
share, empty ones above all: sketches of long sets have spare segments, so that more than
``spare`` are equal, and each set leaves out the segments below such a number of shingles
that no more than ``spare`` are left out. Of two linked sets the one with the higher number
leaves out at most ``spare`` equal segments, so both keep an equal one. Equal keys meet in an
equi-join, and candidates are verified.

Documents with the same set are one class and only its first row takes part. A bucket is tested
inside: rows carry their number of shingles and a sketch folded to a quarter, blocks of about
``MEMBERS`` rows meet block by block (a large bucket is many such groups, spread over the
tasks), and only pairs of different components whose sizes and sketches allow a link leave the
task. In the first ``FORESTS`` rounds a document takes part with one bucket of each band, blocks
meet no others, and only as many pairs leave a block as join its components: a group of near copies is
joined by a number of rows and pairs like its documents. Links are contracted to components, and
buckets of one component are done. In the last round all pairs that are left leave the task, so no
link is lost; rows of the most frequent component of a large bucket only meet the others there. Verification has two steps: the Hamming distance of the
whole sketches, then the exact intersection. For that the texts are read again and each set
goes once to the task of its leader; sets are never stored.

Defined results: null, empty and blank texts have no shingles and are linked with nothing;
a text of fewer words than a shingle is one shingle. Rows that repeat id and text count as
one document. Null ids rank last; a component of null ids has a null component_id. Empty
tables give no rows. Other columns are ignored by ``report``, kept by ``keep_one_each``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import BROADCAST_ROWS, broadcast_counted, discard, drop_rows, materialize, release_memory, row_count, small_batches

SHINGLE = 3
PERCENT = 90
#: Sets up to this size have a band for each pair of sizes.
PAIRED = 33
#: Segments whose parity bits share one 64-bit word.
FOLD = 4
#: Rows of a bucket that meet in one group, and rows that are tested together.
MEMBERS = 256
CHUNK = 20_000
#: Rounds in which a document takes part with one bucket of each band, and only a forest of pairs leaves a block.
FORESTS = 2
#: Partners of one leader that are compared in one group.
PARTNERS = 200

_K = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Numbers of the bytes, the same for A and a; and the bytes between words.
_BYTES = _mix(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + _K[2])
_GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class _Powers:
    """Powers of a base modulo 2**64 and of its inverse, as many as the longest text needs."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            base = int(_K[0])
            self.up, self.down = (np.cumprod(np.full(2 * n, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))


_POWERS = _Powers()


def _release() -> None:
    """At the end of a task: gives back what the longest text needed."""
    _POWERS.up = _POWERS.down = np.empty(0, np.uint64)
    release_memory()


def word_hashes(text: str | None, gaps: np.ndarray = _GAPS) -> np.ndarray:
    """64-bit hashes of the lower-cased words, by a polynomial over the bytes of each word.

    ``gaps`` says for every byte whether it stands between words.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gaps[raw], [True]])))
    starts, ends = edges[::2], edges[1::2]
    _POWERS.reach(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _POWERS.up[:len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _POWERS.down[starts])


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes. Bytes split and lower-case at ASCII characters only."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _K[0] + h[i:len(h) - k + 1 + i] * _K[1]
    out = np.sort(_mix(out))
    return out[np.append(True, out[1:] != out[:-1])]


def bands(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(band number, segments, spare segments) under which a set of ``n`` shingles is stored.

    Short sets have a band for each pair of sizes; bands in which only equal sets can link are
    left out. Longer sets have bands [U/1.5, U] by the size of the larger set of a pair.
    """
    bad, all_ = 100 - percent, 100 + percent
    out = []
    if n <= PAIRED:
        for m in range(-(-n * percent // 100), min(PAIRED, n * 100 // percent) + 1):
            differ = (n + m) * bad // all_
            if differ:
                out.append((1000 + (PAIRED + 1) * min(n, m) + max(n, m), differ + 1, 0))
    band, upper = 0, PAIRED
    while upper < n:
        band, upper = band + 1, upper * 3 // 2
    for number, top in ((band, upper), (band + 1, upper * 3 // 2)):
        if number and (number == band or n * 100 // percent > upper):
            differ = 2 * top * bad // all_
            spare = differ // 8 + 2
            out.append((number, differ + 1 + spare, spare))
    return out


def sketch(shingles: np.ndarray, segments: int) -> np.ndarray:
    """Parity sketch: one 64-bit word for ``FOLD`` segments."""
    words = np.zeros(-(-segments // FOLD), np.uint64)
    at = (shingles >> np.uint64(6)) % np.uint64(segments) // np.uint64(FOLD)
    np.bitwise_xor.at(words, at.astype(np.int64), np.uint64(1) << (shingles & np.uint64(63)))
    return words


def segment_keys(shingles: np.ndarray, band: int, segments: int, spare: int) -> np.ndarray:
    """Keys of the segments that are kept: the XOR of their shingles, mixed with band and place."""
    at = ((shingles >> np.uint64(6)) % np.uint64(segments)).astype(np.int64)
    xor, held = np.zeros(segments, np.uint64), np.bincount(at, minlength=segments)
    np.bitwise_xor.at(xor, at, shingles)
    kept = np.flatnonzero(held >= np.partition(held, spare)[spare])
    return _mix(xor[kept] ^ _mix(kept.astype(np.uint64) * _K[1] + np.uint64(band)))


def _slices(batches, rows: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketched(percent: int, size: int):
    """mapInArrow function: adds n, the digest of the set, its sketches (band, words) and keys (band, key)."""
    def run(batches):
        for b in _slices(batches):
            ns, digests, numbers, words, ends, inner = [], [], [], [np.empty(0, np.uint64)], [0], [0]
            keys, key_ends, key_bands = [np.empty(0, np.uint64)], [0], [np.empty(0, np.int32)]
            for text in b.column("text").to_pylist():
                s = shingle_set(text, size)
                ns.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                total = key_ends[-1]
                for band, segments, spare in bands(len(s), percent):
                    numbers.append(band)
                    words.append(sketch(s, segments))
                    inner.append(inner[-1] + len(words[-1]))
                    keys.append(segment_keys(s, band, segments, spare))
                    key_bands.append(np.full(len(keys[-1]), band, np.int32))
                    total += len(keys[-1])
                ends.append(len(numbers))
                key_ends.append(total)
            lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.concatenate(words).view(np.int64)))
            pairs = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), lists], ["band", "words"])
            at = pa.StructArray.from_arrays([pa.array(np.concatenate(key_bands)), pa.array(np.concatenate(keys).view(np.int64))], ["band", "key"])
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), b.column("doc_id"), b.column("th"), pa.array(ns, pa.int64()), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.ListArray.from_arrays(pa.array(key_ends, pa.int32()), at)],
                names=["uid", "doc_id", "th", "n", "sid", "sketches", "keys"])
        _release()
    return run


def _with_sets(size: int):
    """mapInArrow function: replaces the text by its shingle set."""
    def run(batches):
        for b in _slices(batches):
            sets = [shingle_set(t, size).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("roles"), pa.array(sets, pa.binary())], names=["uid", "roles", "shingles"])
        _release()
    return run


def _linked(percent: int):
    """mapInArrow function over rows sorted by leader, the leader's own row first."""
    def run(batches):
        leader, theirs = None, None
        for b in batches:
            found = []
            for uid, lead, member, raw in zip(*(b.column(c).to_pylist() for c in ("uid", "lead", "member", "shingles")), strict=True):
                ours = np.frombuffer(raw, np.uint64)
                if not member:
                    leader, theirs = lead, ours
                elif lead == leader:
                    both = np.concatenate([ours, theirs])
                    both.sort()
                    both = int((both[1:] == both[:-1]).sum())
                    if 100 * both >= percent * (len(ours) + len(theirs) - both):
                        found.append((uid, lead))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp for all nodes of ``edges`` (a, b): comp is one node of the component.

    Every node joins its smallest neighbour, twice in a row; then edges are contracted. The
    edges at least halve their nodes in each turn, so the turns are logarithmic. Tables of few
    edges are broadcast, so that small graphs need few exchanges.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = None
    while row_count(edges):
        small = F.broadcast if 2 * row_count(edges) <= BROADCAST_ROWS else (lambda df: df)
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "parents")
        up = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        near = materialize(near.join(small(up), "p").select("a", F.col("pp").alias("p")), "grandparents")
        if nodes is None:
            nodes = near.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            moved = near.select(F.col("a").alias("comp"), "p")
            nodes = nodes.join(small(moved), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        to_a, to_b = near.select("a", F.col("p").alias("pa")), near.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(small(to_a), "a").select("b", "pa").join(small(to_b), "b").where("pa <> pb")
        edges = materialize(edges.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if nodes is None else materialize(nodes, "nodes")


def merged(comps: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components after new links (a, b): only the links between components are contracted."""
    if comps is None:
        return components(new)
    of = broadcast_counted(comps)
    a, b = of.select(F.col("node").alias("a"), F.col("comp").alias("ca")), of.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    ends = new.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = materialize(ends, "ends")
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    row_count(joined)
    fresh = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps.select("node"), "node", "left_anti")
    nodes = comps.union(fresh.select("node", F.col("node").alias("comp")))
    to = broadcast_counted(joined).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return materialize(nodes.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "nodes")


def folded(words: np.ndarray) -> np.ndarray:
    """A parity sketch of a quarter of the words, four at least; its distances only get smaller."""
    width = max(4, -(-len(words) // 4))
    out = np.zeros(width, np.uint64)
    for at in range(0, len(words), width):
        part = words[at:at + width]
        out[:len(part)] ^= part
    return out


def pairs_in_groups(group, two, block, comp, n, words, percent: int):
    """Places i, j of rows of one group (sorted) that differ in component and, where the group is
    of ``two`` blocks, in block, and whose sizes and sketches allow a link, and how far they are. ``words``: rows by words."""
    found, at = [], np.arange(len(group))
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    last = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
    shift = 1
    while len(at):
        at = at[at + shift < last[at]]
        i, j = at, at + shift
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        fits = (comp[i] != comp[j]) & (100 * small >= percent * large) & (~two[i] | (block[i] != block[j]))
        i, j = i[fits], j[fits]
        apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        found.append(np.stack([i[near], j[near], 1_000_000 * apart[near] // (n[i] + n[j])[near]]))
        shift += 1
    return np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)


def nearest_only(i, j, far, rows: int):
    """Which of the pairs are the nearest of one of their ends; of equally near ones the first."""
    keep = np.zeros(len(i), bool)
    for end in (i, j):
        order = np.lexsort((j, i, far, end))
        first = np.append(True, end[order][1:] != end[order][:-1])[:len(order)]
        keep[order[first]] = True
    return keep


def forest_only(i, j, far, group, comp):
    """Which of the pairs join the components inside each group with the fewest pairs, near ones first.

    In each turn every tree takes its nearest pair to another tree, until none is left. A tree is a component in a group.
    """
    keep = np.zeros(len(i), bool)
    _, tree = np.unique(np.stack([group, comp], axis=1), axis=0, return_inverse=True)
    tree = tree.reshape(-1)
    left = np.lexsort((j, i, far))
    while True:
        a, b = tree[i[left]], tree[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        near = nearest_only(a, b, np.arange(len(left)), len(tree))
        order, a, b = left[near], a[near], b[near]
        first = np.full(int(tree.max()) + 1, len(order))
        np.minimum.at(first, a, np.arange(len(order)))
        np.minimum.at(first, b, np.arange(len(order)))
        taken = np.unique(first[first < len(order)])
        keep[order[taken]] = True
        up = np.arange(len(first))
        x, y = a[taken], b[taken]
        while True:  # labels fall to the least of a tree
            least = np.minimum(up[x], up[y])
            before = up.copy()
            np.minimum.at(up, x, least)
            np.minimum.at(up, y, least)
            up = up[up]
            if (up == before).all():
                break
        tree = up[tree]
    return keep


def _tested(percent: int, forest: bool):
    """mapInArrow over rows sorted by group: the pairs (a, b, band) that may be linked, or a forest of them."""
    def flush(rows):
        t = pa.Table.from_batches(rows)
        key, x, y = (t.column(c).to_numpy() for c in ("key", "x", "y"))
        change = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        group = np.concatenate([[0], np.cumsum(change)])
        lists = t.column("words").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        words = np.zeros((len(key), max(4, int(lengths.max()))), np.uint64)
        flat = lists.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(key)), lengths)
        words[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        uid, band = t.column("uid").to_numpy(), t.column("band").to_numpy()
        i, j, far = pairs_in_groups(group, x != y, t.column("block").to_numpy(), t.column("comp").to_numpy(), t.column("n").to_numpy(), words, percent)
        if forest:
            keep = forest_only(i, j, far, group, t.column("comp").to_numpy())
            i, j = i[keep], j[keep]
        ends = [np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j]), band[i]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b", "band"])

    def run(batches):
        held, count = [], 0
        for batch in _slices(batches, 5_000):
            if count >= CHUNK:  # up to the end of the last whole group
                t = pa.Table.from_batches(held)
                key, x, y = (t.column(c).to_numpy() for c in ("key", "x", "y"))
                change = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
                if len(change):
                    cut = int(change[-1]) + 1
                    yield flush(t.slice(0, cut).to_batches())
                    held = t.slice(cut).to_batches()
                    count = t.num_rows - cut
            held.append(batch)
            count += batch.num_rows
        if count:
            yield flush(held)
    return run


def _folded_words():
    """mapInArrow function: folds the sketches."""
    def run(batches):
        for b in batches:
            words = [folded(np.array(w, np.int64).view(np.uint64)).view(np.int64) for w in b.column("words").to_pylist()]
            ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *words])))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("band"), b.column("n"), lists], names=["uid", "band", "n", "words"])
    return run


def _few_buckets(opened: DataFrame, turn: int) -> DataFrame:
    """Of the open rows of every document and band the one with the least hash of its key: near
    copies mostly choose the same, and no document has more rows, however many buckets it is in."""
    least = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("hash"), "key", "comp")).alias("p")
    return opened.groupBy("uid", "band").agg(least).select("p.key", "band", "uid", "p.comp")


def _bucket_pairs(opened: DataFrame, sketches: DataFrame, percent: int, turn: int, forest: bool) -> DataFrame:
    """Pairs (a, b, band) of rows in one open bucket (key, band, uid, comp) that may be linked.

    With ``forest`` a large bucket falls into blocks that do not meet, others in each turn; else
    all its rows meet, but for those of its most frequent component among themselves: their
    blocks only meet the blocks of the others.
    """
    counts = opened.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "comp")).alias("most"))
    counts = counts.where(F.col("total") > MEMBERS)
    n_blocks = lambda n: F.ceil(n / MEMBERS).cast("long")
    counts = materialize(counts.select("key", F.col("most.comp").alias("main"), n_blocks(F.col("total")).alias("blocks"),
                                       n_blocks(F.col("most.n")).alias("first"), n_blocks(F.col("total") - F.col("most.n")).alias("others")), "large-buckets")
    rows = opened.join(broadcast_counted(counts), "key", "left")
    zero, large, salt = F.lit(0).cast("long"), F.col("blocks").isNotNull(), F.xxhash64("uid", "key", F.lit(turn))
    if forest:
        block = F.when(large, F.pmod(salt, "blocks")).otherwise(zero)
        rows = rows.select("key", "band", "uid", "comp", block.alias("block"), block.alias("x"), block.alias("y"))
    else:
        inside = F.col("comp") == F.col("main")
        block = F.when(large & inside, F.pmod(salt, "first")).when(large, F.col("first") + F.pmod(salt, F.greatest("others", F.lit(1)))).otherwise(zero)
        met = F.when(large & inside, F.when(F.col("others") > 0, F.sequence("first", F.col("first") + F.col("others") - 1)))
        met = met.when(large, F.sequence(zero, F.col("first") + F.col("others") - 1)).when(~large, F.array(zero))
        rows = rows.withColumn("block", block).withColumn("other", F.explode(met))
        rows = rows.select("key", "band", "uid", "comp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    rows = rows.join(broadcast_counted(sketches, BROADCAST_ROWS // 10), ["uid", "band"])
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    pairs = rows.mapInArrow(_tested(percent, forest), "a long, b long, band int")
    found = materialize(pairs.distinct(), "candidates")
    discard(counts)
    return found


def _near_sketches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, band) whose sizes and sketches allow a link."""
    left = sketches.select(F.col("uid").alias("a"), "band", F.col("n").alias("na"), F.col("words").alias("wa"))
    right = sketches.select(F.col("uid").alias("b"), "band", F.col("n").alias("nb"), F.col("words").alias("wb"))
    ends = pairs.select("b", "band").distinct()  # no more rows than pairs
    few = row_count(pairs) <= BROADCAST_ROWS
    left = left.join(broadcast_counted(pairs), ["a", "band"])
    right = right.join(F.broadcast(ends) if few else ends, ["b", "band"])
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    near = apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return left.join(right, ["b", "band"]).where(fits & near).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) that are links. A leader b with many partners goes to several tasks."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    salted = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    role = lambda member: F.struct(F.col("b").alias("lead"), F.col("part").cast("long").alias("part"), F.lit(member).alias("member"))
    members = salted.select(F.col("a").alias("uid"), role(True).alias("role"))
    leaders = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("b").alias("uid"), role(False).alias("role"))
    roles = members.union(leaders).groupBy("uid").agg(F.collect_list("role").alias("roles"))
    places = classes.select(F.col("rep").alias("uid"), F.col("top.doc_id").alias("at_id"), F.col("top.th").alias("at_th"))
    roles = roles.join(places, "uid")
    if 2 * row_count(pairs) <= BROADCAST_ROWS:  # no more roles than two for each pair
        roles = F.broadcast(roles)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    texts = texts.join(roles, F.col("doc_id").cast("long").eqNullSafe(F.col("at_id")) & (F.col("th") == F.col("at_th"))).select("uid", "roles", "text")
    sets = texts.mapInArrow(_with_sets(size), "uid long, roles array<struct<lead:long,part:long,member:boolean>>, shingles binary")
    rows = sets.select("uid", F.explode("roles").alias("r"), "shingles").select("uid", "r.*", "shingles")
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "member")
    with small_batches(docs.sparkSession, 500):
        return materialize(rows.mapInArrow(_linked(percent), "a long, b long"), "links")


def _open_buckets(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """key, band, uid, comp of the buckets with a row outside the component of their leader."""
    if comps is None:
        return buckets.withColumn("comp", F.col("uid")).drop("lead")
    comps = broadcast_counted(comps)
    marked = buckets.join(comps.select(F.col("node").alias("uid"), F.col("comp").alias("c")), "uid", "left")
    marked = marked.join(comps.select(F.col("node").alias("lead"), F.col("comp").alias("d")), "lead", "left")
    marked = marked.select("key", "band", "uid", F.coalesce("c", "uid").alias("comp"), F.coalesce("d", "lead").alias("with"))
    mixed = materialize(marked.where(F.col("comp") != F.col("with")).select("key").distinct(), "mixed")
    opened = materialize(marked.drop("with").join(broadcast_counted(mixed), "key"), "open")
    discard(mixed)
    return opened


def links(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents (uid, doc_id, th, n, sid), classes (sid, rep, size, top), component of linked classes.

    Components are None if nothing is linked.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("uid", "doc_id", F.xxhash64("text").alias("th"), "text")
    with small_batches(docs.sparkSession):
        keyed = materialize(rows.mapInArrow(_sketched(percent, size), "uid long, doc_id long, th long, n long, sid string, sketches array<struct<band:int,words:array<long>>>, keys array<struct<band:int,key:long>>"), "sketches")
    top = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "th")).alias("top")
    classes = materialize(keyed.where("n > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("size"), top).withColumn("rep", F.col("top.uid")), "classes")
    reps = classes.select(F.col("rep").alias("uid"))
    sketches = keyed.select("uid", "n", F.explode("sketches").alias("s")).select("uid", "n", "s.band", "s.words")
    copies = materialize(keyed.where("n > 0").join(reps, "uid", "left_anti").select("uid"), "copies")
    segments = keyed.select("uid", "keys").join(broadcast_counted(copies), "uid", "left_anti").select("uid", F.explode("keys").alias("k")).select("uid", "k.band", "k.key")
    shared = segments.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("uid").alias("lead")).where("m > 1").select("key", "lead")
    shared = materialize(shared, "shared")
    buckets = materialize(segments.join(shared.hint("merge"), "key"), "buckets")  # the same way at every size
    discard(shared)

    members = materialize(buckets.select("uid", "band").distinct(), "members")
    small = materialize(sketches.join(broadcast_counted(members), ["uid", "band"]).mapInArrow(_folded_words(), "uid long, band int, n long, words array<long>"), "folded")
    comps = None
    for turn in range(FORESTS + 1 if row_count(buckets) else 0):
        opened = _open_buckets(buckets, comps)
        if comps is not None and not row_count(opened):
            break
        forest = turn < FORESTS
        few = materialize(_few_buckets(opened, turn), "few-buckets") if forest else None
        pairs = _bucket_pairs(few if forest else opened, small, percent, turn, forest)
        near = materialize(_near_sketches(pairs, sketches, percent), "near") if row_count(pairs) else pairs
        if row_count(near):
            new = _verified(docs, near, classes, percent, size)
            comps = merged(comps, new) if row_count(new) else comps
            discard(new)
        discard(opened, few, pairs, near)
    discard(buckets, members, small)
    return keyed, classes, comps


def grouped(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept (smallest doc_id of its component)."""
    keyed, classes, comps = links(docs, percent, size)
    if comps is None:
        tops = classes.where("size > 1").select("sid", "top")
    else:
        joined = classes.join(comps, F.col("rep") == F.col("node"), "left").select("sid", "size", "top", F.coalesce("comp", "rep").alias("comp"), F.col("comp").isNotNull().alias("linked"))
        joined = materialize(joined.where("linked or size > 1"), "joined")
        per = materialize(joined.groupBy("comp").agg(F.min("top").alias("least")), "component-tops")
        tops = joined.join(per, "comp").select("sid", F.col("least").alias("top"))
    tops = materialize(tops.select("sid", F.col("top.doc_id").alias("first_id"), F.col("top.uid").alias("first_uid")), "tops")
    out = keyed.select("uid", "doc_id", "th", "n", "sid").join(tops, "sid", "left")
    alone = F.col("first_uid").isNull()
    return out.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("kept"), "uid", "first_uid")


def report(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return grouped(docs, percent, size).select("doc_id", "n_shingles", "component_id")


def keep_one_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The documents without near copies: of each component the smallest doc_id stays."""
    return drop_rows(docs, grouped(docs, percent, size).where("not kept").select("doc_id", "th"), "near-copies")
