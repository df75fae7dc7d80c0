"""Stupid-backoff language-model scores from n-gram count tables.

A word and a pair of neighbouring words are 63-bit hash codes with one more bit that tells them
apart; the vocabulary is not bounded and no n-gram is left out.

1. One pass counts the codes of all documents, summed in each task before the shuffle. The count
   table is partitioned by hash; codes that were met once are not stored, as a code of a text
   that is not in the table was met once.
2. The most frequent words and pairs, at most ``HOT_WORDS`` and ``HOT_PAIRS``, go to every task
   as sorted arrays. What a text holds of them is summed where the text is read, so a frequent n-gram
   meets no single task.
3. The other distinct n-grams of every document are exploded and joined to the count table by
   hash. Logarithms are integers of 1e-8 and summed per document, so order does not matter.
   A pair that is seen and holds a rare word waits for the word's count in a second, small join.

Score of a word after another: count(both) / count(first) if another document holds the pair
(its count is above that in the document itself), else ``BACKOFF`` times the share of the word
among all words. The first word of a text takes its share alone.

Defined results: null, empty and wordless texts have no words, a score of 0 and a null mean.
Repeated rows are scored each and count each, and are other documents to each other. Extra
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import materialize, small_batches
from tocsin.llm.jaccard_join import word_hashes

BACKOFF = 0.4
#: Words and pairs that every task gets at most, as 16 bytes each.
HOT_WORDS, HOT_PAIRS = 500_000, 2_500_000
#: Codes that a task sums up before it hands them on.
BUFFER_CODES = 4_000_000
SCALE = 100_000_000

#: Bytes between words: all of ASCII but letters and digits.
_GAPS = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def codes_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of a text and of its pairs of neighbours."""
    h = word_hashes(text, _GAPS)
    pairs = h[:-1] * _ODD
    pairs = (pairs ^ (pairs >> np.uint64(29))) + h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(32))) * _ODD
    return (h << _ONE).view(np.int64), ((pairs << _ONE) | _ONE).view(np.int64)


def logs(n: np.ndarray) -> np.ndarray:
    """Natural logarithms as integers of 1e-8."""
    return np.rint(np.log(n) * SCALE).astype(np.int64)


def _slices(batches, rows: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _counted(batches):
    """mapInArrow: (code, n) of words and pairs; code 0 has the number of words."""
    kept, size, words = [], 0, 0

    def flush():
        code, n = np.unique(np.concatenate(kept) if kept else np.empty(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    for b in _slices(batches):
        for text in b.column("text").to_pylist():
            single, pairs = codes_of(text)
            kept += [single, pairs]
            words += len(single)
            size += len(single) + len(pairs)
            if size > BUFFER_CODES:
                yield flush()
                kept, size = [], 0
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([words])], names=["code", "n"])


def _lookup(codes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(which codes are in the table, their values there or 0)."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    met = keys[at] == codes
    return met, np.where(met, values[at], 0)


#: An entry keeps its base in the low bits of one number, moved above zero, and how often it stands in
#: the text above: most rows then differ in the low four bytes alone, which compresses best.
BASE_BITS = 36


def pack(base: np.ndarray, times: np.ndarray) -> np.ndarray:
    return (times << BASE_BITS) + base + (1 << BASE_BITS - 1)


def unpacked(packed: str) -> tuple[Column, Column]:
    """(base, times) of entries."""
    return F.col(packed).bitwiseAND(F.lit((1 << BASE_BITS) - 1)) - (1 << BASE_BITS - 1), F.shiftright(packed, BASE_BITS)


def _scored(shared):
    """mapInArrow: documents to their sums over frequent n-grams, and the entries that are still open.

    An open word has its code and times; an open pair also a base, what is known of its term
    besides the logarithm of its count, and the codes ``a``, ``b`` of its words if one of them is
    not frequent (0 for the other). Rows are narrow, as most of what is shuffled are these.
    """
    def run(batches):
        words, pairs, constant = shared.value
        counts = pairs[0], pairs[1]
        for batch in _slices(batches, 200):
            heads, entries, ends = [], [[np.empty(0, np.int64)] * 4], [0]
            for text in batch.column("text").to_pylist():
                single, double = codes_of(text)
                known, value = _lookup(single, words)
                total = int(value.sum())
                code, times = np.unique(single[~known], return_counts=True)
                nothing = np.zeros(len(code), np.int64)
                entries.append([code, pack(nothing, times), nothing, nothing])
                code, first, times = np.unique(double, return_index=True, return_counts=True)
                ka, kb, va, vb = known[first], known[first + 1], value[first], value[first + 1]
                base = constant - va - vb
                hot, n = _lookup(code, counts)
                ready = hot & ka & kb
                seen = ready & (n > times)
                total += int(((logs(np.maximum(n, 1)) + base) * times)[seen].sum())
                heads.append((len(single), total, int(times[seen].sum())))
                rest = ~ready
                entries.append([code[rest], pack(base[rest], times[rest]), np.where(ka, 0, single[first])[rest], np.where(kb, 0, single[first + 1])[rest]])
                ends.append(ends[-1] + len(entries[-2][0]) + len(entries[-1][0]))
            code, packed, a, b = (np.concatenate([e[i] for e in entries]) for i in range(4))
            rare = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"], mask=pa.array((a == 0) & (b == 0)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(code), pa.array(packed), rare], ["code", "packed", "rare"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), *(pa.array([h[i] for h in heads], pa.int64()) for i in range(3)), lists],
                names=["uid", "doc_id", "n_words", "total", "seen", "entries"])
    return run


def _frequent(counts: DataFrame, pairs: bool, size: int) -> tuple[np.ndarray, np.ndarray, Column]:
    """(sorted codes, counts, condition) of the most frequent words or pairs, at most ``size``."""
    kind = (F.col("code").bitwiseAND(F.lit(1)) == int(pairs)) & (F.col("code") != 0)
    level = F.floor(F.log2("n") * 32).cast("int")
    least, total = None, 0
    for r in counts.where(kind).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 32 levels for each doubling
        total += r["count"]
        if total > size:
            break
        least = r["level"]
    chosen = kind & (F.lit(False) if least is None else level >= least)
    got = counts.where(chosen).select("code", "n").toArrow()
    code, n = got.column("code").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(code)
    return code[order], n[order], chosen


def _log(n: Column) -> Column:
    return F.rint(F.log(n) * SCALE).cast("long")


def report(docs: DataFrame, hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_words, n_backoff, score (sum of logs), mean_score."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        counts = rows.select("text").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        counts = materialize(counts.where("n > 1 or code = 0"), "ngram-counts")
        n_words = counts.where("code = 0").agg(F.max("n")).first()[0] or 0
        words, word_n, frequent = _frequent(counts, False, hot_words)
        pairs, pair_n, _ = _frequent(counts, True, hot_pairs)
        log_all, log_back = (int(round(math.log(x) * SCALE)) if x else 0 for x in (n_words, BACKOFF))
        shared = spark.sparkContext.broadcast(((words, logs(word_n)), (pairs, pair_n), log_all - log_back))
        entry = "struct<code:long,packed:long,rare:struct<a:long,b:long>>"
        per = rows.mapInArrow(_scored(shared), f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, total long, seen long, entries array<{entry}>")
        # the row of a document itself has the code 0, which no table holds
        head = F.lit(None).cast(entry)
        flat = per.select("uid", F.posexplode(F.concat(F.array(head), "entries")).alias("place", "e"), F.struct("doc_id", "n_words", "total", "seen").alias("doc"))
        flat = flat.select("uid", F.coalesce("e.code", F.lit(0).cast("long")).alias("code"), "e.packed", "e.rare", F.when(F.col("place") == 0, F.col("doc")).alias("doc"))
        open_counts = counts.where((F.col("code") != 0) & ~F.coalesce(frequent, F.lit(False))).select("code", "n")
        joined = flat.join(open_counts, "code", "left")
        base, times = unpacked("packed")
        is_pair = F.col("code").bitwiseAND(F.lit(1)) == 1
        met = is_pair & (F.col("n") > times)
        own = F.when(is_pair, F.when(met, (_log(F.col("n")) + base) * times)).otherwise(_log(F.col("n")) * times)
        waits = lambda c: F.when(met, F.nullif(F.col("rare")[c], F.lit(0).cast("long"))).alias(c)
        sums = joined.select(
            "uid", waits("a"), waits("b"), "doc.doc_id", "doc.n_words", times.alias("times"), F.coalesce(F.col("doc.total"), own, F.lit(0)).alias("total"),
            F.coalesce(F.col("doc.seen"), F.when(met, times), F.lit(0)).alias("seen"))
        sums = sums.groupBy("uid", "a", "b").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("total").alias("total"), F.sum("seen").alias("seen"), F.sum("times").alias("times"))
        sums = materialize(sums, "ngram-sums")
    late = sums.where("a is not null or b is not null")
    for c in ("a", "b"):  # words that were met once have the logarithm 0
        known = counts.where(F.col("code").bitwiseAND(F.lit(1)) == 0).select(F.col("code").alias(c), _log(F.col("n")).alias(f"log_{c}"))
        late = late.join(known, c, "left")
    late = late.select("uid", "doc_id", "n_words", (F.col("total") - (F.coalesce("log_a", F.lit(0)) + F.coalesce("log_b", F.lit(0))) * F.col("times")).alias("total"), "seen")
    done = sums.where("a is null and b is null").select("uid", "doc_id", "n_words", "total", "seen").unionByName(late)
    out = done.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    # of n words the first takes its share, n - 1 are backed off unless their pair was seen
    score = (F.col("total") - F.col("n_words") * log_all + F.greatest(F.col("n_words") - 1, F.lit(0)) * log_back) / SCALE
    return out.select(
        "doc_id", "n_words", (F.greatest(F.col("n_words") - 1, F.lit(0)) - F.col("seen")).cast("long").alias("n_backoff"),
        F.round(score, 6).alias("score"), F.round(score / F.nullif("n_words", F.lit(0)), 6).alias("mean_score"))

