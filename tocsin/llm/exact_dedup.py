"""Exact deduplication with two Bloom passes.

Pass one folds the hash of every text into (word, mask) pairs: a word number of the filter
and the three bits that the hash sets in that 64-bit word. Pairs met more than once set
their bits in the filter of repeated hashes. Pass two probes that filter: rows whose bits
are not all set have a text of their own and pass straight through; only the others are
shuffled by their full SHA-256 digest. A false positive costs a shuffled row, never a
wrong result.

Defined results: null text counts as empty, so all null and empty texts form one group.
Of equal texts the row with the largest doc_id stays, null ids come last; if rows repeat
text and doc_id, one of them stays. An empty table gives no rows. Other columns of the
input are ignored by ``report`` and returned unchanged by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import fresh, lower_ascii, materialize, row_count

#: Filter words per row, and the most words a broadcast filter may have (64 bits each).
WORDS_PER_ROW = 0.25
MAX_WORDS = 1 << 20
#: Groups above 1/HOT_SHARE of all rows (at most HOT_SHARE of them) are joined by broadcast.
HOT_SHARE = 2000


def filter_words(n_rows: int) -> int:
    """Number of filter words for so many rows, within the bound of the broadcast."""
    return int(min(MAX_WORDS, max(1024, n_rows * WORDS_PER_ROW)))


def with_bits(df: DataFrame, digest: str, n_words: int, word: str, mask: str) -> DataFrame:
    """Adds the filter word and the bit mask of a digest (hex string)."""
    h = f"xxhash64({digest})"
    bits = " | ".join(f"shiftleft(1L, int(shiftrightunsigned({h}, {s}) & 63))" for s in (2, 8, 14))
    return df.withColumns({word: F.expr(f"pmod(shiftright({h}, 20), {n_words}L)"), mask: F.expr(bits)})


def repeated_filter(keyed: DataFrame, word: str, mask: str) -> DataFrame:
    """First pass: the Bloom filter of hashes met more than once, one row per filter word."""
    pairs = keyed.groupBy(word, mask).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(pairs.groupBy(word).agg(F.bit_or(mask).alias("bits")), "repeated-bits")


def probe(keyed: DataFrame, bits: DataFrame, word: str, mask: str) -> DataFrame:
    """Second pass: adds ``bits``, not null where the text may be repeated.

    The filter has at most ``MAX_WORDS`` rows whatever the input is, hence the broadcast.
    """
    hit = bits.select(F.col(word).alias("probe_word"), "bits")
    on = (keyed[word] == hit["probe_word"]) & (keyed[mask].bitwiseAND(hit["bits"]) == keyed[mask])
    return keyed.join(F.broadcast(hit), on, "left").drop("probe_word", word)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = docs.select("doc_id", F.sha2(lower_ascii(F.col("text")), 256).alias("sha"))
    keyed = materialize(keyed.withColumn("uid", F.monotonically_increasing_id()), "digests")
    n = row_count(keyed)
    marked = with_bits(keyed, "sha", filter_words(n), "word", "mask")
    probed = probe(marked, repeated_filter(marked, "word", "mask"), "word", "mask").drop("mask")
    alone = probed.where("bits is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = probed.where("bits is not null").drop("bits")
    top = F.max(F.struct("doc_id", "uid")).alias("top")
    groups = materialize(maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), top), "groups")
    limit = max(100, n // HOT_SHARE)
    hot = groups.where(F.col("n") >= limit).select(F.col("sha").alias("hot_sha"), F.col("n").alias("hot_n"), F.col("top").alias("hot_top"))
    cold = groups.where(F.col("n") < limit)
    split = maybe.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left")
    large = split.where("hot_sha is not null").select("doc_id", "uid", "sha", F.col("hot_n").alias("n"), F.col("hot_top").alias("top"))
    small = split.where("hot_sha is null").select("doc_id", "uid", "sha").join(cold, "sha")
    out = large.unionByName(small).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("top.uid")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(out)


def keep_one(docs: DataFrame, n_rows: int | None = None) -> DataFrame:
    """The documents without exact copies, all columns as they are.

    Texts of rows that the filter rules out never move; possible copies are reduced to one
    whole row per digest before and after the shuffle.
    """
    n = docs.count() if n_rows is None else n_rows
    sha, word, mask = (fresh(docs, x) for x in ("dedup_sha", "dedup_word", "dedup_mask"))
    keyed = docs.withColumn(sha, F.sha2(lower_ascii(docs["text"]), 256))
    keyed = with_bits(keyed, sha, filter_words(n), word, mask)
    bits = repeated_filter(keyed.select(word, mask), word, mask).withColumnRenamed(word, "word")
    at, row = fresh(docs, "dedup_at"), fresh(docs, "dedup_row")
    hit = F.broadcast(bits.select(F.col("word").alias(at), F.col("bits").alias(row)))
    probed = keyed.join(hit, (F.col(word) == F.col(at)) & (F.col(mask).bitwiseAND(F.col(row)) == F.col(mask)), "left")
    alone = probed.where(F.col(at).isNull()).select(*(docs[c] for c in docs.columns))
    maybe = probed.where(F.col(at).isNotNull())
    order = F.struct(docs["doc_id"].isNotNull(), docs["doc_id"])
    best = maybe.groupBy(sha).agg(F.max_by(F.struct(*(docs[c] for c in docs.columns)), order).alias(row))
    return alone.unionByName(best.select(f"{row}.*"))
