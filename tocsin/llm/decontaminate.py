"""Benchmark decontamination with a distributed positional inverted index.

1. Document counts of all benchmark terms are taken over all documents.
2. Every window of ``WINDOW`` consecutive item words is looked up by its two rarest terms.
   The index stores the postings (term, document, position) of those terms, each with the
   words around it; one more posting per document carries its number of words.
3. The list of the rarest term and the list of the next one are shifted by their offsets in
   the item and intersected on (document, item, start). What stays is compared word by word
   to both sides: an exact phrase match if the run covers a whole window. Starts that lie a
   few words apart give the proximity matches.

Terms travel as 64-bit hashes, but a match always compares the words themselves.

Defined results: null and empty texts have no words, no hits and are not contaminated. An
item without words has no windows; an item of fewer words than a window is one window.
Every benchmark row counts as an item of its own, also if ids repeat; a null item_id joins
the digest as an empty string. Repeated documents are separate rows. Empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import broadcast_counted, drop_rows, materialize, text_hash, words

WINDOW = 13
#: Terms of the benchmark that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("iw"))
    return materialize(rows.where(F.size("iw") > 0).withColumn("item", F.monotonically_increasing_id()), "items")


def _exploded(docs: DataFrame) -> DataFrame:
    """uid, doc_id, ws (all words), pos, word; a last row with an empty word at pos = number of words."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", words(F.col("text")).alias("ws"))
    return rows.select("uid", "doc_id", "ws", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "word"))


def _rarest(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """item, o1, o2: offsets of the rarest and next term of every window that can occur."""
    last = F.greatest(F.size("iw") - window, F.lit(0))
    wins = items.select("item", "iw", F.explode(F.sequence(F.lit(0), last)).alias("s"))
    ends = F.least(F.col("s") + window, F.size("iw")) - 1
    terms = wins.select("item", "s", F.explode(F.sequence(F.col("s"), ends)).alias("o"), "iw")
    terms = terms.select("item", "s", "o", F.xxhash64(F.get("iw", F.col("o"))).alias("th"))
    known = terms.join(broadcast_counted(counts, BROADCAST_TERMS), "th", "left")
    per = known.groupBy("item", "s").agg(F.max(F.col("df").isNull()).alias("absent"), F.array_sort(F.collect_list(F.struct("df", "o"))).alias("by"))
    first, second = F.get("by", F.lit(0))["o"], F.get("by", F.lit(1))["o"]
    return per.where("not absent").select("item", first.alias("o1"), F.coalesce(second, first).alias("o2")).distinct()


def _run(ours: Column, theirs: Column) -> Column:
    """Length of the common start of two arrays."""
    same = F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(same)).otherwise(at.cast("int") - 1)


def index_postings(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """Stored index: th, uid, doc_id, pos and the words before and after, for the given terms.

    ``th`` of the empty word marks the row with the number of words of a document.
    """
    rows = _exploded(docs).withColumn("th", F.xxhash64("word"))
    start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    hits = rows.join(broadcast_counted(terms, BROADCAST_TERMS), "th")
    return materialize(hits.select(
        "th", "uid", "doc_id", "pos", F.slice("ws", start + 1, F.col("pos") - start).alias("before"),
        F.slice("ws", F.col("pos") + 1, F.lit(window)).alias("after")), "postings")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index, exact matches and proximity matches.

    Exact: uid, item, item_id, lo, hi (document words of a matched run). Proximity: uid, item,
    item_id, start, gap for documents where the two rarest terms stand in the right order but
    up to ``slack`` words off their distance in the item.
    """
    items = _items(benchmark)
    vocab = materialize(items.select(F.explode("iw").alias("w")).select(F.xxhash64("w").alias("th")).distinct(), "terms")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("w")).select(F.xxhash64("w").alias("th"))
    counts = materialize(tokens.join(broadcast_counted(vocab, BROADCAST_TERMS), "th").groupBy("th").agg(F.count(F.lit(1)).alias("df")), "term-counts")
    pairs = materialize(_rarest(items, counts, window), "rarest")
    term = lambda o: F.xxhash64(F.get("iw", F.col(o)))
    both = pairs.join(items, "item").select("item", "o1", "o2", term("o1").alias("t1"), term("o2").alias("t2"))
    both = materialize(both, "rarest-terms")
    census = F.xxhash64(F.lit(""))
    wanted = both.select(F.col("t1").alias("th")).union(both.select(F.col("t2").alias("th"))).union(docs.sparkSession.range(1).select(census.alias("th")))
    index = index_postings(docs, materialize(wanted.distinct(), "wanted"), window)
    lists = index.where(F.col("th") != census)
    small = broadcast_counted(both, BROADCAST_TERMS)
    rare = lists.join(small, lists["th"] == small["t1"]).select("uid", "pos", "before", "after", "item", "o1", "o2", (F.col("pos") - F.col("o1")).alias("start"))
    next_terms = broadcast_counted(materialize(both.select("item", "o2", "t2").distinct(), "next-terms"), BROADCAST_TERMS)
    other = lists.select("th", "uid", "pos").join(next_terms, F.col("th") == F.col("t2")).select("uid", "item", "o2", (F.col("pos") - F.col("o2")).alias("start"))
    both_lists = rare.join(other, ["uid", "item", "o2", "start"], "left_semi")
    full = both_lists.join(broadcast_counted(items), "item")
    o = F.col("o1")
    left = _run(F.reverse("before"), F.reverse(F.slice("iw", F.greatest(o - (window - 1), F.lit(0)) + 1, F.least(o, F.lit(window - 1)))))
    right = _run(F.col("after"), F.slice("iw", o + 1, F.lit(window)))
    runs = full.select("uid", "item", "item_id", "pos", F.size("iw").alias("n"), left.alias("l"), right.alias("r"))
    exact = runs.where((F.col("r") > 0) & (F.col("l") + F.col("r") >= F.least(F.col("n"), F.lit(window))))
    exact = exact.select("uid", "item", "item_id", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r") - 1).alias("hi")).distinct()
    near = rare.select("uid", "item", "o2", "pos", "o1", F.explode(F.sequence(F.col("start") - slack, F.col("start") + slack)).alias("start"))
    near = near.where(F.col("start") != F.col("pos") - F.col("o1")).join(other, ["uid", "item", "o2", "start"], "left_semi")
    near = near.join(broadcast_counted(items.select("item", "item_id")), "item").select(
        "uid", "item", "item_id", "start", (F.col("pos") - F.col("o1") - F.col("start")).alias("gap")).distinct()
    return index, exact, near


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index, exact, _ = matches(docs, benchmark, window)
    spans = F.flatten(F.collect_set(F.sequence("lo", "hi")))
    per = exact.groupBy("uid").agg(
        F.size(F.array_distinct(spans)).cast("long").alias("n_hit"), F.collect_set(F.struct("item_id", "item")).alias("found"))
    ids = F.array_join(F.array_sort(F.transform("found", lambda x: x["item_id"])), ",")
    per = per.select(F.col("uid").alias("hit_uid"), "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(ids, 256).alias("sha"))
    rows = index.where(F.col("th") == F.xxhash64(F.lit(""))).select("uid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    out = rows.join(per, F.col("uid") == F.col("hit_uid"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, all columns as they are."""
    rows = docs.select(F.struct("doc_id", text_hash(docs["text"]).alias("th")).alias("doc_id"), "text")
    return drop_rows(docs, report(rows, benchmark, window).where("contaminated").select("doc_id.*"), "contaminated")
