"""Ranked lexical search by dense blocked matrix products over impact tiles.

1. The terms of a block of items form a compact vocabulary; a block holds at most
   ``ITEM_BYTES`` of item text (one item at least), so the vocabulary that every task gets is
   bounded and more items mean more blocks. Documents are cut into terms once for a block: each
   row becomes its number of terms and the (term, times) pairs of the block's vocabulary, and
   that table is stored. Sums over it give N, L and every df.
2. Documents are scored in tiles. Of the vocabulary only the terms that occur in a tile of
   ``DOCS`` documents are kept, and the impacts weight * ((10^9 tf) div (1000 tf + 8 m)) stand
   in a dense float64 matrix, terms by documents. Items are a dense matrix of term counts. The
   matrix product runs over tiles of terms, cut so that the sum of the largest possible
   products stays below 2^53: then float64 holds every partial sum exactly, whatever order
   the BLAS adds in, and the partial products are added up in 64-bit integers.
3. Every tile hands on its best rows of each item: all above the k-th largest score, and of the
   rows at that score those with the smallest doc_id, so no tie is lost. The best of a task and
   of all tasks are taken in two window steps, of salted and of whole items.

Defined results: null, empty and wordless texts have no terms and are never found; an item
without terms has no rows. Rows that repeat a doc_id are ranked each, null doc_ids after all
others at the same score. Items that repeat an item_id are answered each. doc_id must be
integer. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import materialize

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 10
#: Item text of one block.
ITEM_BYTES = 1_000_000
#: Documents of a tile, and the largest sum that float64 holds exactly.
DOCS = 512
EXACT = 2**53
#: Cells of an item matrix in one product; more items are cut into tiles.
CELLS = 8_000_000
SALT = 64


def terms(text: str | None) -> list[str]:
    """Terms of a whole text; only A-Z are lower-cased."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _found(shared):
    """mapInArrow: rows to (doc_id, n terms, terms of the vocabulary, times)."""
    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                ns, keys, times, ends = [], [], [], [0]
                for text in b.column("text").to_pylist():
                    found = terms(text)
                    held = Counter(filter(None, map(vocabulary.get, found)))
                    ns.append(len(found))
                    keys.append(held.keys())
                    times.append(held.values())
                    ends.append(ends[-1] + len(held))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(x)), pa.int32())) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])
    return run


def term_tiles(bounds: np.ndarray, limit: int = EXACT) -> list[slice]:
    """Cuts of the terms so that the bounds of each tile sum up to less than ``limit``."""
    tiles, start, total = [], 0, 0
    for i, bound in enumerate(bounds.tolist()):
        if bound >= limit:
            raise OverflowError("one product alone is beyond exact float64")
        if total + bound >= limit:
            tiles.append(slice(start, i))
            start, total = i, 0
        total += bound
    return [*tiles, slice(start, len(bounds))] if len(bounds) else tiles


def exact_product(items: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """64-bit integer product of two matrices of nonnegative integers, by float64 BLAS tiles."""
    total = np.zeros((items.shape[0], impacts.shape[1]), np.int64)
    for tile in term_tiles(items.max(axis=0, initial=0) * impacts.max(axis=1, initial=0)):
        total += (items[:, tile].astype(np.float64) @ impacts[tile].astype(np.float64)).astype(np.int64)
    return total


def best_rows(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0; equal scores by ``order``, ties at the k-th are resolved."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= max(least, 1))
    else:
        places = np.flatnonzero(scores > 0)
    return places[np.lexsort((order[places], -scores[places]))[:k]]


def _tile(b: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
    """Terms that occur in a tile of documents, their impacts (terms by documents), doc_ids, null ids, order of the ids."""
    key, tf = b.column("terms").flatten().to_numpy().astype(np.int64), b.column("times").flatten().to_numpy().astype(np.int64)
    ids = b.column("doc_id")
    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    order = np.empty(len(ids), np.int64)
    order[np.lexsort((ids, null))] = np.arange(len(ids))
    column = np.repeat(np.arange(len(ids)), b.column("terms").value_lengths().to_numpy(zero_copy_only=False))
    m = 25 + 75 * b.column("n").to_numpy() * n_docs // n_terms
    used, row = np.unique(key, return_inverse=True)
    impacts = np.zeros((len(used), len(ids)), np.int64)
    impacts[row, column] = weights[key] * (1_000_000_000 * tf // (1000 * tf + 8 * m[column]))
    return used, impacts, ids, null, order


def _item_tiles(rows, columns, counts, n_items: int, used: np.ndarray, width: int):
    """Dense matrices of term counts, items by used terms, with their first item."""
    place = np.full(width, -1)
    place[used] = np.arange(len(used))
    met = place[columns] >= 0
    rows, columns, counts = rows[met], place[columns[met]], counts[met]
    step = max(1, CELLS // len(used))
    for first in range(0, n_items, step):
        here = (rows >= first) & (rows < first + step)
        dense = np.zeros((min(step, n_items - first), len(used)), np.int64)
        dense[rows[here] - first, columns[here]] = counts[here]
        yield first, dense


def _scored(shared, k: int):
    """mapInArrow: stored rows to the best (item, doc_id, score) of the task."""
    def run(batches):
        rows, columns, counts, n_items, weights, n_docs, n_terms = shared.value
        nothing = np.empty(0, np.int64)
        best = [(nothing, nothing, nothing)] * n_items  # score, doc_id, whether it is null
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                used, impacts, ids, null, order = _tile(batch.slice(at, DOCS), weights, n_docs, n_terms)
                for first, dense in _item_tiles(rows, columns, counts, n_items, used, len(weights)):
                    scores = exact_product(dense, impacts)
                    for i, top in enumerate(scores.max(axis=1).tolist(), first):
                        old = best[i]
                        if not top or len(old[0]) == k and top < old[0][-1]:
                            continue
                        line = scores[i - first]
                        places = best_rows(line, order, k)
                        score, doc, absent = (np.concatenate(x) for x in ((old[0], line[places]), (old[1], ids[places]), (old[2], null[places])))
                        keep = np.lexsort((doc, absent, -score))[:k]
                        best[i] = score[keep], doc[keep], absent[keep]
        score, doc, absent = (np.concatenate([nothing, *(x[j] for x in best)]) for j in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n_items), [len(x[0]) for x in best]), pa.int32()), pa.array(doc, pa.int64(), mask=absent.astype(bool)), pa.array(score, pa.int64())],
            names=["item", "doc_id", "score"])
    return run


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple[int, object, str]], k: int) -> DataFrame:
    """uid of the item, rank, doc_id, score for a block of items (uid, item_id, text)."""
    spark = docs.sparkSession
    bags = [Counter(terms(text)) for _, _, text in items]
    vocabulary = {t: i + 1 for i, t in enumerate(sorted(set().union(*bags)))}  # 0 would be skipped as no term
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = materialize(rows.mapInArrow(_found(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, times array<int>").where("n > 0"), "term-counts")
    n_docs, n_terms = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in stored.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for t in df:
        weights[t] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1))))
    cells = np.array([(i, vocabulary[t], n) for i, bag in enumerate(bags) for t, n in bag.items()], np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((cells[:, 0], cells[:, 1], cells[:, 2], len(items), weights, n_docs, max(n_terms, 1)))
    found = stored.where(F.size("terms") > 0).mapInArrow(_scored(shared, k), "item int, doc_id long, score long")
    partial = _top(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALT))), ["item", "part"], k).drop("rank", "part")
    names = spark.createDataFrame([(i, uid) for i, (uid, _, _) in enumerate(items)], "item int, uid long")
    return _top(partial, ["item"], k).join(F.broadcast(names), "item").select("uid", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of every item (item_id, text)."""
    stated = materialize(items.select(F.monotonically_increasing_id().alias("uid"), "item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "items")
    size = stated.agg(F.coalesce(F.sum(F.octet_length("text") + 200), F.lit(0))).first()[0]
    blocks, found = -(-size // item_bytes), []
    for block in range(blocks):
        part = stated.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block)
        chosen = [(r["uid"], r["item_id"], r["text"]) for r in part.collect()]
        if chosen:
            found.append(_search_block(docs, chosen, k))
    if not found:
        return stated.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    best = reduce(DataFrame.union, found)
    return best.join(stated.select("uid", "item_id"), "uid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
