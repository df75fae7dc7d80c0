"""SentencePiece encoding and decoding by a table of distinct marked words.

A text becomes marked words: a run of whitespace markers and what follows up to the next run.
If no vocabulary piece holds a marker after another character, no merge crosses the start of a
marked word, so the ids of a text are the ids of its marked words one after another; ``Pieces``
proves that (and that normalisation only writes markers) before it is used.

1. Marked words are counted over all documents, summed in each task before the shuffle.
2. The most frequent ones, at most ``TABLE``, are segmented once, spread over the cluster: the
   table of distinct marked words, of bounded size, that every task gets.
3. Every text is cut again and its marked words are joined to the table by position. Words
   beyond the table are segmented once for a batch of texts and remembered by the task in a
   memo bounded in bytes, so the bound of the table only decides where a word is segmented.

Decoding joins the surface of every id by position: markers become spaces, the first marker
goes, runs of byte pieces are read as UTF-8 with one U+FFFD for each invalid byte.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated rows
are encoded each. Very long marked words are one merge problem each. Other columns are kept by
``encode`` and ``decode``, ignored by ``report``. Empty tables give no rows.
"""

from __future__ import annotations

import codecs
from array import array
from collections import Counter
from itertools import chain, filterfalse, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.llm.common import fresh, materialize

MARK = "▁"
#: Marked words in the table that every task gets; longer ones than LONGEST stay out.
TABLE = 300_000
LONGEST = 64
#: Different words that a task sums up before it hands their counts on.
BUFFER = 300_000
#: Bytes that a task's memo of other words may hold.
MEMO_BYTES = 24_000_000
#: Texts that are handled together.
TEXTS = 200


def marked_words(text: str | None) -> list[str]:
    """Pieces of the marked text, each without its first marker; they start at runs of markers."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, run = [], 0
    for at, w in enumerate(words):
        if w or at == len(words) - 1:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    return out


class Pieces:
    """A SentencePiece model; loaded and checked on first use in a process."""

    def __init__(self, path: str):
        self.path, self.model = path, None

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.__init__(state["path"])

    def load(self) -> None:
        if self.model is not None:
            return
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=self.path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain) or sum(map(model.is_byte, range(len(pieces)))) < 256:
            raise ValueError(f"{self.path}: pieces cross whitespace markers, or bytes are missing")
        probes = ["a", " a  b ", "ﬁ① é é Ａ", *(pieces[i].replace(MARK, " ") for i in plain[::97])]
        if any(model.normalize(p) != MARK + p.replace(" ", MARK) for p in probes if p):
            raise ValueError(f"{self.path}: normalisation does more than writing markers")
        surface = [""] * len(pieces)
        for i, piece in enumerate(pieces):
            if model.is_unknown(i):
                surface[i] = " ⁇ "
            elif model.is_byte(i):
                byte = int(piece[3:-1], 16)
                surface[i] = chr(byte) if byte < 0x80 else chr(0xDC00 + byte)
            elif not model.is_control(i):
                surface[i] = piece.replace(MARK, " ")
        self.surface, self.hidden = surface, {i for i in range(len(pieces)) if model.is_control(i)}
        self.marked = {i for i in plain if pieces[i].startswith(MARK)}
        guard = model.encode("a")
        self.mark_ids = np.array(model.encode("a ")[len(guard):], "<i4").tobytes()
        self.model = model

    def segment(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of marked words. The library puts the first marker itself."""
        self.load()
        ids = self.model.encode(words, num_threads=1)
        return [array("i", x).tobytes() if w else self.mark_ids for w, x in zip(words, ids, strict=True)]

    def text(self, ids: list[int]) -> str:
        """The decoded text of a list of ids."""
        self.load()
        out = "".join(map(self.surface.__getitem__, ids))
        if not out.isascii():
            try:
                out.encode("utf-8")
            except UnicodeEncodeError:  # byte pieces stand in it as lone surrogates, and control ids end their runs
                runs = ("".join(map(self.surface.__getitem__, run)) for at_control, run in groupby(ids, self.hidden.__contains__) if not at_control)
                out = "".join(run.encode("utf-8", "surrogateescape").decode("utf-8", "tocsin-each-byte") for run in runs)
        first = next((i for i in ids if i not in self.hidden), None)
        return out[1:] if first in self.marked else out


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of this process for a file."""
    codecs.register_error("tocsin-each-byte", _each_byte)
    return _MODELS.setdefault(path, Pieces(path))


def _slices(batches, rows: int = TEXTS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _count(batches):
    counts: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for b in _slices(batches):
        for text in b.column("text").to_pylist():
            counts.update(marked_words(text))
            if len(counts) > BUFFER:
                yield flush()
    yield flush()


def _segmented(path: str):
    def run(batches):
        for b in batches:
            ids = pieces(path).segment(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.binary())], names=["word", "ids"])
    return run


def word_table(texts: DataFrame, path: str, size: int = TABLE) -> DataFrame:
    """word, ids of the most frequent marked words of column ``text``, at most ``size``, each
    segmented once. A histogram of the counts gives the least count, so nothing is sorted."""
    counts = texts.select("text").mapInArrow(_count, "word string, n long").where(F.length("word") <= LONGEST)
    counts = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "marked-words")
    level = F.floor(F.log2("n") * 32).cast("int")
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 32 levels for each doubling
        total += r["count"]
        if total > size:
            break
        least = r["level"]
    top = counts.where(F.lit(False) if least is None else level >= least).select("word")
    return top.mapInArrow(_segmented(path), "word string, ids binary")


class _Lookup:
    """Ids of marked words: from the table, else segmented once and kept while the memo has room."""

    def __init__(self, path: str, table: dict[str, bytes]):
        self.model, self.table, self.known, self.held = pieces(path), table, dict(table), 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [marked_words(t) for t in texts]
        if self.held > MEMO_BYTES:
            self.known, self.held = dict(self.table), 0
        known = self.known
        new = list(filterfalse(known.__contains__, set(chain.from_iterable(cut))))
        if new:
            ids = self.model.segment(new)
            known.update(zip(new, ids, strict=True))
            self.held += 200 * len(new) + sum(map(len, ids)) + 2 * sum(map(len, new))
        return [b"".join(map(known.__getitem__, c)) for c in cut]


def _with_ids(path: str, shared, text: str, name: str):
    def run(batches):
        lookup = _Lookup(path, shared.value)  # one for a task, so it ends with it
        for b in _slices(batches):
            ids = lookup.encode(b.column(text).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, name])
    return run


def encode(docs: DataFrame, path: str, text: str = "text", size: int = TABLE) -> tuple[DataFrame, str]:
    """``docs`` with one more column of ids (array of int), and that column's name."""
    spark, name = docs.sparkSession, fresh(docs, "ids")
    rows = docs.withColumn(text, F.col(text).cast("string"))
    table = {r["word"]: bytes(r["ids"]) for r in word_table(rows.select(F.col(text).alias("text")), path, size).collect()}
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_with_ids(path, spark.sparkContext.broadcast(table), text, name), schema), name


def _with_text(path: str, ids: str, name: str):
    def run(batches):
        model = pieces(path)
        for b in _slices(batches):
            texts = [model.text(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])
    return run


def decode(rows: DataFrame, path: str, ids: str = "ids") -> tuple[DataFrame, str]:
    """``rows`` with one more column, the text of column ``ids``, and that column's name."""
    name = fresh(rows, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    return rows.mapInArrow(_with_text(path, ids, name), schema), name


def report(docs: DataFrame, path: str, size: int = TABLE) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded, ids = encode(docs.select("doc_id", "text"), path, size=size)
    both, text = decode(coded.drop("text"), path, ids)
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return both.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col(text), 256).alias("decoded_sha256"))
