"""Best-fit packing of tokenized documents after a dominance reduction.

Documents become pieces of at most ``CAPACITY`` tokens; only longer documents are cut. How
pieces share sequences depends on their lengths alone, so the plan is made from the number
of pieces of each length: at most ``CAPACITY`` rows, however many documents there are.

1. Reduction after Martello and Toth: from the longest length down, a set of pieces is fixed
   for good where it dominates every other set with that piece: alone if nothing fits beside
   it; with the exact complement; with the longest partner if no two pieces fit beside it, or
   if three do not and the longest partner is at least as long as any two that do.
2. The rest is packed best fit from the longest length down, all pieces of a length at a time.

The plan is a list of runs (length, first rank, first sequence, pieces per sequence, offset).
Pieces get their rank within their length by counts of hashed blocks, so that a length that
many documents have is spread over tasks, and look their run up.

Defined results: null text counts as empty and gives the one piece of its end token. Repeated
rows and ids are packed as separate pieces. Empty tables give no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tocsin.llm.common import materialize, release_memory, small_batches

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked in one block.
BLOCK = 2000
#: Words and chunks that a task remembers, about 200 bytes each.
CACHE = 250_000

#: Letters that no normal form changes and whose lower case is one letter, then marks that are cut off.
_PLAIN = "^[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+$"
_MARKS = ".,;:!?$%&*#"


def listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordTokenizer:
    """Token ids of whole texts by a tokenizer that drops white space.

    A text is cut at blanks and line feeds, which such a tokenizer never joins across; every
    chunk is encoded once and remembered. A chunk of plain letters and trailing marks is two
    pre-tokens, remembered apart. New words of plain letters, each one pre-token that is lower-cased
    and normal already, go to the model together and are cut after the tokens that end a word.
    What was met in neither of the last two generations of half a ``CACHE`` is forgotten.
    """

    def __init__(self, path: str):
        self.path, self.chunks, self.older, self.tokenizer = path, {}, {}, None

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.__init__(state["path"])

    def _load(self):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(self.path), Tokenizer.from_file(self.path)
        as_model = lambda c: "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
        self.letters = [(c, as_model(c)) for c in map(chr, range(0xDF, 0x100)) if c.isalpha()]
        if any(c in stands_for for c, _ in self.letters for d, stands_for in self.letters if c != d):
            raise ValueError(f"{self.path}: letters stand for each other")
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def forget(self) -> None:
        self.chunks, self.older = {}, {}

    def _encode_words(self, words: list[str]) -> None:
        text = " ".join(words)
        if not text.isascii():
            for letter, stands_for in self.letters:
                text = text.replace(letter, stands_for)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            raise ValueError(f"{len(words)} words but {len(cuts)} ends of words")
        self.chunks.update(zip(words, map(ids.tobytes().__getitem__, map(slice, [0, *cuts], cuts))))

    def _encode_each(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.chunks[c] = np.array(e.ids, np.uint32).tobytes()

    def _codes(self, names: list[str], learn) -> list[bytes]:
        """Ids of different ``names``. What only the older generation has moves on; what is not
        remembered goes to ``learn``, which puts it into ``chunks``."""
        chunks, older = self.chunks, self.older
        codes = list(map(chunks.get, names))
        at = [i for i, k in enumerate(codes) if k is None]
        if at:
            unknown = new = [names[i] for i in at]
            back = [c for c in unknown if c in older]
            if back:
                chunks.update(zip(back, map(older.__getitem__, back)))
                new = [c for c in unknown if c not in older]
            if new:
                learn(new)
            for i, k in zip(at, map(chunks.__getitem__, unknown)):
                codes[i] = k
        return codes

    def learn(self, new: list[str]) -> None:
        names = pa.array(new, pa.string())
        bare = pc.ascii_rtrim(names, _MARKS)
        plain = pc.match_substring_regex(bare, _PLAIN)
        others = listed(names.filter(pc.invert(plain)))
        self._codes(others, self._encode_each)
        names, bare = names.filter(plain), bare.filter(plain)
        lower = pc.utf8_lower(bare)
        words = lower.dictionary_encode()
        codes = self._codes(listed(words.dictionary), self._encode_words)
        more = pc.not_equal(names, lower)  # the others are such a word themselves
        sizes = pc.subtract(pc.binary_length(names), pc.binary_length(bare)).filter(more)
        names = listed(names.filter(more))
        marks = [c[-n:] if n else "" for c, n in zip(names, listed(sizes))]
        ends = list(set(marks))
        ends = dict(zip(ends, self._codes(ends, self._encode_each)))
        self.chunks.update(zip(names, map(add, map(codes.__getitem__, listed(words.indices.filter(more))), map(ends.__getitem__, marks))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if self.tokenizer is None:
            self._load()
        if 2 * len(self.chunks) > CACHE:
            self.chunks, self.older = {}, self.chunks
        texts = pa.array([t or "" for t in texts], pa.string())
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = cut.flatten().dictionary_encode()
        place, distinct = flat.indices.to_numpy(), listed(flat.dictionary)
        self.chunks[""] = b""
        coded = self._codes(distinct, self.learn)
        ids, sizes = np.frombuffer(b"".join(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        edges = ends[cut.offsets.to_numpy()].tolist()
        return [out[i:j].tobytes() for i, j in zip(edges, edges[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int):
    """mapInArrow: documents to their pieces."""
    def run(batches):
        tokenizer = _TOKENIZERS.setdefault(path, WordTokenizer(path))
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                b = batch.slice(at, 250)
                rows = []
                for uid, doc, ids in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), tokenizer.encode(b.column("text").to_pylist()), strict=True):
                    ids += end
                    rows += [(uid, doc, i, i * capacity, len(part) // 4, zlib.crc32(part)) for i in range(-(-len(ids) // step)) if (part := ids[i * step:(i + 1) * step])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
        tokenizer.forget()
        release_memory()
    return run


PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")])


def reduce_dominated(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets in ``count`` (length -> pieces), which is reduced in place.

    Returns (lengths of a set, number of such sets).
    """
    fixed = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        fixed.append((lengths, n))
        for x in lengths:
            count[x] -= n
            if not count[x]:
                del count[x]

    def smallest(k: int, without: int) -> int:
        """Sum of the k shortest pieces besides one of ``without``; above capacity if there are fewer."""
        total = 0
        for x in sorted(count):
            n = min(k, count[x] - (x == without))
            total, k = total + n * x, k - n
            if not k:
                return total
        return capacity + 1

    for length in sorted(count, reverse=True):
        while count.get(length):
            room, n = capacity - length, count[length]
            fits = [x for x in count if x <= room and count[x] > (x == length)]
            if not fits:
                fix((length,), n)
                break
            best = max(fits)
            pairs = n // 2 if best == length else min(n, count[best])
            if best == room or smallest(2, length) > room:
                fix((length, best), pairs)
                continue
            if smallest(3, length) > room:
                others = sorted(fits)
                two = max((x + y for i, x in enumerate(others) for y in others[i:] if x + y <= room and (x != y or count[x] - (x == length) >= 2)), default=0)
                if best >= two:
                    # the conditions only ask whether up to three pieces of a length are there, so
                    # they hold for all sets that leave four of both
                    spare = (n - 4) // 2 if best == length else min(n, count[best]) - 4
                    fix((length, best), max(1, spare))
                    continue
            break
    return fixed


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces per sequence, first offset)."""
    count = {x: n for x, n in histogram.items() if n > 0}
    rank, runs, sequences = dict.fromkeys(count, 0), [], 0

    def place(length: int, first: int, n: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], first, each, offset))
        rank[length] += n * each

    open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number of sequences)
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if not n:
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((first, n))

    for lengths, n in reduce_dominated(count, capacity):
        offset = 0
        for x in lengths:
            place(x, sequences, n, 1, offset)
            offset += x
        sequences += n
    for length in sorted(count, reverse=True):
        left = count[length]
        while left:
            i = int(np.searchsorted(rooms, length)) if rooms else 0
            if i < len(rooms):
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                place(length, first, full, each, capacity - room)
                leave(room - each * length, first, full)
                left -= full * each
            rest = n - full
            if rest and left:  # fewer pieces than the next sequence could take
                place(length, first + full, 1, left, capacity - room)
                leave(room - left * length, first + full, 1)
                left, full, rest = 0, full + 1, rest - 1
            leave(room, first + full, rest)
    return runs


def _placed(runs: list[tuple[int, int, int, int, int]]):
    """mapInArrow: sequence and offset of ranked pieces."""
    by: dict[int, tuple[np.ndarray, ...]] = {}
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    for length in np.unique(table[:, 0]):
        by[int(length)] = tuple(table[table[:, 0] == length][:, 1:].T)

    def run(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, sequence, each, offset = by[int(x)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                k = rank[at] - first[i]
                seq[at], off[at] = sequence[i] + k // each[i], offset[i] + k % each[i] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [b.column(c).cast(pa.int32()) if c == "piece" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])
    return run


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within the pieces of equal length, by hashed blocks of them."""
    spark = pieces.sparkSession
    blocks = spark.createDataFrame([(x, -(-n // BLOCK)) for x, n in histogram.items()] or [(0, 1)], "of long, blocks long")
    cut = pieces.join(F.broadcast(blocks), F.col("length") == F.col("of"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("uid", "piece"), F.col("blocks"))).drop("of", "blocks")
    sizes = cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select(F.col("length").alias("at_length"), F.col("block").alias("at_block"), before.alias("before")), "blocks")
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("uid", "piece")) - 1
    out = cut.withColumn("inside", inside).join(sizes, (F.col("length") == F.col("at_length")) & (F.col("block") == F.col("at_block")))
    return out.withColumn("rank", F.col("inside").cast("long") + F.col("before"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, capacity), PIECES), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(pieces, histogram).mapInArrow(_placed(plan(histogram, capacity)), schema)
