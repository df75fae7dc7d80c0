"""Toxicity scores from a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: word stems (first ``STEM`` letters) that stand in
many more toxic than other documents, and whole words that carry such a stem. The whole
words form a trie. The Levenshtein automaton of a term is walked along the trie branches to
catch misspelt forms (one edit in words of five letters or more; in those of five only a
replaced letter). Learned terms of three or four letters are caught with a doubled letter, in
the plural, and with a letter replaced by a sign, a digit (in those of three only one that
looks like it) or a letter that looks like it. Every hit is weighed in a window of its neighbours: quotation marks
around it or a verb of speech beside it make it a quotation, an address (second person)
makes it abuse. A logistic model over a few sums of the hits gives the score.

The model is fitted on at most ``FIT_ROWS`` labelled rows, drawn by a hash of the row key.
Only the text enters a score.

Defined results: null and empty texts have no hits and get the score of a text without hits.
Without labelled rows of both classes the score is the smoothed share of toxic labels (0 if
there are none). Rows with a null label are not learned from; repeated labels count each.
Other columns are kept by ``keep_civil`` and ignored by ``report``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import drop_rows, materialize, release_memory, small_batches, text_hash

STEM = 5
FIT_ROWS = 40_000
THRESHOLD = 0.3
#: Neighbours on either side that decide between quotation and abuse.
CONTEXT = 6
CACHE = 200_000

TOKEN = re.compile(r"[^\W_]+(?:[@$!*|][^\W_]+)*")
# Digits and signs by the letters they stand for, letters that look alike.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq"}
SIGNS, DIGITS = "@$!*|", "0123456789"
ALIKE = {"u": "v", "v": "u", "i": "l", "l": "i"}
QUOTES = "\"'“”„‟«»‘’‹›"
# Verbs of speech and second-person words of English, German, French and Spanish.
SPEECH = frozenset("said says quote quoted quotes called wrote writes sagte sagt zitat nannte schrieb dit disait cite écrit dijo dice cita llamó escribió".split())
ADDRESS = frozenset("you your youre du dein deine dich ihr euch tu toi te vous votre tú tu usted vosotros".split())
FEATURES = ("abuse", "quoted", "fuzzy", "strongest", "distinct", "density")


def trie_of(terms: dict[str, float]) -> dict:
    root: dict = {}
    for term, weight in terms.items():
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = (term, weight)
    return root


def short_forms(term: str) -> set[str]:
    """Forms in which a term of three or four letters is caught besides itself."""
    forms = {term + "s", term + "es"}
    for i, c in enumerate(term):
        forms.add(term[:i] + c + term[i:])
        digits = [d for d in DIGITS if len(term) > 3 or c in LEET[d]]
        forms.update(term[:i] + x + term[i + 1:] for x in [*SIGNS, *digits, *ALIKE.get(c, "")] if not c.isdigit())
    return forms - {term}


def fuzzy_matches(word: str, trie: dict):
    """Lexicon terms within one edit of ``word``: its Levenshtein automaton runs along the trie.

    The states are two bit sets over the positions of the word: reached without an edit, and
    with one. A branch is left when both are empty.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(word):
        places[c] = places.get(c, 0) | 1 << i
    end, todo = 1 << len(word), [(trie, 1, 3)]
    while todo:
        node, exact, edited = todo.pop()
        if exact:
            for c, child in node.items():
                if c == "":
                    if (exact | edited) & end:
                        yield child
                    continue
                here = places.get(c, 0)
                on = (exact & here) << 1
                # a replaced letter, one too many, or one too few
                off = (edited & here) << 1 | exact << 1 | exact | on << 1
                todo.append((child, on, off))
        else:  # no edit is left: only letters of the word lead on
            if "" in node and edited & end:
                yield node[""]
            for c, here in places.items():
                if edited & here and c in node:
                    todo.append((node[c], 0, (edited & here) << 1))


@dataclass
class Lexicon:
    """Weights of stems and of whole words; remembers what it found out about words."""
    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.trie = trie_of(self.words)
        # one edit leaves the first or the second half of a term as it is
        self.heads = {(len(w), w[:len(w) // 2]) for w in self.words}
        self.tails = {(len(w), w[len(w) // 2:]) for w in self.words}
        self.short: dict[str, tuple[str, float, bool]] = {}
        for term, weight in self.stems.items():
            if len(term) < STEM:
                for form in short_forms(term):
                    self.short[form] = max(self.short.get(form, (term, weight, True)), (term, weight, True), key=lambda x: (x[1], x[0]))
        self.known: dict[str, tuple[str, float, bool] | None] = {}

    def __getstate__(self):
        return {"stems": self.stems, "words": self.words}

    def __setstate__(self, state):
        self.stems, self.words = state["stems"], state["words"]
        self.__post_init__()

    def look(self, word: str) -> tuple[str, float, bool] | None:
        """(term, weight, misspelt) of a word, None if it is no hit."""
        stem = word[:STEM]
        if stem in self.stems:
            return stem, self.stems[stem], False
        if word in self.short:
            return self.short[word]
        n = len(word)
        if n < STEM or not any((m, word[:m // 2]) in self.heads or (m, word[m // 2 - m:]) in self.tails for m in (n - 1, n, n + 1) if m > STEM or m == n):
            return None
        found = [x for x in fuzzy_matches(word, self.trie) if len(x[0]) > STEM or len(x[0]) == n]
        if not found:
            return None
        term, weight = max(found, key=lambda x: (x[1], x[0]))
        return term, weight, True

    def hits(self, distinct) -> dict[str, tuple[str, float, bool]]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, out = self.known, {}
        for w in distinct:
            hit = known[w] if w in known else known.setdefault(w, self.look(w))
            if hit:
                out[w] = hit
        return out

    def features(self, text: str | None) -> list[float]:
        """The sums of FEATURES for one text."""
        low = (text or "").lower()
        tokens = TOKEN.findall(low)
        found = self.hits(set(tokens))
        if not found:
            return [0.0] * len(FEATURES)
        abuse = quoted = fuzzy = 0.0
        for i, m in enumerate(TOKEN.finditer(low)):
            hit = found.get(m[0])
            if hit is None:
                continue
            around = tokens[max(0, i - CONTEXT):i] + tokens[i + 1:i + 1 + CONTEXT]
            before, after = low[max(0, m.start() - 40):m.start()], low[m.end():m.end() + 40]
            marked = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            weight = hit[1] * (1.25 if not ADDRESS.isdisjoint(around) else 1.0)
            if marked or not SPEECH.isdisjoint(around):
                quoted += weight
            elif hit[2]:
                fuzzy += weight
            else:
                abuse += weight
        weights = [h[1] for h in found.values() if not h[2]]
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), max(weights, default=0.0),
                math.log1p(len({h[0] for h in found.values() if not h[2]})), math.log1p(100 * (abuse + quoted) / len(tokens))]


@dataclass
class Model:
    lexicon: Lexicon
    bias: float
    coef: list[float]
    mean: list[float]
    scale: list[float]

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(-1, len(FEATURES))
        z = self.bias + ((x - self.mean) / self.scale) @ np.array(self.coef)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _count_words(batches):
    """mapInArrow: for each part of the rows, in how many documents of either label a stem or word stands."""
    tox, non, n = Counter(), Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            ws = set(TOKEN.findall((text or "").lower()))
            stems = {w[:STEM] for w in ws if len(w) >= 3}
            n[label] += 1
            (tox if label else non).update(stems)
            if label:  # whole words matter only where a toxic document holds them
                tox.update("=" + w for w in ws if len(w) >= STEM)
    keys = sorted(tox.keys() | non.keys())
    keys, a, c = ["#", *keys], [n[1], *(tox[k] for k in keys)], [n[0], *(non[k] for k in keys)]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["term", "tox", "non"])
    del tox, non, keys, a, c
    release_memory()


def _lexicon(rows: DataFrame) -> Lexicon:
    """All stems that pass the likelihood ratio, and the whole words with such a stem; both bounded by the labelled sample."""
    counts = rows.select("text", "toxic").mapInArrow(_count_words, "term string, tox long, non long")
    counts = materialize(counts.groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("non").alias("non")), "term-counts")
    total = counts.where("term = '#'").first()
    t, n = (total["tox"], total["non"]) if total else (0, 0)
    if not t or not n:
        return Lexicon()
    a, c = F.col("tox") + 0.5, F.col("non") + 0.5
    share = (a + c) / (t + n + 2)
    gain = 2 * (a * F.log(a / ((t + 1) * share)) + c * F.log(c / ((n + 1) * share)))
    lift = F.log(a / (t + 1)) - F.log(c / (n + 1))
    stems = counts.where((F.col("tox") >= 4) & ~F.col("term").startswith("=") & (F.col("term") != "#") & (gain >= 25) & (lift >= math.log(4)))
    stems = {r["term"]: r["w"] for r in stems.select("term", lift.alias("w"), gain.alias("g")).orderBy(F.desc("g"), "term").collect()}
    words = counts.where((F.col("tox") >= 3) & F.col("term").startswith("=")).select(F.substring("term", 2, 1000).alias("word"), "tox")
    words = words.where(F.substring("word", 1, STEM).isin(list(stems))) if stems else words.limit(0)
    words = words.orderBy(F.desc("tox"), "word").collect()
    return Lexicon(stems, {r["word"]: stems[r["word"][:STEM]] for r in words})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w, reg = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + reg, z.T @ (p - y) + reg @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def row_part(key) -> F.Column:
    """Remainder of the CRC-32 of a key as text modulo 4; part 2 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> Model:
    """Learns lexicon and weights from labelled rows that are not held out."""
    used = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (row_part(F.col("doc_id")) != 2))
    used = used.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    used = materialize(used.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows), "label-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(used), F.col("doc_id") == F.col("label_id"))
    rows = materialize(rows.select("text", "toxic"), "labelled")
    lexicon = _lexicon(rows)
    n_features = len(FEATURES)

    def featured(batches):
        for b in batches:
            x = [lexicon.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.mapInArrow(featured, "toxic int, x array<double>").toPandas()
    y = got["toxic"].to_numpy(dtype=float) if len(got) else np.empty(0)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model(Lexicon(), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), [0.0] * n_features, [0.0] * n_features, [1.0] * n_features)
    x = np.vstack(got["x"].to_numpy())
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    bias, coef = _logistic((x - mean) / scale, y)
    return Model(lexicon, bias, coef.tolist(), mean.tolist(), scale.tolist())


def score_column(model: Model):
    """Pandas UDF from text to score."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([np.empty(0), *(np.asarray(model.scores(texts.iloc[at:at + 500]), float) for at in range(0, len(texts), 500))]))
        model.lexicon.known.clear()
        release_memory()
    return score


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    out = docs.select("doc_id", (row_part(F.col("doc_id")) == 2).alias("held_out"), score_column(model)(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are. Rows of equal id and
    text have equal scores, so the rejected ones are written as such keys, few texts at a time."""
    with small_batches(docs.sparkSession):
        model = fit(docs, labels)
        scored = docs.select("doc_id", text_hash(F.col("text")).alias("th"), score_column(model)(F.col("text").cast("string")).alias("score"))
        return drop_rows(docs, scored.where(F.col("score") >= THRESHOLD).select("doc_id", "th"), "toxic")
