"""Token counts of a byte-level BPE tokenizer by whole-token shortcut.

Offline, every vocabulary string that is one pre-token is encoded alone; those that give
exactly one token are proven whole. A text is cut into pre-tokens by the tokenizer's own
pattern; a pre-token that is proven whole counts one, only the rest goes through the merges,
once for each new string. Pre-tokens never merge with each other, so the sum is exact.

Special tokens found in a text count one each and are cut out before, as the library does by
default.

Defined results: null and empty texts have no tokens. Repeated rows are counted each. Other
columns are ignored by ``report``. Empty tables give no rows.
"""

from __future__ import annotations

import re
from itertools import filterfalse

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Pre-tokens outside the proven vocabulary that a worker remembers.
CACHE = 600_000

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: The same pattern for texts that are all ASCII, with its classes written out.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class TokenCounter:
    """Counts tokens; loads the tokenizer and proves its vocabulary on first use in a process."""

    def __init__(self, path: str):
        self.path, self.tokenizer, self.merged = path, None, {}

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.__init__(state["path"])

    def load(self) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        strings = [tokenizer.decode([i], skip_special_tokens=False) for i in sorted(tokenizer.get_vocab().values())]
        alone = [s for s in strings if s not in special and PATTERN.findall(s) == [s]]
        codes = tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        self.whole = {s for s, e in zip(alone, codes, strict=True) if len(e.ids) == 1}
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.tokenizer = tokenizer

    def _merge(self, new: list[str]) -> None:
        for s, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.merged[s] = len(e.ids)

    def counts(self, texts: list[str | None]) -> list[int]:
        if self.tokenizer is None:
            self.load()
        if len(self.merged) > CACHE:
            self.merged.clear()
        whole, merged, totals, rests, new = self.whole, self.merged, [], [], set()
        for text in texts:
            parts, n = [text or ""], 0
            if self.special is not None:
                parts = self.special.split(parts[0])
                n = len(parts) - 1
            rest = []
            for part in parts:
                found = (ASCII_PATTERN if part.isascii() else PATTERN).findall(part)
                far = list(filterfalse(whole.__contains__, found))
                n += len(found) - len(far)
                rest += far
            totals.append(n)
            rests.append(rest)
            new.update(p for p in rest if p not in merged)
        if new:
            self._merge(list(new))
        get = merged.__getitem__
        return [n + sum(map(get, rest)) for n, rest in zip(totals, rests, strict=True)]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of this process for a tokenizer file."""
    return _COUNTERS.setdefault(path, TokenCounter(path))


def token_count(path: str):
    """Pandas UDF from text to number of tokens."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        c, rows = counter(path), texts.tolist()
        return pd.Series([n for at in range(0, len(rows), 250) for n in c.counts(rows[at:at + 250])], dtype="int64")
    return count


def report(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(tokenizer_path)(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
