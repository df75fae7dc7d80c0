"""Secret scans: fixed patterns and sliding-window entropy of candidate strings.

Candidates are runs of letters, digits and key punctuation. Of each window of ``WINDOW``
characters the narrowest character class that holds it (digits, hex, letters with digits, base
64) sets the entropy that it must reach, so a key beside a slash is judged as a key. Entropy
and class are kept by incremental counts: a step takes one character out and one in, and
changes two terms of sum c*log2(c) and two counts of character kinds. Windows above the limit that touch no span of another kind join to one span
where they overlap. An allow-list suppresses candidates and spans that are words of letters
only, runs without both letters and digits, paths, host names, dates and UUIDs as a whole. A
placeholder word within a span takes the ``WINDOW`` characters on either side of it out; the
windows beyond stay.

Spans are (kind, start, end) in code points, end exclusive. Kinds: assign, access, hex, and
entropy for windows outside every span of the other kinds.

Defined results: null and empty texts have no spans and the digest of the empty string.
Repeated rows are scanned each. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")

# The base patterns. Letters of the keys stand in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % WINDOW)
#: Least entropy of a window by character class, in bits per character.
LIMITS = {"digits": 3.1, "hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Kinds of characters: digits, a-f, A-F, other letters, and the rest.
_KIND = {c: k for k, cs in enumerate(("0123456789", "abcdef", "ABCDEF")) for c in cs} | {c: 3 for c in "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"}
ALLOW = (
    re.compile(r"[A-Za-z]+(?:[._/-][A-Za-z]+)*[.=_/-]*"),  # words, paths and host names
    re.compile(r"[._/=+-]*[0-9]+(?:[._/=+-]+[0-9]*)+|[._/=+-]+"),  # dates, versions, telephone numbers, rules
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
)
PLACEHOLDER = re.compile(r"example|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxx|0{8}|1234567|abcdefg", re.IGNORECASE)
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def class_of(kinds: list[int]) -> str:
    """Narrowest character class of a window, by how many characters of each kind it has."""
    if kinds[4]:
        return "base64"
    if kinds[3] or (kinds[1] and kinds[2]):
        return "alnum"
    return "hex" if kinds[1] or kinds[2] else "digits"


def windows(text: str, window: int = WINDOW):
    """(Shannon entropy, character class) of every window, by incremental counts."""
    counts: dict[str, int] = {}
    kinds, total = [0] * 5, 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        kinds[_KIND.get(c, 4)] += 1
        if i + 1 < window:
            continue
        yield math.log2(window) - total / window, class_of(kinds)
        old = text[i + 1 - window]
        n = counts[old]
        total += _TERM[n - 1] - _TERM[n]
        counts[old] = n - 1
        kinds[_KIND.get(old, 4)] -= 1


def joined_windows(found: list[int]) -> list[tuple[int, int]]:
    """Spans of the windows at the given ascending starts, overlapping or adjacent ones as one."""
    runs: list[tuple[int, int]] = []
    for i in found:
        if runs and i <= runs[-1][1]:
            runs[-1] = (runs[-1][0], i + WINDOW)
        else:
            runs.append((i, i + WINDOW))
    return runs


def without_placeholders(text: str, found: list[int]) -> list[tuple[int, int]]:
    """Spans of the windows that a placeholder word of their span does not take out."""
    out = []
    for a, b in joined_windows(found):
        words = [(m.start() - WINDOW, m.end() + WINDOW) for m in PLACEHOLDER.finditer(text, a, b)]
        if words:
            out += joined_windows([i for i in found if a <= i <= b - WINDOW and all(i + WINDOW <= x or y <= i for x, y in words)])
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the windows of high entropy that no span of ``taken`` touches."""
    out = []
    taken = sorted(taken)
    ends = list(accumulate((b for _, b in taken), max))

    def free(at: int, b: int):
        """Parts of text[at:b] outside of ``taken``."""
        for k in range(bisect_right(ends, at), len(taken)):
            if taken[k][0] >= b:
                break
            if taken[k][0] > at:
                yield at, taken[k][0]
            at = max(at, taken[k][1])
        if at < b:
            yield at, b

    for m in CANDIDATE.finditer(text):
        word = m[0]
        if any(p.fullmatch(word) for p in ALLOW):
            continue
        for at, stop in free(m.start(), m.end()):
            found = [at + i for i, (h, kind) in enumerate(windows(text[at:stop])) if h >= LIMITS[kind]]
            out += [("entropy", a, b) for a, b in without_placeholders(text, found) if not any(p.fullmatch(text, a, b) for p in ALLOW)]
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind."""
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans = base + entropy_spans(text, [(a, b) for _, a, b in base])
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanned(texts: pd.Series) -> pd.DataFrame:
    """Counts by base kind, digest of the base spans and all spans of each text."""
    rows = []
    for text in texts:
        spans = scan(text)
        base = [s for s in spans if s[0] != "entropy"]
        n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
        rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    scanner = F.pandas_udf(scanned, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select("doc_id", scanner(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("s")).select("doc_id", "s.*")
