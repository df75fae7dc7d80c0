"""Main text of web pages by a tree-structured graphical model.

A page is parsed to its element tree. Every element has a hidden label, content or not. Its
own potential comes from its tag, the length of its text, its share of link text and its
punctuation; a pair potential ties it to its parent. Sum-product messages go upward from the
leaves and downward from the root, which gives the exact marginal of every element. The text
of elements with a content marginal of one half or more is the main text.

The potentials are trained from labelled pages: pages with an ``article`` or ``main`` element
label their own elements. At most ``FIT_PAGES`` pages are counted, drawn by a hash of the page
id; counts are summed by Spark. Markup that names its purpose (``nav``, ``aside``, ``footer``,
``form``, a class such as "ad" or "comments") and elements that are never shown (also by style)
enter as evidence that messages cannot outvote; a form around an article or main element, as
form frameworks write it, says nothing. Words in class, id or role say nothing of ``html``,
``body``, ``main``, outermost ``article`` elements and what wraps all of these, nor, outside
of articles, of elements that hold half of the shown text or more and leave no article out.

Defined results: null and empty pages give an empty text. Unclosed and stray tags are
tolerated: a comment, script or style that is never closed reaches to the end. Repeated pages
are extracted each. Without labelled pages the prior counts alone are used. Extra columns are
ignored. Empty tables give no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import materialize

FIT_PAGES = 2000
#: Log odds of evidence given by markup.
EVIDENCE = 1e4
#: Bounds of what one feature and one pair may say, so that pages unlike the training pages stay open.
MAX_FEATURE, MIN_PAIR = 3.0, 0.05

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
HIDDEN = frozenset("head script style textarea title noscript iframe template svg annotation annotation-xml select option button input datalist".split())
APART = frozenset("nav aside footer form header menu dialog".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "dt", "dd", "li"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main td th blockquote".split())
TAGS = frozenset("html body article main section div p ul ol li blockquote pre table tr td th figure figcaption nav aside footer header form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that name something other than the article.
CUES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs
    sidebar side footer header masthead cookie cookies consent notice notices alert popup modal newsletter subscribe signup login search
    comment comments reply replies discussion disqus share sharing social related recommended pagination pager toolbar widget copyright legal
    form contentinfo complementary""".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
#: Elements of other vocabularies, where a tag may close itself.
FOREIGN = frozenset("svg math".split())
_SENTENCE = re.compile(r"[.!?,;:]")


class Tree:
    """Elements in page order: tag, parent, evidence; and the pieces of text (element, text)."""

    def __init__(self, page: str):
        self.tags, self.parents, self.hidden, self.cues, self.pieces = ["#root"], [-1], [False], [False], []
        stack, at = [0], 0
        self.open: Counter = Counter()
        while True:
            m = _TOKEN.search(page, at)
            text = page[at:m.start()] if m else page[at:]
            if text:
                self.pieces.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            at = self._open(stack, tag, m[3], page, at)

    def _open(self, stack: list[int], tag: str, attributes: str, page: str, at: int) -> int:
        if tag == "br" or tag == "hr":
            self.pieces.append((stack[-1], None))
        if tag in CLOSES_P:
            self._close(stack, "p")
        if tag in SAME and any(self.open[t] for t in SAME[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if self.tags[stack[i]] in SAME[tag]:
                    self._leave(stack, i)
                    break
                if self.tags[stack[i]] in SCOPE:
                    break
        if tag in VOID:
            return at
        self.tags.append(tag)
        self.parents.append(stack[-1])
        hidden, cue = _named_apart(attributes) if attributes else (False, False)
        self.hidden.append(hidden)
        self.cues.append(cue)
        me = len(self.tags) - 1
        if attributes.endswith("/") and (tag in FOREIGN or self.open["math"]):  # HTML elements do not close themselves
            return at
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            if end is None:
                return len(page)
            close = page.find(">", end.start())
            return len(page) if close < 0 else close + 1
        stack.append(me)
        self.open[tag] += 1
        return at

    def _leave(self, stack: list[int], i: int) -> None:
        for j in stack[i:]:
            self.open[self.tags[j]] -= 1
        del stack[i:]

    def _close(self, stack: list[int], tag: str) -> None:
        """Leaves the innermost open element of this name; a look from the top ends there."""
        if not self.open[tag]:
            return
        i = len(stack) - 1
        while self.tags[stack[i]] != tag:
            i -= 1
        self._leave(stack, i)

    def evidence(self) -> list[bool]:
        """Elements that cannot be content: hidden, or set apart by tag or class."""
        apart = [t in HIDDEN or h or t in APART for t, h in zip(self.tags, self.hidden, strict=True)]
        if "form" in self.tags:
            holds = [t in ("article", "main") for t in self.tags]
            for i in range(len(holds) - 1, 0, -1):
                holds[self.parents[i]] = holds[self.parents[i]] or holds[i]
            apart = [a and (h or not (t == "form" and x)) for a, h, t, x in zip(apart, self.hidden, self.tags, holds, strict=True)]
        if True not in self.cues:
            return apart
        open_ = self._not_named_apart(apart)
        return [a or (c and not o) for a, c, o in zip(apart, self.cues, open_, strict=True)]

    def _not_named_apart(self, apart: list[bool]) -> list[bool]:
        """Elements of which words in class, id or role say nothing."""
        n = len(self.tags)
        shown, in_main, in_article = [True] * n, [False] * n, [False] * n
        roots, articles, chars = [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = self.parents[i]
            shown[i] = shown[p] and not apart[i]
            in_main[i] = in_main[p] or self.tags[p] == "main"
            in_article[i] = in_article[p] or self.tags[p] == "article"
            articles[i] = int(shown[i] and self.tags[i] == "article" and not in_article[i])
            roots[i] = int(shown[i] and not in_main[i] and not in_article[i] and self.tags[i] in ("main", "article"))
        out = [t in ("html", "body", "main") or a == 1 for t, a in zip(self.tags, articles, strict=True)]
        for i, text in self.pieces:
            if text and shown[i]:
                chars[i] += len(text) - text.count(" ") - text.count("\n")
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            roots[p] += roots[i]
            articles[p] += articles[i]
            chars[p] += chars[i]
        for i in range(n):
            whole = roots[i] == roots[0] > 0 and not in_main[i]
            most = 2 * chars[i] >= chars[0] > 0 and articles[i] == articles[0] and (in_main[i] or roots[i] == roots[0])
            out[i] = out[i] or (not in_article[i] and (whole or most))
        return out

    def features(self) -> list[tuple[str, ...]]:
        """Features of every element: tag, words, share of link text, punctuation."""
        n = len(self.tags)
        chars, linked, marks = [0] * n, [0] * n, [0] * n
        for i, text in self.pieces:
            if text:
                chars[i] += len(text)
                marks[i] += len(_SENTENCE.findall(text))
        for i in range(n - 1, -1, -1):
            if self.tags[i] == "a":
                linked[i] = chars[i]
            if i:
                p = self.parents[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                marks[p] += marks[i]
        out = []
        for i in range(n):
            size = chars[i]
            out.append((
                "tag=" + ("heading" if self.tags[i] in HEADINGS else self.tags[i] if self.tags[i] in TAGS else "other"), f"size={min(6, size.bit_length() // 2)}",
                f"links={min(4, 5 * linked[i] // size) if size else 0}", f"marks={min(3, 100 * marks[i] // size) if size else 0}"))
        return out


def _named_apart(attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether class, id or role hold one of CUES."""
    hidden = cue = False
    for m in _ATTR.finditer(attributes):
        if m[1].lower() == "hidden":
            hidden = True
        elif m[1].lower() == "style":
            hidden = hidden or _UNSEEN.search(m[2] or m[3] or m[4] or "") is not None
        elif not CUES.isdisjoint(_WORDS.findall((m[2] or m[3] or m[4] or "").lower())):
            cue = True
    return hidden, cue


def labels_of(tree: Tree) -> list[int] | None:
    """Labels of the elements of a page that marks its article; None for other pages."""
    out, apart = [], tree.evidence()
    for i, tag in enumerate(tree.tags):
        up = tree.parents[i]
        inside = i > 0 and (out[up] == 1 or tag in ("article", "main"))
        blocked = apart[i] or (i > 0 and out[up] == -1)
        out.append(-1 if blocked else int(inside))
    return [int(y == 1) for y in out] if 1 in out else None


def count_labels(batches):
    """mapInArrow: counts of (feature, label) and (parent label, label) over labelled pages."""
    counts: Counter = Counter()
    for b in batches:
        for page in b.column("html").to_pylist():
            tree = Tree(page or "")
            ys = labels_of(tree)
            if ys is None:
                continue
            for i, features in enumerate(tree.features()):
                counts.update((f, ys[i]) for f in features)
                counts["#", ys[i]] += 1
                if i:
                    counts[f">{ys[tree.parents[i]]}", ys[i]] += 1
    keys = sorted(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
        names=["feature", "label", "n"])


class Model:
    """Log potentials. ``prior`` counts keep pages sane that were never seen in training."""

    PRIOR = {("#", 0): 20, ("#", 1): 20, (">0", 0): 19, (">0", 1): 1, (">1", 0): 1, (">1", 1): 19}

    def __init__(self, counts: dict[tuple[str, int], int]):
        n = Counter(self.PRIOR)
        n.update(counts)
        total = [n["#", y] + 10 for y in (0, 1)]
        names = {f for f, _ in n if f[0] not in "#>"}
        odds = {f: math.log((n[f, 1] + 1) / total[1]) - math.log((n[f, 0] + 1) / total[0]) for f in names}
        self.unary = {f: max(-MAX_FEATURE, min(MAX_FEATURE, x)) for f, x in odds.items()}
        other = [max(MIN_PAIR, n[f">{p}", 1 - p] / (n[f">{p}", 0] + n[f">{p}", 1])) for p in (0, 1)]
        self.pair = [[1 - other[0], other[0]], [other[1], 1 - other[1]]]

    def marginals(self, tree: Tree) -> list[float]:
        """Log odds of content for every element, by one pass upward and one downward.

        Inline elements only pass messages on. All messages are log odds. The pair potential P(child | parent) carries them: upward
        log(P(evidence | parent 1) / P(evidence | parent 0)).
        """
        (p00, p01), (p10, p11) = self.pair
        apart, n = tree.evidence(), len(tree.tags)
        own = [-EVIDENCE if apart[i] else sum(self.unary.get(f, 0.0) for f in fs) if tree.tags[i] in BLOCK else 0.0 for i, fs in enumerate(tree.features())]

        def carried(x: float, a0: float, a1: float, b0: float, b1: float) -> float:
            """log((b0 + b1 e^x) / (a0 + a1 e^x))"""
            if x > 0:
                e = math.exp(-x)
                return math.log((b0 * e + b1) / (a0 * e + a1))
            e = math.exp(x)
            return math.log((b0 + b1 * e) / (a0 + a1 * e))

        belief, sent = own[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            if not apart[i]:  # an advert within an article says nothing about the article
                sent[i] = carried(belief[i], p00, p01, p10, p11)
            belief[tree.parents[i]] += sent[i]
        for i in range(1, n):
            rest = belief[tree.parents[i]] - sent[i]  # what the parent knows without this child
            belief[i] += carried(rest, p00, p10, p01, p11)
        return belief

    def text(self, page: str | None) -> str:
        """Main text: blocks in page order, each with single spaces."""
        if not page:
            return ""
        tree = Tree(page)
        odds = self.marginals(tree)
        shown, block_of = [False] * len(odds), [0] * len(odds)
        apart = tree.evidence()
        for i in range(len(odds)):
            up = tree.parents[i]
            apart[i] = apart[i] or (i > 0 and apart[up])
            block_of[i] = i if tree.tags[i] in BLOCK or i == 0 else block_of[up]
            shown[i] = odds[block_of[i]] >= 0 and not apart[i]
        blocks, last, part = [], None, []
        for i, text in tree.pieces:
            if text is None or block_of[i] != last:
                blocks.append("".join(part))
                last, part = block_of[i], []
            if text and shown[i]:
                part.append(text)
        blocks.append("".join(part))
        return " ".join(" ".join(html.unescape(b).split()) for b in blocks if b and not b.isspace())


def fit(pages: DataFrame, max_pages: int = FIT_PAGES) -> Model:
    """Counts labels on a bounded sample of pages."""
    ids = pages.where(F.col("page_id").isNotNull()).select("page_id").distinct()
    ids = materialize(ids.orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages).withColumnRenamed("page_id", "fit_id"), "fit-pages")
    rows = pages.select("page_id", "html").join(F.broadcast(ids), F.col("page_id") == F.col("fit_id")).select("html")
    counts = rows.mapInArrow(count_labels, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    return Model({(r["feature"], r["label"]): r["n"] for r in counts.collect()})


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = fit(pages)

    @F.pandas_udf("string")
    def main_text(texts: pd.Series) -> pd.Series:
        return pd.Series([model.text(t) for t in texts], dtype=object)

    out = pages.select("page_id", "url", main_text(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
