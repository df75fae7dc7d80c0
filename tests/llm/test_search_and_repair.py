"""Piece encoding, ranked search and conversation repair against the library and brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tocsin.llm import conversation_repair as cr
from tocsin.llm import lexical_search as ls
from tocsin.llm import sentence_pieces as sp

DOC = "doc_id long, text string, lang string, ids string, IDS_ string, Decoded string, n long, rank int, item string"


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("piece_bpe_32k.model")


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "the", "tion", "é", "é", "ﬁ①", "日本", "　", "</s>", "<unk>", "<0x41>", "😀", "\x00", ".", "Ab", "zz", "﻿"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_marked_words_rebuild_the_text():
    for text in random_texts(2000, 1):
        words = sp.marked_words(text)
        assert "".join(" " + w for w in words)[1:] == text.replace("▁", " ")
        assert all(not w.strip(" ").count(" ") for w in words)


def test_pieces_equal_the_library(path):
    from sentencepiece import SentencePieceProcessor

    library, texts = SentencePieceProcessor(model_file=path), [*random_texts(3000, 2), "x" * 50_000, " ".join(f"w{i}" for i in range(20_000))]
    model = sp.pieces(path)
    some = sorted({w for t in texts for w in sp.marked_words(t)})[::2]
    for table in ({}, dict(zip(some, model.segment(some)))):
        got = [np.frombuffer(x, "<i4").tolist() for x in sp._Lookup(path, table).encode(texts)]
        assert got == library.encode(texts)
    rng = random.Random(3)
    ids = [[rng.choice([rng.randrange(32_000), rng.randrange(260), 259, 28705, 0, 1, 2]) for _ in range(rng.randrange(9))] for _ in range(5000)]
    assert [model.text(x) for x in ids] == [library.decode(x) for x in ids]


def test_memo_is_bounded_and_drops_nothing(path, monkeypatch):
    texts = [f"word{i} other{i % 7}" for i in range(300)]
    want = sp._Lookup(path, {}).encode(texts)
    monkeypatch.setattr(sp, "MEMO_BYTES", 100)
    lookup = sp._Lookup(path, {"other1": sp.pieces(path).segment(["other1"])[0]})
    assert [lookup.encode([t])[0] for t in texts] == want
    assert len(lookup.known) < 10


def test_piece_report(spark, path):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    texts = [None, "", " ", "▁", "same text", "same text", *random_texts(60, 4), "long " * 3000]
    rows = [(i if i % 9 else None, t, "en", "x", "y", "z", 1, 2, "i") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    want = sorted((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
                  for r in rows for ids in [library.encode(r[1] or "")])
    for size in (5, sp.TABLE):
        assert sorted((str(r[0]), *r[1:]) for r in sp.report(docs, path, size).collect()) == want
    coded, name = sp.encode(docs, path)
    assert name == "ids__" and coded.columns[:-1] == docs.columns
    back, text = sp.decode(coded, path, name)
    assert text == "decoded_" and all((r["text"] or "").replace("▁", " ") == r[text] for r in back.collect())
    assert sp.report(docs.limit(0), path).collect() == []


def brute_search(docs, items, k=10):
    low = lambda t: ls.TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, low(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            tf, m = Counter(b), 25 + 75 * len(b) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in low(text) if t in tf)
            if score:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_search(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("Ab cd É x1 y z éa Zz".split() + [f"w{i}" for i in range(40)]) for _ in range(n))
    docs = [(i, text(rng.randrange(30))) for i in range(120)] + [(200 + i, "same words here w1") for i in range(25)] + [(7, "w1 w1"), (7, "w1 w1"), (None, "w1 w1"), (None, "w2"), (500, None), (501, "...")]
    docs += [(600, "w3 " * 5000), (601, "w3")]
    items = [(1, "same w1 W1 w2"), (2, "AB cd É w3"), (3, None), (4, ""), (5, "absent"), (6, "w3"), (6, "w4 w5"), (None, "w6 here")]
    frame = spark.createDataFrame([(i, t, "en", "a", "b", "c", 1, 2, "i") for i, t in docs], DOC).repartition(5)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int")
    for size in (ls.ITEM_BYTES, 450):
        assert sorted(map(tuple, ls.search(frame, asked, item_bytes=size).collect()), key=str) == brute_search(docs, items)
    assert ls.search(frame.limit(0), asked).collect() == []
    assert ls.search(frame, asked.limit(0)).collect() == []


def test_exact_product_beyond_one_tile():
    rng = np.random.default_rng(6)
    items, impacts = rng.integers(0, 9, (7, 40)), rng.integers(0, 2**49, (40, 11))
    tiles = ls.term_tiles(items.max(axis=0) * impacts.max(axis=1))
    assert len(tiles) > 10 and [i for t in tiles for i in range(t.start, t.stop)] == list(range(40))
    want = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in impacts.T] for r in items]
    assert ls.exact_product(items, impacts).tolist() == want
    with pytest.raises(OverflowError):
        ls.term_tiles(np.array([2**53]))


def test_best_rows_keep_ties():
    scores, order = np.array([5, 0, 7, 5, 5, 5]), np.array([4, 0, 1, 2, 5, 3])
    assert ls.best_rows(scores, order, 3).tolist() == [2, 3, 5]
    assert ls.best_rows(scores[:2], order[:2], 3).tolist() == [0]


# Conversations.

FORM = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """After-damage rows of one table as conv -> [(turn, role, text)], by the words of the contract."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
        out[conv] += [row] * {0: 0, 3: 2}.get(code, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rs, key=order) for c, rs in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows, faults, most_inserts=2):
    """Least (cost, initials, repaired rows) over all edits, by listing them with full strings."""
    paths = {"": (0, "", [])}  # repaired initials reduced to what decides about the form
    reduce_form = lambda s: s if len(s) < 2 else ("s" if s[0] == "s" else "") + "ua" * ((len(s) - (s[0] == "s")) // 2 > 0) + "u" * ((len(s) - (s[0] == "s")) % 2)
    prefix = lambda s: re.fullmatch(r"s?(ua)*u?", s) is not None

    def put(new, form, cost, letters, out):
        if prefix(form):
            key = reduce_form(form)
            if key not in new or (cost, letters) < new[key][:2]:
                new[key] = (cost, letters, out)

    def with_inserts(paths):
        every = dict(paths)
        for form, (cost, letters, out) in paths.items():
            for n in range(1, most_inserts + 1):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    put(every, form + "".join(r[0] for r in roles), cost + 3 * n, letters + "I" * n, out + [f"{r}:" for r in roles])
        return every

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for form, (cost, letters, out) in with_inserts(paths).items():
            put(new, form, cost + 4, letters + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role:
                    put(new, form + role[0], cost + more, letters + "K", [*out, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    put(new, form + r[0], cost + 3 + more, letters + "R", [*out, f"{r}:{text}"])
        paths = new
    ends = [v for form, v in with_inserts(paths).items() if FORM.fullmatch(form)]
    return min(ends, key=lambda v: v[:2])


def brute_digest(table):
    after, out = damage(table), {}
    for conv in {r[0] for r in table}:
        rows = after.get(conv, [])
        faults = faults_of(rows)
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, text = brute_repair(rows, faults)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def exhaustive(rows, faults):
    """Every edit sequence with at most two inserts in a gap; least (cost, initials)."""
    best = None
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        for ops in itertools.product("DKR", repeat=len(rows)):
            for roles in itertools.product("ua", repeat=sum(gaps) + ops.count("R")):
                if any(f in ("blank", "duplicate") and o != "D" for f, o in zip(faults, ops)):
                    continue
                fill, letters, form, cost = iter(roles), "", "", 0
                for i in range(len(rows) + 1):
                    letters, cost = letters + "I" * gaps[i], cost + 3 * gaps[i]
                    form += "".join(next(fill) for _ in range(gaps[i]))
                    if i < len(rows):
                        letters += ops[i]
                        cost += {"D": 4, "K": 0, "R": 3}[ops[i]] + 3 * (ops[i] != "D" and faults[i] == "truncated")
                        form += {"D": "", "K": rows[i][1][:1] or "?", "R": None}[ops[i]] if ops[i] != "R" else next(fill)
                if FORM.fullmatch(form) and (best is None or (cost, letters) < best):
                    best = cost, letters
    return best


def searched(rows, faults, paths=None):
    paths, cost, letters, most = cr.Survivors(), 0, "", 0
    steps = []
    for (turn, role, text), fault in zip(rows, faults):
        paths.step(cr.moves(role[:1], fault), (0, turn, role, text, fault))
        steps += paths.settled()
    state = paths.choose({s: 3 * n for s, n in cr.CLOSE.items()})
    steps += paths.settled()
    found = list(cr._edits_of(steps))
    return sum(e[1] for e in found) + 3 * cr.CLOSE[state], "".join(e[0] for e in found) + "I" * cr.CLOSE[state]


def random_rows(rng, n, roles=("system", "user", "assistant", "tool", "")):
    return [(i, rng.choice(roles), rng.choice(["Yes.", "no", "", "Well!", "what", f"t{i}."])) for i in range(n)]


def test_repair_equals_all_edits():
    rng = random.Random(7)
    for n in (0, 1, 2, 2, 3):
        for _ in range(5):
            rows = random_rows(rng, n)
            faults = faults_of(rows)
            assert searched(rows, faults) == exhaustive(rows, faults) == brute_repair(rows, faults)[:2]
    for roles in (("system", "user", "assistant", "tool", ""), ("tool",), ("user",), ("assistant", "user"), ("tool", "system")):
        for _ in range(60):
            rows = random_rows(rng, rng.randrange(40), roles)
            faults = faults_of(rows)
            assert searched(rows, faults) == brute_repair(rows, faults)[:2]


def test_survivors_are_bounded():
    for roles in ("sua", "ua", "uat", "aau"):
        rng, paths, held = random.Random(8), cr.Survivors(), 0
        for i in range(20_000):
            paths.step(cr.moves(rng.choice(roles), rng.choice(["", "truncated", "duplicate"])), i)
            held += 1 - sum(1 for _ in paths.settled())
            assert held < 200


def conversations(seed):
    rng = random.Random(seed)
    table = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            table.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", ""]), rng.choice(["Hello there.", "ok", " ", None, "Why?", f"text {turn}!", "a.\n"])))
    table += [(3, None, "user", "undated."), (3, None, "user", "undated."), (4, 2, "user", "same turn."), (61, None, None, None)]
    table += [(70, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "no", f"n{t}."])) for t in range(400)]
    table += [(71, t, "tool", f"n{t}.") for t in range(150)] + [(72, None, "user", "x" * 30_000), (None, None, "user", "nobody.")]
    return table


@pytest.mark.parametrize("bits", [2, 5, 11])
def test_conversations(spark, bits):
    table = conversations(9)
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, th string, uid int").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.report(frame, bits).collect()}
    assert got == brute_digest(table)


def test_conversation_rows_and_empty(spark):
    table = conversations(10)
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    rows = cr.repair(frame, 5).orderBy("conv_id", "block", "at", "n").collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {c: v[-1] for c, v in brute_digest(table).items()}
    assert all(hashlib.sha256("\n".join(texts[c]).encode()).hexdigest() == sha for c, sha in want.items())
    assert cr.report(frame.where(F.lit(False))).collect() == []
