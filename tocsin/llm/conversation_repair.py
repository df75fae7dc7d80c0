"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

A conversation is a row of turns; the repaired one has role initials ``(s?(ua)+)?``. Rows are
kept (0), get the role user or assistant (3) or are deleted (4; blank rows and repeats have to
be), rows without text are put in anywhere (3), and a truncated row that stays costs 3 more. Of
the cheapest edits those with the ASCII-least initials are taken.

The search has four states (start, after system, after user, after assistant). Inserts belong
to the row after them, so that at a boundary no survivor's initials are a prefix of another's
and the order of two survivors is settled where their paths part. ``Survivors`` keeps the paths
as a tree of back pointers with reference counts: a path that dies frees its nodes, and as soon
as all survivors share an ancestor the steps up to it are final and are handed on. Two tied
candidates walk back to the step where they part, over all unresolved steps. A survivor that is
beaten even if the rest is as much dearer for the other as it can be dies at once; without that
the path that deletes everything would never coalesce. So a task streams through conversations
of any length and holds what is unresolved.

1. Damaged rows are stored with a number; repeats are found by a grouped minimum per
   conversation, role and text hash, not in the stream.
2. Conversations of at most ``BLOCK`` rows go by conv_id to a task that streams them.
3. Longer ones are range-sorted by turn, which splits a conversation over many tasks, and cut
   into blocks of at most ``BLOCK`` rows. For each block and each state at its start the costs
   of all states at its end and the order of their initials are computed. A second search over
   these small matrices, again by survivors, gives each block the states at its ends, and the
   blocks are then repaired independently. Only the digest of the result, SHA-256, which cannot
   be split, streams through a long conversation in one task, in constant memory but for the
   string of initials that it returns.

Defined results: a null role or text is one space, and a null conv_id or turn in the damage key
is, too. Null conv_ids are one conversation. Rows of equal turn stand in the order of role, text
hash and number; rows that are equal in all of these are interchangeable. An empty role has no
initial and cannot be kept. Conversations without rows after the damage have zeros, empty
initials and the hash of the empty text. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import broadcast_counted, materialize, row_count

#: Log2 of the rows of a block; conversations of more rows are split.
BLOCK_BITS = 11
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or renamed row.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that complete a conversation from each state.
CLOSE = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the rest of a conversation costs at most more from the first state than from the second: a
#: system row is deleted instead of kept, a row is inserted, or an empty end needs two inserts.
BEHIND = {
    (START, SYSTEM): 0, (START, USER): 3, (START, ASSISTANT): 0, (SYSTEM, START): 6, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6,
    (USER, START): 7, (USER, SYSTEM): 3, (USER, ASSISTANT): 3, (ASSISTANT, START): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3,
}
FAULTS = ("", "blank", "duplicate", "truncated")
SPACE = r"\x20\x09-\x0D"


def after_kept(state: int, initial: str) -> int | None:
    """State after a kept row, None where the form does not allow it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


@cache
def moves(initial: str, fault: str) -> list[tuple[int, int, str, int]]:
    """(state before, state after, initials, cost) of the best way between two states over a row."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state = before
        for inserts in range(3):
            ways = [(state, "D", DELETE)]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED * (fault == "truncated")
                ways += [(NEXT[state], "R", RENAME + more), (after_kept(state, initial), "K", more)]
            for after, letter, cost in ways:
                if after is not None:
                    found = (cost + INSERT * inserts, "I" * inserts + letter)
                    best[before, after] = min(best.get((before, after), found), found)
            state = NEXT[state]
    return [(before, after, key, cost) for (before, after), (cost, key) in best.items()]


class _Step:
    """Node of the tree of back pointers; ``refs`` counts its children and whether it survives."""
    __slots__ = ("item", "key", "parent", "refs", "state")

    def __init__(self, parent, state, key, item):
        self.parent, self.state, self.key, self.item, self.refs = parent, state, key, item, 0


def _parts_before(a: _Step, b: _Step) -> int:
    """Order of two paths of equal length, by the keys of the steps where they part."""
    while a.parent is not b.parent:
        a, b = a.parent, b.parent
    return (a.key > b.key) - (a.key < b.key)


class Survivors:
    """Cheapest path into every state, ties by the least keys; hands on what is settled."""

    def __init__(self, state: int = START):
        self.root = _Step(None, state, None, None)
        self.root.refs = 1
        self.best = {state: (0, self.root)}

    def step(self, ways: list[tuple[int, int, object, int]], item=None) -> None:
        chosen: dict[int, tuple[int, _Step, object]] = {}
        for before, after, key, cost in ways:
            if before not in self.best:
                continue
            total, path = self.best[before]
            total += cost
            if after in chosen:
                least, other, its_key = chosen[after]
                if total > least:
                    continue
                if total == least:
                    order = _parts_before(path, other) if path is not other else (key > its_key) - (key < its_key)
                    if order >= 0:
                        continue
            chosen[after] = (total, path, key)
        old, self.best = self.best, {}
        beaten = {s for s, (c, _, _) in chosen.items() if any(t != s and other + BEHIND[t, s] < c for t, (other, _, _) in chosen.items())}
        for after, (total, path, key) in chosen.items():
            if after in beaten:
                continue
            node = _Step(path, after, key, item)
            node.refs = 1
            path.refs += 1
            self.best[after] = (total, node)
        for _, node in old.values():
            self._drop(node)

    def _drop(self, node: _Step) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            node = node.parent
            node.refs -= 1

    def order(self) -> dict[int, int]:
        """Rank of each state's path, by keys alone."""
        ranked = sorted(self.best, key=cmp_to_key(lambda s, t: _parts_before(self.best[s][1], self.best[t][1]) if s != t else 0))
        return {state: i for i, state in enumerate(ranked)}

    def choose(self, ends: dict[int, int]) -> int:
        """Keeps the best path with the costs ``ends`` of the allowed last states; returns that state."""
        order = self.order()
        state = min((s for s in self.best if s in ends), key=lambda s: (self.best[s][0] + ends[s], order[s]))
        for other in [s for s in self.best if s != state]:
            self._drop(self.best.pop(other)[1])
        return state

    def settled(self) -> Iterator[tuple[int, int, object, object]]:
        """(state before, state after, key, item) of the steps that all survivors share, freed as they go."""
        if self.root.refs > 1:
            return
        path, node = [], next(iter(self.best.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.refs == 1:
            node = path.pop()
            yield self.root.state, node.state, node.key, node.item
            node.parent, self.root = None, node


# Steps on Spark.


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; a row number ``uid`` and the text's hash ``th``."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    rows = rows.withColumn("code", F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
    return rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("th", F.unhex(F.sha2("text", 256)))


def _earlier(rows: DataFrame) -> Column:
    return F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "uid")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds the first fault of every stored row: blank, duplicate, truncated or ''."""
    groups = rows.groupBy("conv_id", "role", "th").agg(F.count(F.lit(1)).alias("n"), F.min(_earlier(rows)).alias("first")).where("n > 1")
    groups = materialize(groups.select(F.col("conv_id").alias("g_conv"), F.col("role").alias("g_role"), F.col("th").alias("g_th"), F.col("first.uid").alias("first")), "repeats")
    same = F.col("conv_id").eqNullSafe(F.col("g_conv")) & (F.col("role") == F.col("g_role")) & (F.col("th") == F.col("g_th"))
    joined = rows.join(broadcast_counted(groups), same, "left")
    fault = (F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank")
             .when(F.col("first") != F.col("uid"), "duplicate")
             .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated").otherwise(""))
    return joined.select("conv_id", "turn", "role", "text", "uid", "th", fault.alias("fault"))


_ROW = ["conv_id", "block", "at", "turn", "role", "text", "fault", "start", "goal", "close"]
_EDIT = "block long, at long, n long, edit string, cost int, turn long, was string, fault string, role string, text string"


def _streamed(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _schema(conv_type: pa.DataType, **fields) -> pa.Schema:
    return pa.schema([("conv_id", conv_type), *fields.items()])


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


_ROLES = {USER: "user", ASSISTANT: "assistant"}


def _edits_of(steps) -> Iterator[tuple]:
    """(edit, cost, at, turn, was, fault, role, text) of settled steps."""
    for state, _, letters, (at, turn, role, text, fault) in steps:
        for letter in letters[:-1]:
            state = NEXT[state]
            yield letter, INSERT, at, None, None, None, _ROLES[state], ""
        more = TRUNCATED * (fault == "truncated")
        if letters[-1] == "D":
            yield "D", DELETE, at, turn, role[:1], fault, None, None
        elif letters[-1] == "K":
            yield "K", more, at, turn, role[:1], fault, role, text
        else:
            yield "R", RENAME + more, at, turn, role[:1], fault, _ROLES[NEXT[state]], text


def _repaired(schema: pa.Schema):
    """mapInArrow over rows sorted by conversation, block and place: the edits, in order."""
    def edits(batches):
        conv, block, paths, n, last = None, None, None, 0, None

        def out(steps):
            nonlocal n
            for edit, cost, at, turn, was, fault, role, text in _edits_of(steps):
                n += 1
                yield conv, block, at, n, edit, cost, turn, was, fault, role, text

        def ended():
            nonlocal n
            at, goal, close = last
            state = paths.choose({s: INSERT * k for s, k in CLOSE.items()} if goal < 0 else {goal: 0})
            yield from out(paths.settled())
            for _ in range(CLOSE[state] if close else 0):
                n, state = n + 1, NEXT[state]
                yield conv, block, at, n, "I", INSERT, None, None, None, _ROLES[state], ""

        for c, b, at, turn, role, text, fault, start, goal, close in _streamed(batches, _ROW):
            if paths is None or c != conv or b != block:
                if paths is not None:
                    yield from ended()
                conv, block, paths, n = c, b, Survivors(start), 0
            last = (at, goal, close)
            paths.step(moves(role[:1], fault), (at, turn, role, text, fault))
            yield from out(paths.settled())
        if paths is not None:
            yield from ended()

    return lambda batches: _batches(edits(batches), schema)


def _matrices(schema: pa.Schema):
    """mapInArrow over sorted rows: costs and ranks, 4 by 4, of every block of a conversation."""
    def blocks(batches):
        conv, block, runs = None, None, None

        def ended():
            cost, rank = [-1] * 16, [-1] * 16
            for start, run in enumerate(runs):
                for state, place in run.order().items():
                    cost[4 * start + state], rank[4 * start + state] = run.best[state][0], place
            return conv, block, cost, rank

        for c, b, role, fault in _streamed(batches, ["conv_id", "block", "role", "fault"]):
            if runs is None or c != conv or b != block:
                if runs is not None:
                    yield ended()
                conv, block, runs = c, b, [Survivors(s) for s in range(4)]
            for run in runs:
                run.step(moves(role[:1], fault))
                for _ in run.settled():
                    pass
        if runs is not None:
            yield ended()

    return lambda batches: _batches(blocks(batches), schema)


def _routes(schema: pa.Schema):
    """mapInArrow over the matrices sorted by conversation and block: states at the ends of every block."""
    def routes(batches):
        conv, paths = None, None

        def ended():
            paths.choose({s: INSERT * k for s, k in CLOSE.items()})
            steps = list(paths.settled())
            for i, (before, after, _, block) in enumerate(steps):
                yield conv, block, before, after, i == len(steps) - 1

        for c, block, cost, rank in _streamed(batches, ["conv_id", "block", "cost", "rank"]):
            if paths is None or c != conv:
                if paths is not None:
                    yield from ended()
                conv, paths = c, Survivors()
            # the last step stays unsettled until the end of the conversation is known
            yield from ((conv, item, before, after, False) for before, after, _, item in paths.settled())
            paths.step([(i // 4, i % 4, rank[i], cost[i]) for i in range(16) if cost[i] >= 0], block)
        if paths is not None:
            yield from ended()

    return lambda batches: _batches(routes(batches), schema)


def _ddl(df: DataFrame, fields: str) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {fields}"


_ORDER = ["conv_id", "turn", "role", "th", "uid"]


def _split_edits(rows: DataFrame, block_bits: int) -> DataFrame:
    """Edits of long conversations, block by block."""
    kind = _arrow_type(rows)
    placed = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("block", F.shiftright("at", block_bits)), "long-conversations")
    sort = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    small = placed.select("conv_id", "block", "at", F.substring("role", 1, 1).alias("role"), "fault")
    numbers = pa.list_(pa.int32())
    tables = sort(small).mapInArrow(_matrices(_schema(kind, block=pa.int64(), cost=numbers, rank=numbers)), _ddl(rows, "block long, cost array<int>, rank array<int>"))
    ways = tables.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    schema = _schema(kind, block=pa.int64(), start=pa.int32(), goal=pa.int32(), close=pa.bool_())
    routes = materialize(ways.mapInArrow(_routes(schema), _ddl(rows, "block long, start int, goal int, close boolean")), "routes")
    routes = routes.select(F.col("conv_id").alias("r_conv"), F.col("block").alias("r_block"), "start", "goal", "close")
    met = placed.join(broadcast_counted(routes), F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("block") == F.col("r_block")))
    return sort(met.select(*_ROW)).mapInArrow(_repaired(_edit_schema(kind)), _ddl(rows, _EDIT))


def _edit_schema(kind: pa.DataType) -> pa.Schema:
    text = pa.string()
    return _schema(kind, block=pa.int64(), at=pa.int64(), n=pa.int64(), edit=text, cost=pa.int32(), turn=pa.int64(), was=text, fault=text, role=text, text=text)


def edits(rows: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame | None]:
    """Edits of stored rows (as ``damaged`` gives them): of short conversations, in order within a
    partition, and of long ones (None if there are none).

    Columns: conv_id; block, at, n (their order); edit (K, R, D or I), cost; turn, was, fault (of
    the row: initial of its role); role, text (repaired, null for D).
    """
    flagged = with_faults(rows)
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (1 << block_bits))
    long_ones = materialize(counts.select(F.col("conv_id").alias("l_conv")), "long")
    same = F.col("conv_id").eqNullSafe(F.col("l_conv"))
    short = flagged
    if row_count(long_ones):
        short = flagged.join(broadcast_counted(long_ones), same, "left_anti")
    whole = short.repartition("conv_id").sortWithinPartitions(*_ORDER).withColumn("at", F.monotonically_increasing_id())
    whole = whole.select("*", F.lit(0).cast("long").alias("block"), F.lit(START).alias("start"), F.lit(-1).alias("goal"), F.lit(True).alias("close")).select(*_ROW)
    found = whole.mapInArrow(_repaired(_edit_schema(_arrow_type(rows))), _ddl(rows, _EDIT))
    if not row_count(long_ones):
        return found, None
    return found, _split_edits(flagged.join(broadcast_counted(long_ones), same, "left_semi"), block_bits)


def repair(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The repaired rows of damaged conversations: conv_id, block, at, n, edit, role, text."""
    short, long_ones = edits(materialize(damaged(conversations), "damaged"), block_bits)
    every = short if long_ones is None else short.union(long_ones)
    return every.where("edit <> 'D'").select("conv_id", "block", "at", "n", "edit", "role", "text")


_DIGEST = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def _digested(schema: pa.Schema):
    """mapInArrow over edits in order: one row per conversation."""
    def rows(batches):
        conv, state = None, None

        def ended():
            faults, numbers, letters, sha = state["faults"], state, "".join(state["letters"]), state["sha"]
            gaps = numbers["top"] - numbers["low"] + 1 - numbers["turns"] if numbers["turns"] else 0
            return (conv, gaps, *(faults[f] for f in FAULTS[1:]), numbers["illegal"], numbers["cost"], letters, sha.hexdigest())

        for c, edit, cost, turn, was, fault, role, text in _streamed(batches, ["conv_id", "edit", "cost", "turn", "was", "fault", "role", "text"]):
            if state is None or c != conv:
                if state is not None:
                    yield ended()
                conv = c
                state = {"faults": dict.fromkeys(FAULTS, 0), "low": None, "top": None, "turns": 0, "illegal": 0, "cost": 0, "letters": [], "sha": hashlib.sha256(), "was": None, "first": True}
            state["letters"].append(edit)
            if len(state["letters"]) > 100_000:
                state["letters"] = ["".join(state["letters"])]
            state["cost"] += cost
            if edit != "I":
                state["faults"][fault] += 1
                if state["was"] is not None and state["was"] + was not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["was"] = was
                if turn is not None and turn != state["top"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["top"], state["turns"] = turn, state["turns"] + 1
            if edit != "D":
                state["sha"].update((("" if state["first"] else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                state["first"] = False
        if state is not None:
            yield ended()

    return lambda batches: _batches(rows(batches), schema)


def report(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per original conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    short, long_ones = edits(materialize(damaged(conversations), "damaged"), block_bits)
    schema, ddl = _schema(_arrow_type(short), **_DIGEST), _ddl(short, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    out = short.mapInArrow(_digested(schema), ddl)
    if long_ones is not None:
        ordered = long_ones.repartition("conv_id").sortWithinPartitions("conv_id", "block", "n")
        out = out.union(ordered.mapInArrow(_digested(schema), ddl))
    names = conversations.select(F.col("conv_id").alias("name")).distinct()
    out = names.join(out, F.col("name").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("name").alias("conv_id"), *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
