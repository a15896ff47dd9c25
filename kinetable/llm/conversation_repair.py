"""Conversation structure repair by generalised LR parsing with weighted edits.

The roles of a conversation must read ``(s?(ua)+)?``.  An SLR automaton is built from that grammar; parsing keeps
every stack alive that some sequence of edits leads to.  Stacks share what lies below, equal stack tops meet in
one node, and a node keeps the least ``(cost, audit)``.  A row is kept (0), reroled (1) or deleted (2), an empty
row can be inserted (5), and an undeleted truncated row costs 5 more.

Rows are dealt by ranges of ``(conv_id, turn)``, so a conversation with a third of all rows spreads over many tasks.
A conversation inside one task is repaired there.  One that crosses a border is cut into blocks; a block gives the
best edits from every stack it can start with to every stack it can end with, and a conversation's blocks are
composed in order.  Only these summaries meet, never the texts.

Defined cases: a null role or text reads as one space, a null turn sorts first and is left out of gaps and a null
``conv_id`` is a conversation of its own; rows of one turn are ordered by role and text; equal rows are counted
before they are dealt, the first stands and the others are duplicates.  A conversation without rows after the
damage gives zeros, an empty audit and no turns.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import _arrow_schema, sliced, written

c = F.col

# ---------------------------------------------------------------------- automaton and stacks

#: One letter a symbol: lower case for role initials, upper case for what they form; the first rule's left side is the start.
RULES = (("D", ""), ("D", "P"), ("D", "sP"), ("P", "ua"), ("P", "Pua"))
NAMES = {"u": "user", "a": "assistant"}
END = "$"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = 1, 2, 3


class Automaton:
    """SLR states of a grammar: where a symbol leads, and which rules end where."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = rules
        heads = {left for left, _ in rules}
        first: dict[str, set[str]] = {h: set() for h in heads}
        follow: dict[str, set[str]] = {h: set() for h in heads} | {rules[0][0]: {END}}
        for _ in range(2 * len(rules)):
            for left, right in rules:
                first[left] |= first.get(right[:1], set(right[:1]))
            for left, right in rules:
                for x, then in zip(right, [*right[1:], ""]):
                    if x in heads:
                        follow[x] |= first.get(then, {then}) if then else follow[left]
        self.follow = follow
        self.states: list[frozenset] = [self._closed({(i, 0) for i, r in enumerate(rules) if r[0] == rules[0][0]})]
        self.goto: dict[tuple[int, str], int] = {}
        for k, state in enumerate(self.states):  # grows while it is walked
            for x in sorted({rules[r][1][dot] for r, dot in state if dot < len(rules[r][1])}):
                to = self._closed({(r, dot + 1) for r, dot in state if rules[r][1][dot : dot + 1] == x})
                if to not in self.states:
                    self.states.append(to)
                self.goto[k, x] = self.states.index(to)

    def _closed(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            r, dot = todo.pop()
            for i, (left, _) in enumerate(self.rules):
                if self.rules[r][1][dot : dot + 1] == left and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def ended(self, state: int, ahead: str) -> list[tuple[str, int]]:
        """Rules that can be reduced in a state before the symbol ``ahead``: left side and length."""
        found = [self.rules[r] for r, dot in self.states[state] if dot == len(self.rules[r][1])]
        return [(left, len(right)) for left, right in found if ahead in self.follow[left]]


class Top:
    """A stack top: a state upon a shared node below.  Equal stacks are one object."""

    def __init__(self, machine: Automaton, state: int, below: Top | None = None):
        self.machine, self.state, self.below = machine, state, below
        self.above: dict[int, Top] = {}
        self.seen: dict[str, list[Top]] = {}
        self.ends: bool | None = None

    def push(self, state: int) -> Top:
        if state not in self.above:
            self.above[state] = Top(self.machine, state, self)
        return self.above[state]

    def reduced(self, ahead: str) -> Iterator[Top]:
        """This stack and all that reductions before ``ahead`` make of it."""
        yield self
        for left, length in self.machine.ended(self.state, ahead):
            base = self
            for _ in range(length):
                base = base.below
            to = self.machine.goto.get((base.state, left))
            if to is not None:
                yield from base.push(to).reduced(ahead)

    def after(self, symbol: str) -> list[Top]:
        """The stacks after one more symbol."""
        if symbol not in self.seen:
            goto = self.machine.goto
            self.seen[symbol] = [t.push(goto[t.state, symbol]) for t in self.reduced(symbol) if (t.state, symbol) in goto]
        return self.seen[symbol]

    def accepts(self) -> bool:
        """Whether the input may end here."""
        if self.ends is None:
            start = self.machine.rules[0][0]
            self.ends = any(left == start for t in self.reduced(END) for left, _ in self.machine.ended(t.state, END))
        return self.ends


def all_stacks() -> list[Top]:
    """Every stack between two rows; finitely many, as the grammar recurs on the left."""
    found = [Top(Automaton(RULES), 0)]
    for top in found:  # grows while it is walked
        found += [t for x in ("s", "u", "a") for t in top.after(x) if t not in found]
    return found


STACKS = all_stacks()

Frontier = dict[Top, tuple[int, str]]


def inserted(now: Frontier) -> Frontier:
    """With every number of inserted rows that pays."""
    out, todo = dict(now), list(now)
    while todo:
        top = todo.pop()
        cost, audit = out[top]
        for x in NAMES:
            for to in top.after(x):
                if to not in out or (cost + INSERT, audit + "I") < out[to]:
                    out[to] = (cost + INSERT, audit + "I")
                    todo.append(to)
    return out


def read(now: Frontier, initial: str, fault: int) -> Frontier:
    """All stacks after a row was deleted, kept or reroled; equal tops keep the least (cost, audit)."""
    out: Frontier = {}
    edits = [(x, REROLE, "R") for x in NAMES if x != initial] + ([(initial, 0, "K")] if initial else [])
    more = TRUNCATED if fault == TRUNCATED_ROW else 0
    for top, (cost, audit) in inserted(now).items():
        found = [(top, (cost + DELETE, audit + "D"))]
        if fault not in (BLANK_ROW, DUPLICATE_ROW):
            found += [(to, (cost + price + more, audit + mark)) for x, price, mark in edits for to in top.after(x)]
        for to, value in found:
            if to not in out or value < out[to]:
                out[to] = value
    return out


def ended(now: Frontier) -> tuple[int, str]:
    """The least (cost, audit) of all stacks with which the conversation may end."""
    return min(v for t, v in inserted(now).items() if t.accepts())


def summary(rows: list[tuple[str, int, int]], start: int) -> Frontier:
    """Best edits of rows (initial, fault, number of equal rows) from one stack to every other."""
    now: Frontier = {STACKS[start]: (0, "")}
    for initial, fault, n in rows:
        now = read(now, initial, fault)
        if n > 1:
            now = {t: (cost + DELETE * (n - 1), audit + "D" * (n - 1)) for t, (cost, audit) in now.items()}
    return now


def ways(rows: list[tuple[str, int, int]]) -> list[dict]:
    """Best edits of a block between any two stacks, by their numbers."""
    number = {t: i for i, t in enumerate(STACKS)}
    return [{"start": s, "stop": number[t], "cost": v[0], "audit": v[1]} for s in range(len(STACKS)) for t, v in summary(rows, s).items()]


def closing(stack: int) -> tuple[int, str]:
    """The least (cost, audit) with which a conversation ends from a stack."""
    return ended({STACKS[stack]: (0, "")})


def rebuilt(roles: list[str], texts: list[str], copies: list[int], audit: str, start: int) -> list[tuple[str, str]]:
    """The turns that the edits leave, from the stack at their start on."""
    out: list[tuple[str, str]] = []
    at, turn = 0, "a" if STACKS[start].after("a") else "u"
    rows = [i for i, n in enumerate(copies) for _ in range(n)]
    for mark in audit:
        if mark != "D":
            i = rows[at] if mark != "I" else -1
            role = roles[i] if mark == "K" else NAMES[turn]
            out.append((role, "" if mark == "I" else texts[i]))
            turn = "a" if role[:1] == "u" else "u"
        at += mark != "I"
    return out


# -------------------------------------------------------------------------------------- rows

SPACES = " \t\n\x0b\f\r"


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the contract, by ``crc32(conv_id:turn) % 20``; ``n`` counts equal rows, 0 where all were dropped."""
    read_as = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(read_as("conv_id"), F.lit(":"), read_as("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(read_as("text"), ".!?", "")).otherwise(read_as("text"))
    role = F.when(kind == 4, "user").otherwise(read_as("role"))
    n = F.when(kind == 3, 2).otherwise(1)
    gone = kind == 0  # a dropped row only says that its conversation exists
    return rows.select("conv_id", F.when(~gone, c("turn")).alias("turn"), *[F.when(gone, "").otherwise(x).alias(a) for x, a in ((role, "role"), (text, "text"))], F.when(gone, 0).otherwise(n).cast("bigint").alias("n"))


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the shape that ``repair`` takes."""
    read_as = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", read_as("role").alias("role"), read_as("text").alias("text"), F.lit(1).cast("bigint").alias("n"))


def _fault(later: Column) -> Column:
    """A row's first fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    end = F.rtrim(c("text"), F.lit(SPACES))
    return F.when(end == "", BLANK_ROW).when(later, DUPLICATE_ROW).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED_ROW).otherwise(0)


def _judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and each row's first fault."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("_said", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    counted = written(counted, "turns")
    place = F.struct(c("turn").isNotNull().alias("known"), c("turn").alias("turn"))
    first = counted.filter("n > 0").groupBy(c("conv_id").alias("_conv"), c("_said").alias("_what")).agg(F.min(place).alias("_first"))
    met = counted.join(first, c("conv_id").eqNullSafe(c("_conv")) & (c("_said") == c("_what")), "left")
    later = F.coalesce(~place.eqNullSafe(c("_first")), F.lit(False))
    return met.select("conv_id", "turn", "role", "text", "n", _fault(later).alias("fault"))


#: A block ends at so many rows or bytes of text.
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 20

_STATS = "rows bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string"
_STAT_NAMES = [x.split()[0] for x in _STATS.split(", ")]
_LEGAL = {"su", "ua", "au"}


class _Block:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, turn, role: str, text: str, n: int, fault: int) -> None:
        self.rows.append((turn, role, text, n, fault))
        self.bytes += len(text)

    def full(self, rows: int, size: int) -> bool:
        return len(self.rows) >= rows or self.bytes >= size

    def stats(self) -> dict:
        turns = [r[0] for r in self.rows if r[0] is not None and r[3]]
        present = [r for r in self.rows if r[3]]
        faults = {k: sum((r[4] == k) * (r[3] if k == BLANK_ROW else 1) for r in present) for k in (BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW)}
        faults[DUPLICATE_ROW] += sum((r[3] - 1) * (r[4] != BLANK_ROW) for r in present)
        pairs = sum(x[1][:1] + y[1][:1] not in _LEGAL for x, y in zip(present, present[1:])) + sum(r[3] - 1 for r in present)
        ends = [present[0][1][:1], present[-1][1][:1]] if present else [None, None]
        return dict(zip(_STAT_NAMES, (sum(r[3] for r in present), min(turns, default=None), max(turns, default=None), len(set(turns)), *[faults[k] for k in (BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW)], pairs, *ends)))

    def symbols(self) -> list[tuple[str, int, int]]:
        return [(r[1][:1] if r[1][:1] in ("s", "u", "a") else "", r[4], r[3]) for r in self.rows if r[3]]

    def columns(self) -> dict:
        present = [r for r in self.rows if r[3]]
        return {"roles": [r[1] for r in present], "texts": [r[2] for r in present], "copies": [r[3] for r in present]}


def joined(a: dict, b: dict) -> dict:
    """The figures of two neighbouring stretches as one."""
    if not a["rows"] or not b["rows"]:
        return b if not a["rows"] else a
    out = {k: a[k] + b[k] for k in ("rows", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += a["last"] + b["first"] not in _LEGAL
    known = [x for x in (a["low"], b["low"], a["high"], b["high"]) if x is not None]
    return out | {"low": min(known, default=None), "high": max(known, default=None), "first": a["first"], "last": b["last"]}


_TURNS = "array<struct<role: string, text: string>>"


def _pieces(judged: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """A row a block.  Conversations within one block and task are repaired at once; others give summaries."""
    conv = judged.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, part int, block int, {_STATS}, cost bigint, audit string, repaired {_TURNS}, ways array<struct<start: int, stop: int, cost: bigint, audit: string>>, roles array<string>, texts array<string>, copies array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0

        def told(conv_id, block: _Block, whole: bool) -> dict:
            nonlocal at
            at += 1
            row = {"conv_id": conv_id, "part": part, "block": at} | block.stats()
            symbols, columns = block.symbols(), block.columns()
            if whole:
                cost, audit = ended(summary(symbols, 0))
                turns = rebuilt(*columns.values(), audit, 0)
                return row | {"cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in turns]}
            return row | {"ways": ways(symbols)} | columns

        key, block, whole, known = None, None, False, False
        out: list[dict] = []
        for batch in batches:
            for group in sliced(batch):
                for conv_id, *row in zip(*[group.column(i).to_pylist() for i in range(group.num_columns)]):
                    if not known or conv_id != key:
                        if known:
                            out.append(told(key, block, whole))
                        key, block, whole, known = conv_id, _Block(), known, True  # the first may have begun in the task before
                    elif block.full(block_rows, block_bytes):
                        out.append(told(key, block, False))
                        block, whole = _Block(), False
                    block.add(*row)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if known:  # and the last may go on in the next one
            yield pa.RecordBatch.from_pylist([told(key, block, False)], schema=target)

    target = _arrow_schema(judged.sparkSession, schema)
    order = ["conv_id", "turn", "role", "text"]
    dealt = judged.repartitionByRange(int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return dealt.select(*order, "n", "fault").mapInArrow(run, schema)


def _composed(pieces: DataFrame) -> DataFrame:
    """One row a cut conversation: its figures, least (cost, audit), and each block's share of the edits."""
    conv = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, {_STATS}, cost bigint, audit string, shares array<struct<part: int, block: int, start: int, edits: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key, stats: dict, now: dict) -> pa.RecordBatch:
            # an insertion at the end belongs to the last block
            best = min((cost + more, audit + marks, path) for top, (cost, audit, path) in now.items() for more, marks in [closing(top)])
            shares, at = [], 0
            for i, (part, block, start, length) in enumerate(best[2]):
                end = at + length if i + 1 < len(best[2]) else len(best[1])
                shares.append({"part": part, "block": block, "start": start, "edits": best[1][at:end]})
                at = end
            return pa.RecordBatch.from_pylist([{"conv_id": key} | stats | {"cost": best[0], "audit": best[1], "shares": shares}], schema=target)

        key, known, stats, now = None, False, {}, {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                if not known or row["conv_id"] != key:
                    if known:
                        yield told(key, stats, now)
                    key, known, stats, now = row["conv_id"], True, {"rows": 0}, {0: (0, "", ())}
                stats = joined(stats, {n: row[n] for n in _STAT_NAMES})
                after: dict = {}
                for way in row["ways"]:
                    if way["start"] in now:
                        cost, audit, path = now[way["start"]]
                        found = (cost + way["cost"], audit + way["audit"], (*path, (row["part"], row["block"], way["start"], len(way["audit"]))))
                        if way["stop"] not in after or found < after[way["stop"]]:
                            after[way["stop"]] = found
                now = after
        if known:
            yield told(key, stats, now)

    target = _arrow_schema(pieces.sparkSession, schema)
    dealt = pieces.select("conv_id", "part", "block", *_STAT_NAMES, "ways").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return dealt.mapInArrow(run, schema)


def _spoken(pieces: DataFrame, composed: DataFrame) -> DataFrame:
    """The repaired turns of the cut conversations, a row a block."""
    shares = composed.select(F.explode("shares").alias("_s")).select(c("_s.part").alias("_part"), c("_s.block").alias("_block"), c("_s.start").alias("start"), c("_s.edits").alias("edits"))
    met = pieces.join(shares, (c("part") == c("_part")) & (c("block") == c("_block"))).select("conv_id", "part", "block", "roles", "texts", "copies", "edits", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in sliced(batch):
                turns = [[{"role": a, "text": b} for a, b in rebuilt(*row)] for row in zip(*[one.column(i).to_pylist() for i in range(3, 8)])]
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), pa.array(turns, target.field(3).type)], schema=target)

    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, part int, block int, repaired {_TURNS}"
    target = _arrow_schema(pieces.sparkSession, schema)
    return met.mapInArrow(run, schema)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of rows ``conv_id, turn, role, text, n``: a report and the repaired turns.

    The report has one row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.  The
    turns are ``conv_id, part, block, repaired``, in the order of part and block; long conversations have several.
    """
    pieces = written(_pieces(_judged(rows), block_rows, block_bytes), "pieces")
    whole, cut = pieces.filter("audit IS NOT NULL"), pieces.filter("audit IS NULL")
    composed = written(_composed(cut), "composed")
    names = ["conv_id", *_STAT_NAMES, "cost", "audit"]
    both = whole.select(*names).unionByName(composed.select(*names))
    gaps = F.coalesce(c("high") - c("low") + 1 - c("turns"), F.lit(0)).cast("bigint")
    report = both.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, whole.select("conv_id", "part", "block", "repaired").unionByName(_spoken(cut, composed))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the newline-joined ``role:text``.

    A digest needs its conversation's text in order: one task streams it, a block at a time, and holds no more.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, digest, begun = None, False, hashlib.sha256(), False
        out: list[tuple] = []
        for batch in batches:
            for one in sliced(batch):
                for conv_id, repaired in zip(one.column(0).to_pylist(), one.column(1).to_pylist()):
                    if not known or conv_id != key:
                        if known:
                            out.append((key, digest.hexdigest()))
                        key, known, digest, begun = conv_id, True, hashlib.sha256(), False
                    for turn in repaired:
                        digest.update(f"{chr(10) * begun}{turn['role']}:{turn['text']}".encode())
                        begun = True
            if out:
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([k for k, _ in out], batch.schema.field(0).type), "repaired_sha256": [d for _, d in out]})
                out = []
        if known:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key], batch.schema.field(0).type), "repaired_sha256": [digest.hexdigest()]})

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return dealt.select("conv_id", "repaired").mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def report(conversations: DataFrame, change=damaged, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The report with the digest of each conversation's repaired text."""
    found, turns = repair(change(conversations.select("conv_id", "turn", "role", "text")), block_rows, block_bytes)
    hashes = digests(turns).withColumnRenamed("conv_id", "_conv")
    return found.join(hashes, c("conv_id").eqNullSafe(c("_conv"))).drop("_conv")


# ------------------------------------------------------------------------------------ SQL


def oracle_sql() -> str:
    """The contract as a recursion over suffixes of each conversation: best edits from every grammar state, rows last to first."""
    def then(cost: str, mark: str, said: str, state: str) -> str:
        return f"{{'c': {cost} + {state}.c, 'a': '{mark}' || {state}.a, 'o': list_concat({said}, {state}.o)}}"

    def least(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda v: v IS NOT NULL))[1]"

    def stays(x: str, state: str) -> str:
        keep, change = then("late", "K", "[role || ':' || txt]", state), then("1 + late", "R", f"['{NAMES[x]}:' || txt]", state)
        return f"CASE WHEN stays THEN CASE WHEN x = '{x}' THEN {keep} ELSE {change} END END"

    gone = lambda s: then("2", "D", "[]::VARCHAR[]", s)
    add = lambda x, s: then("5", "I", f"['{NAMES[x]}:']", s)
    system = f"CASE WHEN stays AND x = 's' THEN {then('late', 'K', '''[role || ':' || txt]''', 's1')} END"
    rows = {"b0": least(gone("s0"), system, stays("u", "s2")), "b1": least(gone("s1"), stays("u", "s2")), "b2": least(gone("s2"), stays("a", "s3")), "b3": least(gone("s3"), stays("u", "s2"))}
    both = "{'c': 10 + b3.c, 'a': 'II' || b3.a, 'o': list_concat(['user:', 'assistant:'], b3.o)}"
    states = {"s0": least("b0", add("u", "b2"), both), "s1": least("b1", add("u", "b2"), both), "s2": least("b2", add("a", "b3")), "s3": least("b3", add("u", "b2"))}
    kind = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
    ends = {"s0": "{'c': 0, 'a': '', 'o': []}", "s1": "{'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']}", "s2": "{'c': 5, 'a': 'I', 'o': ['assistant:']}", "s3": "{'c': 0, 'a': '', 'o': []}"}
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE tab AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda h: ascii(h)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS kind FROM conversations, tab),
rws AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS rep FROM given),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, rep) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(txt, {blank}) AS fin FROM rws),
judged AS (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'd' WHEN fin[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM ordered),
best AS (SELECT conv_id, n + 1 AS i, {', '.join(f"{v}::{kind} AS {k}" for k, v in ends.items())} FROM (SELECT DISTINCT conv_id, n FROM ordered)
 UNION ALL SELECT conv_id, i, {', '.join(f"{v}::{kind} AS {k}" for k, v in states.items())} FROM (SELECT conv_id, i, {', '.join(f"{v} AS {k}" for k, v in rows.items())} FROM
  (SELECT j.conv_id, j.i, j.role, j.txt, j.x, j.fault NOT IN ('b', 'd') AS stays, CASE WHEN j.fault = 't' THEN 5 ELSE 0 END AS late, b.s0, b.s1, b.s2, b.s3 FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1))),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
 count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
 sha256(coalesce(array_to_string(s0.o, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1"""
