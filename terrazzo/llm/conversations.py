"""Conversation structure repair by generalised LR parsing with weighted edits.

The role grammar is  S -> B | empty,  B -> H u a | B u a,  H -> s | empty.  Its LR tables are small: after every reduction
one of five states is on top of the stack, and each has one stack below it. The parser keeps a graph-structured stack:
a node for each top that some sequence of edits reaches, with the least (cost, audit) of all that do. A row is
kept, given another role or deleted, turns may be inserted before it, and nodes with equal tops are merged.

Rows lie in ranges of (conversation, turn), so a conversation of any size is parsed in pieces at the same time: a piece
that may continue an earlier one is parsed from each of the five tops. The pieces of a conversation are then
joined at their tops, and the repaired text, which a digest has to read in order, streams through once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.order import laid_out
from .common import ddl

KEEP, DELETE, REROLE, INSERT = "K", "D", "R", "I"
COST = {KEEP: 0, DELETE: 2, REROLE: 1, INSERT: 5}
#: What a truncated row costs unless it is deleted.
TRUNCATED_COST = 5
ROLES = {"u": "user", "a": "assistant"}

#: A rule's left side, and its right side's symbols.
GRAMMAR = (("S", ("B",)), ("S", ()), ("B", ("H", "u", "a")), ("B", ("B", "u", "a")), ("H", ("s",)), ("H", ()))
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


class Tables:
    """SLR tables of GRAMMAR: shifts and gotos by (state, symbol), and the rules that a state reduces by at a lookahead ('$': the end)."""

    def __init__(self, grammar: tuple = GRAMMAR):
        self.grammar = grammar
        self.left = {a for a, _ in grammar}
        self.states: list[frozenset] = [self._closed({(r, 0) for r, (a, _) in enumerate(grammar) if a == grammar[0][0]})]
        self.go: dict[tuple[int, str], int] = {}
        for i, state in enumerate(self.states):  # grows
            for x in sorted({grammar[r][1][d] for r, d in state if d < len(grammar[r][1])}):
                to = self._closed({(r, d + 1) for r, d in state if grammar[r][1][d : d + 1] == (x,)})
                if to not in self.states:
                    self.states.append(to)
                self.go[i, x] = self.states.index(to)
        follow = self._follow()
        self.reduce = {(i, x): r for i, state in enumerate(self.states) for r, d in state if d == len(grammar[r][1]) for x in follow[grammar[r][0]]}

    def _closed(self, items: set) -> frozenset:
        items = set(items)
        while True:
            new = {(r, 0) for q, d in items for r, (a, _) in enumerate(self.grammar) if self.grammar[q][1][d : d + 1] == (a,)} - items
            if not new:
                return frozenset(items)
            items |= new

    def _follow(self) -> dict[str, set]:
        empty, first = set(), {a: set() for a in self.left}
        follow = {a: set() for a in self.left}
        follow[self.grammar[0][0]].add("$")
        of = lambda x: first[x] if x in self.left else {x}
        for _ in range(len(self.grammar) * 4):
            for a, right in self.grammar:
                for x in right:
                    first[a] |= of(x)
                    if x not in empty:
                        break
                else:
                    empty.add(a)
                rest = set(follow[a])
                for x in reversed(right):
                    if x in self.left:
                        follow[x] |= rest
                    rest = rest | of(x) if x in empty else set(of(x))
        return follow

    def after(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        """The stack after all reductions at a lookahead and its shift (at the end: after the reductions), or None if it isn't allowed."""
        while (stack[-1], symbol) in self.reduce:
            name, right = self.grammar[self.reduce[stack[-1], symbol]]
            if name == self.grammar[0][0]:
                return stack
            stack = stack[: len(stack) - len(right)]
            stack = (*stack, self.go[stack[-1], name])
        to = self.go.get((stack[-1], symbol))
        return None if to is None else (*stack, to)


class Parser:
    """The stacks that can be, each known by its top, and the steps between them."""

    def __init__(self):
        tables = Tables()
        self.stacks, self.step, self.accepts = [(0,)], {}, []
        for i, stack in enumerate(self.stacks):  # grows
            for x in "sua":
                to = tables.after(stack, x)
                if to is None:
                    continue
                while (rule := tables.reduce.get((to[-1], "$" if x == "a" else "u"))) is not None and tables.grammar[rule][1] and tables.grammar[rule][0] != "S":
                    name, right = tables.grammar[rule]
                    to = to[: len(to) - len(right)]
                    to = (*to, tables.go[to[-1], name])
                if to not in self.stacks:
                    self.stacks.append(to)
                self.step[i, x] = self.stacks.index(to)
            self.accepts.append(tables.after(stack, "$") is not None)
        assert len({s[-1] for s in self.stacks}) == len(self.stacks)  # one stack for each top
        self.tops = range(len(self.stacks))
        #: what an inserted or reroled row becomes at a top: the one of user and assistant that is allowed there
        self.turn = [next(x for x in "ua" if (i, x) in self.step) for i in self.tops]

    def inserted(self, nodes: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
        """`nodes` and those that insertions reach."""
        work = list(nodes)
        while work:
            top = work.pop()
            cost, audit = nodes[top]
            to, new = self.step[top, self.turn[top]], (cost + COST[INSERT], audit + INSERT)
            if to not in nodes or new < nodes[to]:
                nodes[to] = new
                work.append(to)
        return nodes

    def row(self, nodes: dict[int, tuple[int, str]], initial: str, fault: int) -> dict[int, tuple[int, str]]:
        """The nodes after a row, insertions before it included."""
        out: dict[int, tuple[int, str]] = {}

        def reach(to: int, cost: int, audit: str) -> None:
            if to not in out or (cost, audit) < out[to]:
                out[to] = (cost, audit)

        stay = TRUNCATED_COST if fault == TRUNCATED else 0
        for top, (cost, audit) in self.inserted(dict(nodes)).items():
            reach(top, cost + COST[DELETE], audit + DELETE)
            if fault not in (BLANK, DUPLICATE):
                if (top, initial) in self.step:
                    reach(self.step[top, initial], cost + COST[KEEP] + stay, audit + KEEP)
                reach(self.step[top, self.turn[top]], cost + COST[REROLE] + stay, audit + REROLE)
        return out

    def piece(self, rows: Iterable[tuple[str, int]], entry: int) -> dict[int, tuple[int, str]]:
        """The least (cost, audit) from top `entry` to each top over (initial, fault) rows."""
        nodes, settled = {entry: (0, "")}, []
        for k, (initial, fault) in enumerate(rows):
            nodes = self.row(nodes, initial, fault)
            if k % 32 == 31:  # what all nodes have in common doesn't change any more
                head = commonprefix([audit for _, audit in nodes.values()])
                settled.append(head)
                nodes = {top: (cost, audit[len(head) :]) for top, (cost, audit) in nodes.items()}
        head = "".join(settled)
        return {top: (cost, head + audit) for top, (cost, audit) in self.inserted(nodes).items()}

    def joined(self, pieces: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
        """The least (cost, audit) of a conversation, from its pieces' tables by entry and exit."""
        nodes = {0: (0, "")}
        for piece in pieces:
            out: dict[int, tuple[int, str]] = {}
            for entry, (cost, audit) in nodes.items():
                for top, (c, a) in piece.get(entry, {}).items():
                    new = (cost + c, audit + a)
                    if top not in out or new < out[top]:
                        out[top] = new
            nodes = out
        return min(self.inserted(nodes)[top] for top in self.tops if top in nodes and self.accepts[top])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, stripped of their ends, repeated or given to the user by a checksum of conversation and turn. Nulls of role and text are a space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20)).alias("_h"))
    df = df.where("_h != 0")
    text = F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def fault_of_text() -> Column:
    """BLANK, TRUNCATED or SOUND by the row's text alone."""
    end = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    return F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)


PIECES = "conv_id long, part long, entry array<int>, top array<int>, cost array<long>, audit array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, turn long, edit string, role string, text string"
LEGAL = ("su", "ua", "au")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows_then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))
    yield None


def _pieces(laid: DataFrame) -> DataFrame:
    """PIECES of the conversations in each range of `laid`: the parser's table by entry and exit, and counts."""
    place = ["_part", "_at"]
    firsts = laid.groupBy("conv_id", "role", F.md5("text").alias("_text")).agg(F.min(F.struct(*place)).alias("_p")).select("_p.*", F.lit(0).alias("kind"))
    light = laid.select(*place, F.lit(1).alias("kind"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault_of_text().alias("fault"))
    # a row before each place that is the first with its role and text, so the two need no join
    both = light.unionByName(firsts, allowMissingColumns=True).repartition("_part").sortWithinPartitions(*place, "kind").select(*light.columns)
    kind = ddl(PIECES)
    arrow = to_arrow_schema(kind)

    def summary(parser: Parser, conv: int | None, part: int, of: list[tuple], entries: Iterable[int]) -> tuple:
        """`of`: (initial, fault, turn) by row."""
        found = [(e, top, *best) for e in entries for top, best in parser.piece([x[:2] for x in of], e).items()]
        turns = {t for _, _, t in of if t is not None}
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(of, of[1:]))
        count = [sum(f == k for _, f, _ in of) for k in (BLANK, DUPLICATE, TRUNCATED)]
        return conv, part, *map(list, zip(*found)), *count, illegal, of[0][0], of[-1][0], min(turns, default=None), max(turns, default=None), len(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        part = conv = None
        of: list[tuple] = []
        entries: Iterable[int] = ()
        out: list[tuple] = []
        is_first = False
        for row in _rows_then_none(batches):
            if row is None or (row[2] and (row[0], row[3]) != (part, conv)):
                if of:
                    out.append(summary(parser, conv, part, of, entries))
                if len(out) >= 1000 or (row is None and out):
                    yield _table(out, arrow)
                    out = []
                if row is None:
                    return
                # only the first conversation of a range may have begun before it
                entries = parser.tops if row[0] != part else (0,)
                part, conv, of = row[0], row[3], []
            if not row[2]:
                is_first = True
                continue
            _, _, _, _, turn, initial, fault = row
            of.append((initial, fault if fault == BLANK or is_first else DUPLICATE, turn))
            is_first = False

    return both.mapInArrow(run, kind)


class _Conversation:
    """One conversation's pieces, and then its rows in order."""

    def __init__(self, parser: Parser, conv: int | None):
        self.parser, self.conv, self.pieces, self.audit, self.cost, self.at, self.top, self.place = parser, conv, [], None, 0, 0, 0, 0

    def settle(self) -> None:
        """The least cost over all pieces, once they are all here."""
        if self.audit is None:
            tables = []
            for p in self.pieces:
                table: dict[int, dict[int, tuple[int, str]]] = {}
                for entry, top, cost, audit in zip(p["entry"], p["top"], p["cost"], p["audit"]):
                    table.setdefault(entry, {})[top] = (cost, audit)
                tables.append(table)
            self.cost, self.audit = self.parser.joined(tables)

    def _turn(self, edit: str, initial: str, turn: int | None, role: str, text: str) -> tuple:
        self.top = self.parser.step[self.top, initial]
        self.place += 1
        return self.conv, self.place - 1, turn, edit, role, text

    def inserts(self) -> Iterator[tuple]:
        """REPAIRED rows of the insertions that come next."""
        self.settle()
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            new = self.parser.turn[self.top]
            yield self._turn(INSERT, new, None, ROLES[new], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """REPAIRED rows up to this row."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            yield self._turn(edit, role[0], turn, role, text)
        elif edit == REROLE:
            new = self.parser.turn[self.top]
            yield self._turn(edit, new, turn, ROLES[new], text)

    def counts(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal."""
        p = self.pieces
        total = lambda c: sum(x[c] for x in p)
        timed = [x for x in p if x["least"] is not None]
        turns = total("turns") - sum(a["most"] == b["least"] for a, b in zip(timed, timed[1:]))
        gaps = timed[-1]["most"] - timed[0]["least"] + 1 - turns if timed else 0
        return gaps, total("blank"), total("duplicate"), total("truncated"), total("illegal") + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(p, p[1:]))


def _streamed(conversations: DataFrame, report: bool) -> DataFrame:
    """REPORT rows, or REPAIRED ones, of a table (conv_id, turn, role, text)."""
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), null("role").alias("role"), null("text").alias("text"))
    # equal rows differ in the last column, so that they too can lie in several ranges
    laid = laid_out(rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}), ["conv_id", "turn", "role", "_hash", "_row"])
    pieces = _pieces(laid)
    pieces = pieces.select("conv_id", F.lit(1).alias("kind"), F.col("part").alias("_part"), F.struct(*pieces.columns[2:]).alias("piece"))
    texts = laid.select("conv_id", F.lit(2).alias("kind"), "_part", "_at", "turn", "role", "text")
    every = texts.unionByName(pieces, allowMissingColumns=True)
    every = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "_part", "_at").select("conv_id", "kind", "turn", "role", "text", "piece")
    kind = ddl(REPORT if report else REPAIRED)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        now, digest = None, hashlib.sha256()
        out: list[tuple] = []

        def take(turns: Iterable[tuple]) -> None:
            for t in turns:
                if report:
                    digest.update(("\n" if t[1] else "").encode() + f"{t[4]}:{t[5]}".encode("utf-8", "surrogatepass"))
                else:
                    out.append(t)

        for row in _rows_then_none(batches):
            if now is not None and (row is None or row[0] != now.conv):
                take(now.inserts())
                if report:
                    out.append((now.conv, *now.counts(), now.cost, now.audit, digest.hexdigest()))
            if len(out) >= 1000 or (row is None and out):
                yield _table(out, arrow)
                out.clear()
            if row is None:
                return
            conv, kind_, turn, role, text, piece = row
            if now is None or conv != now.conv:
                now, digest = _Conversation(parser, conv), hashlib.sha256()
            if kind_ == 1:
                now.pieces.append(piece)
            else:
                take(now.row(turn, role, text))

    return every.mapInArrow(run, kind)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, turn, edit, role, text: the turns of each conversation after the cheapest repair, places from 0; an
    inserted one has no turn. Rows are taken by turn, nulls first, then by role and text; otherwise as repair_report()."""
    return _streamed(conversations, False)


def repair_report(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of the table, and of `every`
    (conv_id), which has zeros, an empty audit and the digest of nothing if it has no rows.

    Rows are taken by turn, nulls first, and those of one turn by role and text. A null conv_id is a conversation like another; a
    null role or text is a space; equal rows are duplicates, but for the first; a role without characters has no place in the grammar; of
    equally cheap repairs the one with the least audit is taken; an empty table gives what `every` names; other columns are ignored.
    A conversation of any size is parsed in pieces, and its texts, however long, are in memory one at a time.
    """
    report = _streamed(conversations, True)
    if every is None:
        return report
    zeros = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    gone = ids.join(conversations.select(F.col("conv_id").cast("long").alias("_c")).distinct(), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    return report.unionByName(gone.withColumns({**zeros, "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}))
