"""Repair of the structure of conversations: the cheapest edits after which the roles read ``(s?(ua)+)?``.

Edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2; the only one for blank and duplicate rows); Insert
puts an empty row of user or assistant anywhere (5). A truncated row that is not deleted costs 5 more. Of the cheapest
edits those are taken whose initials come first.

1. Rows that agree in conversation, turn, role and text become one by a map-side aggregate. Each is
   blank, a duplicate (role and text stand at an earlier turn), truncated, or sound. None of this carries texts.
2. They are sorted over ranges of (conversation, turn, role, digest of the text) and written as leaves of ``LEAF`` rows,
   a few bytes a row, so a conversation of any length is spread over tasks.
3. The edits of a leaf are a shortest path in a lattice of its rows and the four states of the pattern, found by auction
   (``lattice``). For a conversation of several leaves each first gives the costs between its entry and exit states;
   blocks of ``FAN`` leaves are combined, level by level, and the prices of all exits follow from the top down, again by
   auction. With these a leaf traces its edits for each of the states it may be entered in.
4. Texts meet the leaves in the order of the conversation and are read row by row, with nothing held but the leaf.
   A conversation's repaired text has one hash, which can only be computed in order: this last reading is one task for
   each conversation.

Order: turn (nulls first), role, digest of the text. A null conversation, role or text is one space, so all rows without
a conversation are one; rows that repeat are duplicates. A conversation without rows gives no edits. Other columns do
not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood.llm.common import ship_code, values
from newsmood.llm.lattice import STATES, Lattice
from newsmood.sources.shared import materialise

LEAF, FAN = 2048, 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(STATES)
NEXT = (USER, USER, ASSISTANT, USER)  # what comes after a state, but for a leading system row
DONE = [0, None, None, 0]  # a conversation may end before its start or after an assistant
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT = 4, 8, 16  # added to the number of the initial: s, u, a, another
FAULTS = {BLANK: "blank", DUPLICATE: "duplicate", CUT: "truncated"}
EDITS = ("conv string, turn long, fault string, initial string, edit string, cost long, role string, "
         "text string")


def _arcs(code: int | None, insert: bool) -> list[list[tuple]]:
    """The arcs out of the four states at a row with this code, or with None after the last row."""
    out = []
    for q in range(STATES):
        arcs = []
        if code is not None:
            arcs.append((DELETE, 1, q, "D"))
        if insert:
            arcs.append((INSERT, 0, NEXT[q], "I"))
        if code is not None and not code & (BLANK | DUPLICATE):
            more, kept = (TRUNCATED if code & CUT else 0), (code & 3) + 1
            if kept == NEXT[q] or (kept == SYSTEM and q == START):
                arcs.append((KEEP + more, 1, kept, "K"))
            arcs.append((REROLE + more, 1, NEXT[q], "R"))
        out.append(arcs)
    return out


_ROWS = {code: _arcs(code, True) for code in range(32)}
_ENDS = {last: _arcs(None, last) for last in (False, True)}


def leaf_lattice(codes: bytes, exits: list[int | None], last: bool) -> Lattice:
    """Inserts after the last row belong to the next leaf, if there is one."""
    return Lattice([*(_ROWS[c] for c in codes), _ENDS[last]], exits)


def leaf_costs(codes: bytes, last: bool) -> list[int | None]:
    """What it costs to get from entry state to exit state, at 4 * entry + exit."""
    costs: list[int | None] = [None] * (STATES * STATES)
    for to in range(STATES):
        found = leaf_lattice(codes, [0 if q == to else None for q in range(STATES)], last)
        for q in range(STATES):
            costs[STATES * q + to] = found.cost(0, q)
    return costs


def _chain(parts: list[list[int | None]], exits: list[int | None]) -> tuple[Lattice, list[int]]:
    """The lattice of whole parts, every node an origin, and what is taken off the costs from each part on."""
    least = [min(c for c in costs if c is not None) for costs in parts]
    arcs: list = [[[(costs[STATES * q + to] - low, 1, to, to) for to in range(STATES)
                    if costs[STATES * q + to] is not None] for q in range(STATES)]
                  for costs, low in zip(parts, least, strict=True)]
    off = np.append(np.cumsum(least[::-1])[::-1], 0).tolist()
    return Lattice([*arcs, [[]] * STATES], exits, stride=1), off


def chain_costs(parts: list[list[int | None]]) -> list[int | None]:
    """The costs of a chain of parts, from those of its parts."""
    costs: list[int | None] = [None] * (STATES * STATES)
    for to in range(STATES):
        found, off = _chain(parts, [0 if q == to else None for q in range(STATES)])
        for q in range(STATES):
            cost = found.cost(0, q)
            costs[STATES * q + to] = None if cost is None else cost + off[0]
    return costs


def chain_exits(parts: list[list[int | None]], exits: list[int | None]) -> list[list[int | None]]:
    """For each part the costs from its exit states to the end, less the least of them."""
    found, _ = _chain(parts, exits)
    out = []
    for k in range(1, len(parts) + 1):
        costs = [found.cost(k, q) for q in range(STATES)]
        low = min(c for c in costs if c is not None)
        out.append([None if c is None else c - low for c in costs])
    return out


def _named(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(space(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        space(role_col).alias("role"), space(text_col).alias("text"))
    return named.withColumn("digest", F.substring(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), 1, 16))


def _order() -> list[Column]:
    return [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]


def coded(named: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, code): the different rows, with initial and first fault."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    rows = (named.select("conv", "turn", "role", "digest", fault.alias("fault"))
            .groupBy("conv", "turn", "role", "digest")
            .agg(F.max("fault").alias("fault")))
    rows = materialise(rows, "turns")
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = (rows.where(F.col("fault") != BLANK).groupBy("conv", "role", "digest")
             .agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    late = F.coalesce(when > F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (rows.join(again, ["conv", "role", "digest"], "left")
            .select("conv", "turn", "role", "digest",
                    (number + F.when(late, DUPLICATE).otherwise(F.col("fault"))).cast("int").alias("code")))


def leaves(marked: DataFrame) -> DataFrame:
    """(conv, part, leaf, turn, role, digest, codes): stretches of up to ``LEAF`` rows; part and leaf give their order."""
    most = LEAF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names = ["conv", "part", "leaf", "turn", "role", "digest", "codes"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        done: list[tuple] = []
        now, codes, leaf = None, bytearray(), 0

        def rows() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for conv, turn, role, digest, code in zip(*(values(c) for c in batch.columns), strict=True):
                same = now is not None and now[0] == conv
                if not same or len(codes) == most:
                    if now is not None:
                        done.append((now[0], part, leaf, *now[1:], bytes(codes)))
                    leaf = leaf + 1 if same else 0
                    now, codes = (conv, turn, role, digest), bytearray()
                codes.append(code)
            if len(done) > 1000:
                yield rows()
                done = []
        if now is not None:
            done.append((now[0], part, leaf, *now[1:], bytes(codes)))
        if done:
            yield rows()

    ordered = (marked.select("conv", "turn", "role", "digest", "code").repartitionByRange(*_order())
               .sortWithinPartitions(*_order()))
    return materialise(ordered.mapInArrow(run, "conv string, part int, leaf long, turn long, role string, "
                                               "digest binary, codes binary"), "leaves")


def _packed(costs: list[int | None]) -> list[int]:
    return [-1 if c is None else c for c in costs]


def _unpacked(costs: list[int]) -> list[int | None]:
    return [None if c < 0 else c for c in costs]


def exits_of(long: DataFrame) -> DataFrame:
    """(conv, at, exits) of the leaves (conv, at, last, codes) of conversations of more than one."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [_packed(leaf_costs(codes, last)) for last, codes in
                     zip(values(batch.column(2)), values(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64()))],
                                             ["conv", "at", "costs"])

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        costs = chain_costs([_unpacked(c) for c in table.column("costs").to_pylist()])
        return pa.table({"conv": table.column("conv")[:1], "at": table.column("block")[:1],
                         "costs": pa.array([_packed(costs)], pa.list_(pa.int64()))})

    def down(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        exits = chain_exits([_unpacked(c) for c in table.column("costs").to_pylist()],
                            _unpacked(table.column("exits")[0].as_py()))
        return pa.table({"conv": table.column("conv"), "at": table.column("at"),
                         "exits": pa.array([_packed(e) for e in exits], pa.list_(pa.int64()))})

    block = F.expr(f"at div {FAN}").alias("block")
    levels = [materialise(long.select("conv", "at", "last", "codes").mapInArrow(
        each, "conv string, at long, costs array<long>"), "costs")]
    while not levels[-1].where("at > 0").isEmpty():
        levels.append(materialise(levels[-1].select("*", block).groupBy("conv", "block").applyInArrow(
            up, "conv string, at long, costs array<long>"), "costs"))
    exits = levels[-1].select("conv", "at", F.array(*(F.lit(c).cast("long") for c in _packed(DONE))).alias("exits"))
    for level in reversed(levels[:-1]):
        above = exits.select("conv", F.col("at").alias("block"), "exits")
        exits = materialise(level.select("*", block).join(above, ["conv", "block"]).groupBy("conv", "block")
                            .applyInArrow(down, "conv string, at long, exits array<long>"), "exits")
    return exits


TRACED = "codes binary, audits array<string>, ends array<int>"


def traced(every: DataFrame) -> DataFrame:
    """Leaves with the initials of the edits and the exit state for each entry state; null where it is impossible."""
    parts = every.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv").orderBy("part")  # a row for each task that a conversation is spread over
    parts = (parts.select("conv", "part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                                     F.lit(0)).alias("before"),
                          F.sum("n").over(Window.partitionBy("conv")).alias("all"))
             .where("all > 1"))
    parts = materialise(parts, "spread")
    placed = (every.join(parts, ["conv", "part"], "left")
              .withColumn("at", F.coalesce(F.col("before"), F.lit(0)) + F.col("leaf"))
              .withColumn("last", F.col("at") + 1 == F.coalesce("all", F.lit(1))))
    if not parts.isEmpty():
        placed = materialise(placed, "placed")
        placed = placed.join(exits_of(placed.where("all > 1")), ["conv", "at"], "left")
    else:
        placed = placed.withColumn("exits", F.lit(None).cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, ends = [], []
            for at, last, exits, codes in zip(*(values(batch.column(i)) for i in (5, 6, 7, 8)), strict=True):
                found = leaf_lattice(codes, DONE if exits is None else _unpacked(exits), last)
                ways = [found.trace(q) if at or q == START else None for q in range(STATES)]
                audits.append([None if way is None else "".join(way[0]) for way in ways])
                ends.append([None if way is None else way[1] for way in ways])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], batch.column(8), pa.array(audits, pa.list_(pa.string())),
                 pa.array(ends, pa.list_(pa.int32()))],
                ["conv", "turn", "role", "digest", "kind", "codes", "audits", "ends"])

    return (placed.select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), "at", "last", "exits", "codes")
            .mapInArrow(run, f"conv string, turn long, role string, digest binary, kind int, {TRACED}"))


class _Reader:
    """Goes through a partition's leaves and texts in order and gives the edits."""

    def __init__(self):
        self.conv, self.state, self.key = None, START, None
        self.audit, self.codes, self.at, self.row = "", b"", 0, 0

    def _insert(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield self.conv, None, None, None, "I", INSERT, "user" if self.state == USER else "assistant", ""

    def leaf(self, conv: str, codes: bytes, audits: list, ends: list) -> Iterator[tuple]:
        if conv != self.conv:
            self.conv, self.state, self.key = conv, START, None
        self.audit, self.codes, self.at, self.row = audits[self.state], codes, 0, 0
        yield from self._insert()

    def text(self, turn: int | None, role: str, digest: bytes, text: str) -> Iterator[tuple]:
        initial = role[:1]
        if self.key == (turn, role, digest):  # a copy: blank like its first, or a duplicate
            fault = self.codes[self.row - 1] & BLANK or DUPLICATE
            yield self.conv, turn, FAULTS[fault], initial, "D", DELETE, None, None
            return
        yield from self._insert()  # those after the copies of the row before
        self.key = turn, role, digest
        code, edit = self.codes[self.row], self.audit[self.at]
        self.row, self.at = self.row + 1, self.at + 1
        fault = FAULTS.get(code & (BLANK | DUPLICATE | CUT))
        more = TRUNCATED if code & CUT else 0
        if edit == "D":
            yield self.conv, turn, fault, initial, edit, DELETE, None, None
        elif edit == "K":
            self.state = (code & 3) + 1
            yield self.conv, turn, fault, initial, edit, KEEP + more, role, text
        else:
            self.state = NEXT[self.state]
            role = "user" if self.state == USER else "assistant"
            yield self.conv, turn, fault, initial, edit, REROLE + more, role, text

    def rest(self) -> Iterator[tuple]:
        yield from self._insert()


_EDIT_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
               pa.string()]
_EDIT_NAMES = ["conv", "turn", "fault", "initial", "edit", "cost", "role", "text"]
HELD = 4 << 20  # characters of text in a batch of edits


def edits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv, turn, fault, initial, edit, cost, role, text): the edits of all conversations.

    One row for each row (its turn, fault, initial as they were; role and text as they become, null where it is
    deleted) and each insert. A conversation is whole in its partition and its edits are in order there.
    """
    ship_code(rows.sparkSession)
    named = _named(rows, conv_col, turn_col, role_col, text_col)
    found = traced(leaves(coded(named)))
    texts = named.select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), "text")
    met = (found.withColumn("text", F.lit(None).cast("string"))
           .unionByName(texts, allowMissingColumns=True).repartition("conv")
           .sortWithinPartitions(*_order(), "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, held = _Reader(), [], 0

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _EDIT_KINDS, strict=True)], _EDIT_NAMES)

        for batch in batches:
            for conv, turn, role, digest, kind, codes, audits, ends, text in zip(
                    *(values(c, 64) for c in batch.columns), strict=True):
                if kind == 0:
                    out.extend(reader.rest())
                    out.extend(reader.leaf(conv, codes, audits, ends))
                else:
                    out.extend(reader.text(turn, role, digest, text))
                    held += len(text)
                if held > HELD or len(out) > 5000:
                    yield batch_of(out)
                    out, held = [], 0
        out.extend(reader.rest())
        if out:
            yield batch_of(out)

    return met.select("conv", "turn", "role", "digest", "kind", "codes", "audits", "ends", "text").mapInArrow(run, EDITS)


class _Tally:
    """What is counted of one conversation while its edits pass by."""

    def __init__(self, conv: str):
        self.conv, self.hash, self.first, self.audit = conv, hashlib.sha256(), True, []
        self.faults = dict.fromkeys(FAULTS.values(), 0)
        self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.before = None

    def add(self, turn, fault, initial, edit, cost, role, text) -> None:
        self.cost += cost
        self.audit.append(edit)
        if edit != "D":
            line = f"{role}:{text}".encode("utf-8", "replace")
            self.hash.update(line if self.first else b"\n" + line)
            self.first = False
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            if turn != self.most:
                self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn

    def row(self) -> tuple:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, 2**63 - 1)
        return (self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"],
                self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def summaries(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations with rows.

    ``rows`` is what ``edits`` gives; it is read in its order.
    """
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, done = None, []
        for batch in batches:
            for conv, *edit in zip(*(values(c, 64) for c in batch.columns), strict=True):
                if tally is None or tally.conv != conv:
                    if tally is not None:
                        done.append(tally.row())
                    tally = _Tally(conv)
                tally.add(*edit)
            if done:
                columns = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                done = []
        if tally is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(tally.row(), kinds, strict=True)], names)

    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    return rows.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as a faulty export leaves them, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the
    row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. A null is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    return (rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), what.alias("what"))
            .where("what <> 0")
            .select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                    .alias("copy")).drop("copy"))


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for every ``conv_id`` of ``original``, with the summary of its rows in ``rows``, which may be none."""
    every = (original.select("conv_id").distinct()
             .withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))))
    found = summaries(edits(rows))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(found, "conv", "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
