"""Repair of damaged conversations by error-correcting Earley parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.llm.common import Scratch

#: The grammar of role initials, each rule with what may be read next: start -> [system] body | empty, body -> user answer,
#: answer -> assistant (body | empty). An item of the chart is the rule that is open there.
START, SYSTEM, USER, ASSISTANT = range(4)
READS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What an insertion or a new role reads there.
WRITES = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the error productions. A truncated row costs more unless it is deleted.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Insertions that complete each open rule at the end of a conversation.
COMPLETIONS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
END = 4
FAR = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)


def _written(state: int, n: int) -> int:
    """The open rule after n insertions."""
    for _ in range(n):
        state = READS[state][WRITES[state]]
    return state


def productions(initial: str, fault: int) -> list[list[tuple[int, str, int]]]:
    """For each open rule, (cost, edits, next rule) of every way to read one row, insertions before it included.

    More than two insertions before a row come back to a rule that fewer reach, so they are never cheapest.
    """
    ways = []
    for state in READS:
        found = []
        for n in range(3):
            at, cost, edits = _written(state, n), n * INSERT, "I" * n
            found.append((cost + DELETE, edits + "D", at))
            if fault not in (BLANK, DUPLICATE):
                cost += TRUNCATED if fault == CUT else 0
                if initial in READS[at]:
                    found.append((cost, edits + "K", READS[at][initial]))
                found.append((cost + REROLE, edits + "R", READS[at][WRITES[at]]))
        ways.append(found)
    return ways


WAYS = [[productions(initial, fault) for fault in range(4)] for initial in "sua-"]


def parse(rows: bytes, exit_: int) -> tuple[list[int], bytearray]:
    """Costs of reading rows from each open rule to the rule exit_ (END: to the end of the conversation), and the chart.

    A row is 4 * initial + fault. The chart is filled from the last row on, so that an item's edits begin with its own and
    the least (cost, edits) of a suffix belongs to the least whole. Every way ends with the one edit that reads a row, so
    no edits of equally many rows begin with one another, and edits are compared by their first part and the rank of the
    rest. The chart keeps the chosen way of each row and rule.
    """
    if exit_ == END:
        cost = [INSERT * len(COMPLETIONS[q]) for q in READS]
        rank = [len(COMPLETIONS[q]) for q in READS]
    else:
        cost, rank = [0 if q == exit_ else FAR for q in READS], [0] * 4
    chart = bytearray(4 * len(rows))
    for i in range(len(rows) - 1, -1, -1):
        ways = WAYS[rows[i] >> 2][rows[i] & 3]
        best = [min((c + cost[to], edits, rank[to], k) for k, (c, edits, to) in enumerate(ways[q])) for q in READS]
        chart[4 * i:4 * i + 4] = bytes(b[3] for b in best)
        cost = [min(b[0], FAR) for b in best]
        places = {key: k for k, key in enumerate(sorted({(b[1], b[2]) for b in best}))}
        rank = [places[b[1], b[2]] for b in best]
    return cost, chart


def edits(rows: bytes, chart: bytearray, entry: int, exit_: int) -> str:
    """The chosen edits from the rule entry on."""
    found, state = [], entry
    for i, row in enumerate(rows):
        _, part, state = WAYS[row >> 2][row & 3][state][chart[4 * i + state]]
        found.append(part)
    return "".join(found) + (COMPLETIONS[state] if exit_ == END else "")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of "conv_id:turn" decides; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, part, pos, row, fault) of rows(conv_id, pos, role, text): the first fault of each, `row` in the code of parse()."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    blank = last == ""
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1))
    light = rows.select("conv_id", "pos", F.unhex(key).alias("key"), F.when(initial == 0, 3).otherwise(initial - 1).cast("int").alias("initial"),
                        blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    repeated = light.groupBy("key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    known = light.join(repeated, "key", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(NO_FAULT)
    return known.select("conv_id", F.shiftright("pos", 33).cast("int").alias("part"), "pos", (F.col("initial") * 4 + fault).cast("int").alias("row"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's rows of one part, parsed from every rule that may be open before to every one that may be open after.

    Only the first conversation of a part may have begun before it and only the last may go on after it.
    """
    names = ["head", "entry", "exit", "cost", "rank", "edits", "blank", "duplicate", "truncated"]
    out, part, conv, head, rows, first = [], None, None, None, bytearray(), True

    def flush(last: bool) -> None:
        nonlocal out
        if not rows:
            return
        faults = [sum(r & 3 == f for r in rows) for f in (BLANK, DUPLICATE, CUT)]
        found = []
        for exit_ in range(5) if last else (END,):
            cost, chart = parse(rows, exit_)
            found += [(entry, exit_, cost[entry], edits(rows, chart, entry, exit_)) for entry in (READS if first else (START,)) if cost[entry] < FAR]
        places = {s: k for k, s in enumerate(sorted({f[3] for f in found}))}
        out += [(conv, part, head, entry, exit_, cost, places[s], s, *faults) for entry, exit_, cost, s in found]

    for batch in batches:
        for c, p, pos, row in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "pos", "row"))):
            if p != part or c != conv:
                flush(p != part)
                first, part, conv, head, rows = p != part, p, c, pos, bytearray()
            rows.append(row)
        if out:
            yield _batch(out, batch.schema.field("conv_id").type, names)
            out = []
        kind = batch.schema.field("conv_id").type
    flush(True)
    if out:
        yield _batch(out, kind, names)


def _batch(rows: list[tuple], conv: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = {"edits": pa.string(), "head": pa.int64(), "cost": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64()}
    fields = [("conv_id", conv), ("part", pa.int32()), *[(n, kinds.get(n, pa.int32())) for n in names]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, entry, exit) of the pieces of the cheapest parse of each conversation; pieces come last part first."""
    conv, seen, parts, kind = None, False, [], None

    def best() -> list[tuple[int, int, int]]:
        if not seen:
            return []
        value, choices = None, []
        for head, ways in parts:
            if value is None:
                choice = {s: (cost, 0, END) for s, t, cost, _ in ways if t == END}
            else:
                choice = {}
                for s, t, cost, rank in ways:
                    if t in value:
                        choice[s] = min(choice.get(s, (FAR * 4, 0, 0)), (cost + value[t], rank, t))
            value = {s: c[0] for s, c in choice.items()}
            choices.append((head, {s: c[2] for s, c in choice.items()}))
        found, state = [], START
        for head, choice in reversed(choices):
            found.append((head, state, choice[state]))
            state = choice[state]
        return found

    def packed(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["head", "entry", "exit"])

    for batch in batches:
        out = []
        for c, head, s, t, cost, rank in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "head", "entry", "exit", "cost", "rank"))):
            if not seen or c != conv:
                out += best()
                conv, seen, parts = c, True, []
            if not parts or parts[-1][0] != head:
                parts.append((head, []))
            parts[-1][1].append((s, t, cost, rank))
        yield packed(out)
    yield packed(best())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """What is known of one conversation while its rows pass in order."""

    def __init__(self) -> None:
        self.sha, self.lines, self.state, self.audit = hashlib.sha256(), 0, START, []
        self.counts, self.cost, self.illegal, self.before = [0, 0, 0], 0, 0, None
        self.low = self.high = None
        self.turns = 0
        self.edits = iter("")

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def write(self, text: str = "") -> None:
        initial = WRITES[self.state]
        self.line(ROLES[initial], text)
        self.state = READS[self.state][initial]

    def piece(self, found: str, cost: int, counts: tuple[int, int, int]) -> None:
        self.insertions()
        self.edits = iter(found)
        self.audit.append(found)
        self.cost += cost
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def insertions(self) -> str:
        for e in self.edits:
            if e != "I":
                return e
            self.write()
        return ""

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        edit = self.insertions()
        if edit == "K":
            self.line(role, text)
            self.state = READS[self.state][role[:1]]
        elif edit == "R":
            self.write(text)

    def result(self) -> tuple:
        self.insertions()
        gaps = min(self.high - self.low + 1 - self.turns, 2 ** 63 - 1) if self.turns else 0
        return gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows in order: a mark of it (kind 0), then its pieces' edits (1) each before its rows (2)."""
    conv, now, kind = None, None, None
    schema = None
    for batch in batches:
        if schema is None:
            kind = batch.schema.field("conv_id").type
            schema = pa.schema([("conv_id", kind), *[(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in RESULT.split(", ")]])
        out = []
        for c, what, turn, role, text, cost, a, b, d in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "kind", "turn", "role", "text", "cost", "blank", "duplicate", "truncated"))):
            if what == 0:
                if now:
                    out.append((conv, *now.result()))
                conv, now = c, _Repair()
            elif what == 1:
                now.piece(text, cost, (a, b, d))
            else:
                now.row(turn, role, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, *now.result()), schema)], schema=schema)


def repair(rows: DataFrame, everyone: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of everyone.

    rows(conv_id, turn, role, text) are put in order by turn, nulls first, ties by role, the text's first 64 characters and
    then a hash of it; role and text are not null. Each row's first fault counts: blank, duplicate (role and text seen earlier), truncated. The cheapest edits that
    give the role initials `(s?(ua)+)?` are found by an Earley chart with error productions; of equally cheap ones the
    audit that comes first as ASCII. A role that begins with none of s, u, a can be given a new role or deleted. Equal
    rows, also of a null conv_id, are rows of their own; a conversation without rows gives zeros, an empty audit and the
    hash of nothing. gaps beyond 64 bits are the largest long.

    A conversation may hold any share of the rows: rows are dealt out by ranges of (conversation, turn, ...), each part is
    parsed from every open rule to every other (20 small results at most for a conversation that crosses parts), and
    the results are put together as a product of small tables. Duplicates come from one aggregate by digest. Only
    the hash of the repaired text, which is sequential by nature, reads a conversation's rows in one task, one at a time.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text")]
    # Equal rows may be dealt to several parts: their place in the input breaks the tie.
    placed = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*([parts] if parts else []), *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    with Scratch(rows.sparkSession) as scratch:
        sorted_ = scratch.cut(ranged.withColumn("pos", F.monotonically_increasing_id()), "turns")
        conv = sorted_.schema["conv_id"].dataType.simpleString()
        pieces = scratch.cut(_faults(sorted_).repartition("part").sortWithinPartitions("pos").mapInArrow(
            _pieces, f"conv_id {conv}, part int, head long, entry int, exit int, cost long, rank int, edits string, blank long, duplicate long, truncated long"), "pieces")
        chosen = pieces.drop("edits").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), "head").mapInArrow(_chosen, "head long, entry int, exit int")
        none = lambda kind: F.lit(None).cast(kind)
        counts = ["cost", "blank", "duplicate", "truncated"]
        marks = everyone.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"),
                                                             *[none("long").alias(c) for c in counts])
        edits_ = pieces.join(chosen, ["head", "entry", "exit"]).select("conv_id", F.col("head").alias("pos"), F.lit(1).alias("kind"), none("long").alias("turn"), none("string").alias("role"), F.col("edits").alias("text"), *counts)
        lines = sorted_.select("conv_id", "pos", F.lit(2).alias("kind"), "turn", "role", "text", *[none("long").alias(c) for c in counts])
        together = marks.unionByName(edits_).unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
        found = scratch.cut(together.mapInArrow(_repaired, f"conv_id {conv}, {RESULT}"), "repaired")
        scratch.keep(found)
    return found


def damage_and_repair(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """repair() of damaged() rows, for every conv_id of conversations(conv_id, turn, role, text); other columns are ignored."""
    return repair(damaged(conversations), conversations, parts)
