"""Repair of a conversation's structure by the cheapest edits, with checkpointed dynamic programming.

A sound conversation is empty, or an optional system turn and then pairs of user and assistant turns.
Each row is kept (0), given the role user or assistant (1) or deleted (2); a row with empty text may be
put in anywhere (5). Blank rows and rows whose role and text stood earlier must go; a row that stays
although its text breaks off costs 5 more. Of the cheapest edits those count whose initials come first
in ASCII order.

From each place and state (nothing yet, after system, after user, after assistant) the least cost to a
sound end is a vector of four, got by going backwards. Vectors are stored at checkpoints only, some
square root of the rows apart; going forwards, each stretch's vectors are computed again from the
checkpoint at its end, and at each place the first tight edit is taken.

Spark sorts rows by conversation and turn in ranges, so a conversation of any length is spread over
tasks, and cuts them into blocks of at most ``BLOCK`` rows, one byte a row. A block of a longer
conversation is first reduced to its cost from each state to each state; joined backwards, these give
the vector at each block's end, a checkpoint for all tasks; each block is then walked from all four
states, and a last pass over the blocks' outcomes says from which it really starts. Texts are not
part of this. They are read once more, in order, as a stream that hashes them: the digest of a
repaired conversation is sequential by its nature, and its task holds one batch and the initials.

Defined cases: rows are ordered by turn (nulls first), those of one turn by role and then text; a null
role or text is one blank, and a null conversation is a conversation; empty and very long texts and
repeated rows are rows like others; a conversation without rows, and an empty table, have an empty
repair; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, column, kind_of, released, stored, table

#: Bits of a row's place that a block spans: at most 4,096 rows.
BLOCK_BITS = 12
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost to a sound end from each state, when no row is left.
END = (0, 10, 5, 0)
#: The state that a user or assistant row leads to, whichever may follow.
NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = ((START,), (START, SYSTEM, ASSISTANT), (USER,), ())  # by the role's number: where such a row may stand
_BLANK, _AGAIN, _BROKEN = 1, 2, 3
_FAR = 1 << 60
_ASCII_SPACE = r"\x20\x09-\x0D"


def before(code: int, after: tuple) -> tuple:
    """The vector ahead of a row from that behind it; a code is the role's number and four times the fault."""
    role, fault = code & 3, code >> 2
    row = [2 + a for a in after]
    if fault not in (_BLANK, _AGAIN):
        stays = 5 if fault == _BROKEN else 0
        for state in range(4):
            row[state] = min(row[state], 1 + stays + after[NEXT[state]])
        for state in _KEPT[role]:
            row[state] = min(row[state], stays + after[role + 1])
    user, assistant = min(row[USER], 5 + row[ASSISTANT]), min(row[ASSISTANT], 5 + row[USER])
    return min(row[START], 5 + user), min(row[SYSTEM], 5 + user), user, assistant


def costs(codes: bytes) -> list[int]:
    """Least costs through a block from each state (major) to each."""
    out = []
    for exit_ in range(4):
        vector = tuple(0 if s == exit_ else _FAR for s in range(4))
        for code in reversed(codes):
            vector = before(code, vector)
        out.append(vector)
    return [out[e][s] for s in range(4) for e in range(4)]


def walked(codes: bytes, state: int, end: tuple, last: bool) -> tuple[str, int]:
    """(initials of the cheapest edits from a state, the state behind them); ``end`` is the vector
    behind the block, ``last`` whether the conversation ends there."""
    n = len(codes)
    step = isqrt(n) + 1
    marks, vector = {n: end}, end
    for i in range(n - 1, -1, -1):
        vector = before(codes[i], vector)
        if i % step == 0:
            marks[i] = vector
    out = []
    for at in range(0, n, step):
        to = min(at + step, n)
        near = [marks[to]]
        for i in range(to - 1, at - 1, -1):
            near.append(before(codes[i], near[-1]))
        near.reverse()
        i = at
        while i < to:
            code, here, then = codes[i], near[i - at], near[i - at + 1]
            role, fault = code & 3, code >> 2
            stays, may_stay, cost = 5 if fault == _BROKEN else 0, fault not in (_BLANK, _AGAIN), here[state]
            if 2 + then[state] == cost:
                out.append("D")
            elif 5 + here[NEXT[state]] == cost:
                out.append("I")
                state = NEXT[state]
                continue
            elif may_stay and state in _KEPT[role] and stays + then[role + 1] == cost:
                out.append("K")
                state = role + 1
            else:
                out.append("R")
                state = NEXT[state]
            i += 1
    while last and END[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def ordered(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text) with ``at``, which counts up in the order of conversations and rows."""
    tie = F.substring("text", 1, 64)  # the order of beginnings is that of texts
    return rows.repartitionByRange("conv", "turn", "role", tie).sortWithinPartitions("conv", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def coded(rows: DataFrame, held: list[str]) -> DataFrame:
    """rows(conv, at, role, text) -> (conv, at, code): roles and first faults, without texts."""
    digest = F.unhex(F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text").cast("binary")))
    tail = F.regexp_extract("text", f"([^{_ASCII_SPACE}])[{_ASCII_SPACE}]*\\z", 1)
    role = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    plain = F.when(tail == "", _BLANK).when(~tail.isin(".", "!", "?"), _BROKEN).otherwise(0)
    told = stored(rows.select("conv", "at", digest.alias("digest"), role.alias("role"), plain.alias("fault")), "told", held)
    firsts = told.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("of"), F.col("digest").alias("seen"), "first")
    again = told.where(F.col("fault") != _BLANK).join(firsts, same("conv", "of") & (F.col("digest") == F.col("seen"))).where("at > first").select("at", F.lit(_AGAIN).alias("again"))
    return told.join(again, "at", "left").select("conv", "at", (F.col("role") + 4 * F.coalesce("again", "fault")).cast("tinyint").alias("code"))


def blocks(codes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(conv, block, start, codes array<tinyint>): neighbouring rows of a conversation, in order."""
    listed = F.sort_array(F.collect_list(F.struct("at", "code")))
    made = codes.groupBy("conv", F.shiftright("at", bits).alias("block")).agg(listed.alias("rows"))
    return made.select("conv", "block", F.col("rows")[0]["at"].alias("start"), F.col("rows.code").alias("codes"))


def audited(made: DataFrame, held: list[str]) -> DataFrame:
    """blocks -> (conv, start, audit): the initials of each block's edits."""
    key, kind = arrow_type(made, "conv"), kind_of(made, "conv")
    many = stored(made.groupBy(F.col("conv").alias("of")).agg(F.count("*").alias("n")).where("n > 1"), "long", held)
    single = made.join(many, same("conv", "of"), "left_anti").select("conv", "block", "start", "codes", F.array(*map(F.lit, END)).cast("array<bigint>").alias("end"), F.lit(True).alias("last"))
    parts = stored(made.join(many, same("conv", "of"), "left_semi"), "parts", held)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [costs(bytes(c)) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["conv", "block", "costs"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vector, ends = END, []
                for step in reversed(steps):
                    ends.append((step["block"], vector, not ends))
                    vector = tuple(min(step["costs"][4 * s + e] + vector[e] for e in range(4)) for s in range(4))
                columns = zip(*ends, strict=True)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(ends), key), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["of", "part", "end", "last"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[walked(bytes(c), s, tuple(end), last) for s in range(4)] for c, end, last in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            audits, exits = (pa.array([[f[i] for f in row] for row in found], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int8())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], audits, exits], names=["conv", "block", "start", "audits", "exits"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits = [walked(bytes(c), START, END, True)[0] for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(audits, pa.string())], names=["conv", "start", "audit"])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, out = START, []
                for step in steps:
                    out.append(state)
                    state = step["exits"][state]
                columns = [pa.array([conv] * len(out), key), pa.array([s["block"] for s in steps], pa.int64()), pa.array(out, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["of", "part", "state"])

    steps = parts.select("conv", "block", "codes").mapInArrow(through, f"conv {kind}, block bigint, costs array<bigint>")
    listed = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("steps"))
    ends = listed.mapInArrow(backwards, f"of {kind}, part bigint, end array<bigint>, last boolean")
    placed = parts.join(ends, same("conv", "of") & (F.col("block") == F.col("part"))).select("conv", "block", "start", "codes", "end", "last")
    ways = stored(placed.mapInArrow(walk, f"conv {kind}, block bigint, start bigint, audits array<string>, exits array<tinyint>"), "ways", held)
    listed = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "exits"))).alias("steps"))
    states = listed.mapInArrow(forwards, f"of {kind}, part bigint, state int")
    chosen = ways.join(states, same("conv", "of") & (F.col("block") == F.col("part"))).select("conv", "start", F.get("audits", "state").alias("audit"))
    short = single.select("conv", "start", "codes").mapInArrow(alone, f"conv {kind}, start bigint, audit string")
    return short.union(chosen)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit, sha256): rows and their blocks' edits, read in order as a stream."""
    key, kind = arrow_type(rows, "conv"), kind_of(rows, "conv")
    texts = rows.select("conv", "at", F.lit(1).alias("kind"), "role", "text")
    edits = audits.select("conv", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = work = None
        done = []
        for batch in batches:
            for now, kind_, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if work is None or now != conv:
                    if work:
                        done.append((conv, *work.end()))
                    conv, work = now, _Stream()
                work.row(role, text) if kind_ else work.edits(text)
            if len(done) >= 256:
                yield _outcome(done, key)
                done = []
        if work:
            done.append((conv, *work.end()))
        if done:
            yield _outcome(done, key)

    both = texts.union(edits).repartition("conv").sortWithinPartitions("conv", "at", "kind")
    return both.mapInArrow(run, f"conv {kind}, illegal bigint, cost bigint, audit string, sha256 string")


def _outcome(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    types = (key, pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv", "illegal", "cost", "audit", "sha256"])


class _Stream:
    """One conversation: edits arrive ahead of the rows of their block, rows in order."""

    def __init__(self) -> None:
        self.made, self.audit, self.next = hashlib.sha256(), [], iter(())
        self.state, self.lines, self.cost, self.illegal, self.role = START, 0, 0, 0, None

    def edits(self, audit: str) -> None:
        self.audit.append(audit)
        self.next = iter(audit)

    def _line(self, role: str, text: str) -> None:
        self.made.update(b"\n" * bool(self.lines) + f"{role}:{text}".encode())
        self.lines += 1

    def _turn(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._line("user" if self.state == USER else "assistant", text)

    def row(self, role: str, text: str) -> None:
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        edit = next(self.next)
        while edit == "I":
            self.cost += 5
            self._turn("")
            edit = next(self.next)
        if edit == "D":
            self.cost += 2
            return
        self.cost += (edit == "R") + 5 * (text.rstrip("\x20\t\n\x0b\x0c\r")[-1:] not in (".", "!", "?"))
        if edit == "R":
            self._turn(text)
        else:
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            self._line(role, text)

    def end(self) -> tuple:
        for _ in self.next:  # only what is put in behind the last row is left
            self.cost += 5
            self._turn("")
        return self.illegal, self.cost, "".join(self.audit), self.made.hexdigest()


def repairs(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BLOCK_BITS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation that has rows; counts are of rows by their first fault."""
    held: list[str] = []
    spoken = [F.coalesce(column(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = stored(ordered(conversations.select(column(conv).alias("conv"), column(turn).alias("turn"), *spoken)), "turns", held)
    codes = stored(coded(rows, held), "codes", held)
    made = stored(blocks(codes, bits), "blocks", held)
    out = repaired(rows, audited(made, held))
    turns = rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    fault = F.shiftright("code", 2)
    counts = codes.groupBy("conv").agg(*(F.count_if(fault == k).alias(n) for k, n in ((_BLANK, "blank"), (_AGAIN, "duplicate"), (_BROKEN, "truncated"))))
    joined = out
    for more, name in ((turns, "of_turns"), (counts, "of_counts")):
        joined = joined.join(more.withColumnRenamed("conv", name), same("conv", name)).drop(name)
    done = stored(joined.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256")), "repairs")
    released(conversations.sparkSession, held)
    return done


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with one row in four spoilt, by a checksum of ``conv_id:turn``: dropped, emptied,
    without its full stops, said twice, or given the role user. Nulls count as one blank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), said("role").alias("role"), said("text").alias("text")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    spoilt = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)))
    return spoilt.drop("col")


def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repairs(damaged(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct().join(found, same("conv_id", "of"), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
