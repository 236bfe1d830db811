"""Repair of conversations: the cheapest edits that give an optional system turn and then pairs of user and assistant.

Rows are sorted once over the cluster, by conversation and turn, and cut into segments. A short
conversation within one task is a segment and is solved at once. Longer ones, and those that may
go on in the next task, are chains of segments of at most `CHUNK` rows, solved side by side by a
Viterbi search from the end (costs to go, in four states): every segment starts from a speculative
cost vector, the one of a conversation that ends there. Then fix-up passes go over the chain: a
segment whose right neighbour came out with another vector is run again, until vectors differ from
those assumed by constants only. Constants change no decision, so segments are then traced with
relative costs, each from all four states; one fold over the states they end in stitches them, and
the letters follow. Passes after the first run up to 16, 256 and 4,096 neighbouring segments in a
row, one byte a row, so that even data on which vectors never converge take few passes.

Edits are K (keep, 0), R (give role user or assistant, 3), D (delete, 4) and I (insert an empty turn,
3); a truncated row that is not deleted costs 3 more, blank rows and duplicates have to be deleted.
Of edits that cost the same the letters that are least in ASCII are taken.

Defined results: rows of one turn go by role, then text; null turns come first; a null role or text
is one space; a null conversation is one like any other; a conversation whose rows are all marked
as gone has zeros, no letters and the digest of nothing. Only the last digest of a conversation and
its letters are made in one task, from pieces in order, and the digest keeps none of them. Columns
that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.operators.joins import measured
from kartoteka.operators.tables import staged_table

CHUNK = 128  # rows of a segment
CHUNK_BYTES = 4 << 20  # of their texts, unless one row alone has more
PASS_BITS = 4

# White space is \x20 and \x09-\x0D; a sentence ends with one of `ENDS`.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # after an inserted or renamed row
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_KEEP = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_INITIALS = "sua"
_FORCED = 8  # a row that has to be deleted; others: the place of the initial (3: none of them), and 4 if truncated
_KEEP_BY_CODE = tuple(tuple(_KEEP[s].get(c, -1) for c in (*_INITIALS, "")) for s in range(4))
_END = (0, 6, 3, 0)  # costs to go where nothing follows

_STATS = ("rows", "low", "high", "turns", "first_turn", "last_turn", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal")
_STATS_TYPE = ("rows long, low long, high long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, "
               "blank long, duplicate long, truncated long, illegal long")
_REPAIRED = "array<struct<role: string, text: string>>"
_REPAIRED_ARROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_LEGAL = {"su", "ua", "au"}


def backward(codes: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to go before every row and behind the last, by state, if they are `after` behind the last."""
    out = [after]
    start, system, user, assistant = after
    for code in reversed(codes):
        if code == _FORCED:
            start, system, user, assistant = start + 4, system + 4, user + 4, assistant + 4
        else:
            keep = 3 if code & 4 else 0
            initial = code & 3
            to_user, to_assistant = keep + (0 if initial == 1 else 3) + user, keep + (0 if initial == 2 else 3) + assistant
            start = min(start + 4, to_user, keep + system) if initial == 0 else min(start + 4, to_user)
            system = min(system + 4, to_user)
            user, assistant = min(user + 4, to_assistant), min(assistant + 4, to_user)
            user, assistant = min(user, assistant + 3), min(assistant, user + 3)
            start, system = min(start, user + 3), min(system, user + 3)
        out.append((start, system, user, assistant))
    out.reverse()
    return out


def relative(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


def trace(codes: bytes, costs: list[tuple[int, ...]], state: int) -> tuple[str, int, int]:
    """The least letters from a state before the first row on, the state behind the last row, and their cost."""
    letters, paid = [], 0
    for i, code in enumerate(codes):
        extra = 3 if code & 4 else 0
        while True:
            left = costs[i][state]
            if left == 4 + costs[i + 1][state]:
                letters.append("D")
                paid += 4
                break
            if left == 3 + costs[i][_NEXT[state]]:
                letters.append("I")
                paid += 3
                state = _NEXT[state]
                continue
            to = _KEEP_BY_CODE[state][code & 3]
            if to >= 0 and left == extra + costs[i + 1][to]:
                letters.append("K")
                paid += extra
            else:
                to = _NEXT[state]
                letters.append("R")
                paid += 3 + extra
            state = to
            break
    return "".join(letters), state, paid


def tail(state: int) -> str:
    """What is inserted behind the last row."""
    return "I" * {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}[state]


def apply(letters: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str]]:
    """The rows that the letters leave, from a state on."""
    out, row = [], 0
    for letter in letters:
        if letter == "I":
            state = _NEXT[state]
            out.append((_ROLE[state], ""))
            continue
        if letter == "K":
            state = _KEEP[state][roles[row][:1]]
            out.append((roles[row], texts[row]))
        elif letter == "R":
            state = _NEXT[state]
            out.append((_ROLE[state], texts[row]))
        row += 1
    return out


class _Segment:
    """Rows of one conversation as they come, in order."""

    def __init__(self) -> None:
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.codes = bytearray()
        self.counts = [0, 0, 0]
        self.bytes = 0

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        body = text.rstrip(SPACE)
        fault = 0 if not body else 1 if duplicate else 2 if body[-1] not in ENDS else None
        if fault is not None:
            self.counts[fault] += 1
        initial = _INITIALS.find(role[:1]) if role else -1
        self.codes.append(_FORCED if fault in (0, 1) else (3 if initial < 0 else initial) + (4 if fault == 2 else 0))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def stats(self) -> tuple:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        return (len(self.roles), min(known, default=None), max(known, default=None), len(set(known)), known[0] if known else None,
                known[-1] if known else None, initials[0] if initials else None, initials[-1] if initials else None, *self.counts, illegal)


def _digest(rows: list[tuple[str, str]]) -> str:
    return sha256("\n".join(f"{role}:{text}" for role, text in rows).encode()).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with a fault by hash of conversation and turn in 5 of 20, as `conv_id, turn, role, text, copies, gone`."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate <= 1, "").when(fate == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(fate == 3, 2).otherwise(1).alias("copies"), (fate == 0).alias("gone"))


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that `segments` takes."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text,
                                F.lit(1).alias("copies"), F.lit(False).alias("gone"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order, with `later`: whether role and text stood in an earlier turn. Copies in one turn are next to each other."""
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    repeated = (rows.where("not gone").groupBy("conv_id", "digest")
                .agg(F.count("*").alias("n"), F.bool_or(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("turn"))
                .where("n > 1").select(F.col("conv_id").alias("in_conv"), F.col("digest").alias("same"), F.when(~F.col("no_turn"), F.col("turn")).alias("first")))
    repeated = measured(staged_table(repeated, "repeated"))
    joined = rows.join(repeated, (rows["digest"] == repeated["same"]) & rows["conv_id"].eqNullSafe(repeated["in_conv"]), "left")
    later = F.col("same").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return (joined.select("conv_id", "turn", "role", "text", "copies", "gone", later.alias("later"))
            .repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text"))


def segments(rows: DataFrame) -> DataFrame:
    """A row for each segment: conversation, task and place in it, counts, and either its solution or, if it is open, its rows."""
    names = ["conv_id", "task", "seq", "open", *_STATS, "codes", "roles", "texts", "cost", "audit", "repaired", "sha"]
    kinds = ([pa.int64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 4
             + [pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string(), _REPAIRED_ARROW, pa.string()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out: list[tuple] = []
        held = 0

        def close(conv: int | None, part: _Segment, open_: bool) -> None:
            nonlocal held, seq
            codes = bytes(part.codes)
            row = [conv, task, seq, open_, *part.stats(), codes]
            if open_:
                row += [part.roles, part.texts, None, None, None, None]
            else:
                letters, state, cost = trace(codes, backward(codes, _END), _START)
                letters, cost = letters + tail(state), cost + 3 * len(tail(state))
                fixed = apply(letters, part.roles, part.texts, _START)
                row += [None, None, cost, letters, [{"role": r, "text": t} for r, t in fixed], _digest(fixed)]
            out.append(tuple(row))
            seq += 1
            held += part.bytes

        def ready() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            held = 0
            return batch

        seq, part, conv, before, first = 0, None, None, None, True
        split = False
        for batch in batches:
            for own, turn, role, text, copies, gone, later in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part is None or own != conv:
                    if part is not None:
                        close(conv, part, first or split)
                        first = False
                    part, conv, before, split = _Segment(), own, None, False
                for _ in range(0 if gone else copies):
                    if part.roles and (len(part.roles) >= CHUNK or part.bytes + len(text) > CHUNK_BYTES):
                        close(conv, part, True)
                        part, split = _Segment(), True
                    part.add(turn, role, text, later or before == (turn, role, text))
                    before = (turn, role, text)
                if len(out) >= 256 or held > CHUNK_BYTES:
                    if out:
                        yield ready()
        if part is not None:
            close(conv, part, True)  # it may go on in the next task
        if out:
            yield ready()

    return _ordered(rows).mapInArrow(
        run, f"conv_id long, task long, seq long, open boolean, {_STATS_TYPE}, codes binary, roles array<string>, texts array<string>, "
             f"cost long, audit string, repaired {_REPAIRED}, sha string")


def _numbered(parts: DataFrame) -> DataFrame:
    """Open segments with `number`: they follow each other in it, and so do all of one conversation."""
    own = parts.withColumn("turn_in_task", F.row_number().over(Window.partitionBy("task").orderBy("seq")) - 1)
    counts = parts.groupBy("task").agg(F.count("*").alias("n"))  # a row for each partition of the sort
    starts = counts.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return own.join(starts, "task").withColumn("number", F.col("start") + F.col("turn_in_task")).drop("start", "turn_in_task")


def _with_right(state: DataFrame) -> DataFrame:
    """Each segment with the vector its right neighbour came out with, and whether it has one."""
    right = state.select(F.col("conv_id").alias("right_conv"), (F.col("number") - 1).alias("right_of"), F.col("out").alias("incoming"))
    joined = state.join(right, (state["number"] == right["right_of"]) & state["conv_id"].eqNullSafe(right["right_conv"]), "left")
    return joined.select("conv_id", "number", "codes", "used", "out", F.col("right_of").isNull().alias("last"),
                         F.coalesce("incoming", F.array(*[F.lit(c) for c in _END])).alias("incoming"))


_STATE = "conv_id long, number long, codes binary, used array<int>, out array<int>"


def converge(parts: DataFrame) -> DataFrame:
    """conv_id, number, codes, used and last: every open segment with the costs behind it, right up to a constant."""
    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs = [list(relative(backward(codes, _END)[0])) for codes in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([list(_END)] * len(outs), pa.list_(pa.int32())), pa.array(outs, pa.list_(pa.int32()))],
                                             ["conv_id", "number", "codes", "used", "out"])

    def fix(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        rows = table.to_pylist()
        passed = tuple(rows[-1]["incoming"])
        for row in reversed(rows):
            if relative(passed) != relative(tuple(row["used"])):
                row["used"], row["out"] = list(passed), list(relative(backward(row["codes"], passed)[0]))
            passed = tuple(row["out"])
        return pa.table({"conv_id": table["conv_id"], "number": table["number"], "codes": table["codes"],
                         "used": pa.array([r["used"] for r in rows], pa.list_(pa.int32())), "out": pa.array([r["out"] for r in rows], pa.list_(pa.int32()))})

    state = staged_table(parts.select("conv_id", "number", "codes").mapInArrow(run_all, _STATE), "vectors")
    differ = F.exists(F.zip_with("used", "incoming", lambda a, b: (a - F.array_min("used")) != (b - F.array_min("incoming"))), lambda x: x)
    bits = 0
    while True:
        linked = _with_right(state)
        if linked.where(differ).isEmpty():
            return linked.select("conv_id", "number", "codes", "used", "last")
        bits = min(bits + PASS_BITS, 3 * PASS_BITS)
        state = staged_table(linked.withColumn("chain", F.shiftright("number", bits)).groupBy("conv_id", "chain").applyInArrow(fix, _STATE), "vectors")


def _entries(state: DataFrame) -> DataFrame:
    """number and entry: the state in which each segment is entered, by going through the states that segments end in."""
    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for codes, used in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                costs = backward(codes, tuple(used))
                ends.append([trace(codes, costs, s)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "number", "ends"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, entry = None, _START
        for batch in batches:
            found = []
            for conv, number, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if before != (conv, number - 1):
                    entry = _START
                found.append(entry)
                before, entry = (conv, number), ends[entry]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.int32())], ["number", "entry"])

    ended = state.select("conv_id", "number", "codes", "used").mapInArrow(exits, "conv_id long, number long, ends array<int>")
    return ended.repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(fold, "number long, entry int")


def pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Solved segments (whole conversations), and the traced pieces of the others, in the order of `number`."""
    parts = staged_table(segments(rows), "segments")
    open_ = staged_table(_numbered(parts.where("open").drop("cost", "audit", "repaired", "sha")), "open_segments")
    state = staged_table(converge(open_), "converged")
    entries = staged_table(_entries(state), "entries")
    joined = open_.join(state.select("number", "used", "last"), "number").join(entries, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, costs, fixed = [], [], []
            for codes, used, last, entry, roles, texts in zip(*[batch.column(c).to_pylist() for c in range(1, 7)], strict=True):
                letters, state_, cost = trace(codes, backward(codes, tuple(used)), entry)
                more = tail(state_) if last else ""
                audits.append(letters + more)
                costs.append(cost + 3 * len(more))
                fixed.append([{"role": r, "text": t} for r, t in apply(letters + more, roles, texts, entry)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(fixed, _REPAIRED_ARROW)],
                                             ["number", "cost", "audit", "repaired"])

    traced = (joined.select("number", "codes", "used", "last", "entry", "roles", "texts")
              .mapInArrow(run, f"number long, cost long, audit string, repaired {_REPAIRED}"))
    traced = staged_table(traced, "pieces")
    stats = open_.select("number", "conv_id", *_STATS)
    return parts.where("not open"), stats.join(traced, "number")


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, piece, place, role and text: the repaired conversations; rows go by piece, then place."""
    closed, traced = pieces(conversations)
    out = closed.select("conv_id", F.lit(0).cast("long").alias("piece"), "repaired").unionByName(traced.select("conv_id", F.col("number").alias("piece"), "repaired"))
    return out.select("conv_id", "piece", F.posexplode("repaired").alias("place", "row")).select("conv_id", "piece", "place", "row.role", "row.text")


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stitched(traced: DataFrame) -> DataFrame:
    """One row for each conversation of several pieces; a task keeps counts, letters and a running digest of one at a time."""
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        total = {}

        def finished() -> pa.RecordBatch:
            known = total["low"] is not None
            gaps = total["high"] - total["low"] + 1 - total["turns"] if known else 0
            values = [conv, gaps, *[total[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")], "".join(total["audit"]), total["sha"].hexdigest()]
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                if not begun or row["conv_id"] != conv:
                    if begun:
                        yield finished()
                    conv, begun = row["conv_id"], True
                    total = {"low": None, "high": None, "turns": 0, "last_turn": None, "last_initial": None, "blank": 0, "duplicate": 0, "truncated": 0,
                             "illegal": 0, "cost": 0, "audit": [], "sha": sha256(), "some": False}
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    total[c] += row[c]
                if row["low"] is not None:
                    total["turns"] += row["turns"] - (row["first_turn"] == total["last_turn"])
                    total["low"] = row["low"] if total["low"] is None else total["low"]
                    total["high"], total["last_turn"] = row["high"], row["last_turn"]
                if row["rows"]:
                    if total["last_initial"] is not None:
                        total["illegal"] += total["last_initial"] + row["first_initial"] not in _LEGAL
                    total["last_initial"] = row["last_initial"]
                total["audit"].append(row["audit"])
                for fixed in row["repaired"]:
                    total["sha"].update((("\n" if total["some"] else "") + f"{fixed['role']}:{fixed['text']}").encode())
                    total["some"] = True
        if begun:
            yield finished()

    columns = ["conv_id", "number", *_STATS, "cost", "audit", "repaired"]
    return traced.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(run, _RESULT)


def audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, letters and digest of the repaired rows, for every conversation."""
    closed, traced = pieces(rows)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    solved = closed.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    return solved.unionByName(_stitched(traced))
