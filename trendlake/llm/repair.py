"""Repair of conversations whose turns do not alternate, by depth-first branch-and-bound.

A conversation is legal where the first letters of its roles read ``(s?(ua)+)?``. Its rows are kept,
given another role or deleted, and empty rows are inserted; the cheapest edits are searched with an
explicit stack. A node is the number of rows read and the last role written. Suffix lower bounds
relax how a conversation must end; the incumbent is the best (cost, audit) so far, and a
table for each node drops every prefix that an earlier one dominates. The search ends when no open
prefix can beat the incumbent, so the incumbent is proved best.

Spark orders the rows and streams each conversation through a task twice: the first pass holds a few
bytes a row (faults, initials, digests), the second writes the repaired text into the digest. Texts of a
conversation are never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlake.llm.common import column, frugal
from trendlake.storage import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = range(4)
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
LEGAL_PAIRS = ("su", "ua", "au")
#: The code of a row that damage dropped: it only makes its conversation known.
GONE = -1
_NONE = 1 << 60


def _after(initial: str, state: int) -> int | None:
    """The state once a row of that role initial is written; None where the pattern forbids it."""
    if initial == "s":
        return AFTER_SYSTEM if state == START else None
    if initial == "u":
        return AFTER_USER if state != AFTER_USER else None
    return AFTER_ASSISTANT if initial == "a" and state == AFTER_USER else None


def _next_role(state: int) -> tuple[str, int]:
    """The only role but system that may follow, and the state behind it."""
    return ("assistant", AFTER_ASSISTANT) if state == AFTER_USER else ("user", AFTER_USER)


def _moves(fault: int, initial: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that read one row."""
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        kept = _after(initial, state)
        if kept is not None:
            out.append(("K", KEEP + more, kept))
        role, then = _next_role(state)
        if role[0] != initial:
            out.append(("R", REROLE + more, then))
    return out


def lower_bounds(rows: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """For each number of rows read, the least cost of the rest at the start, with a user and with an assistant row due.

    A conversation may end behind its system row here, so this never exceeds the true cost.
    """
    out = [(0, 0, INSERT)] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        fault, initial = rows[i]
        start, user_due, assistant_due = out[i + 1]
        first, best_u, best_a = DELETE + start, DELETE + user_due, DELETE + assistant_due
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            best_u = min(best_u, more + assistant_due + (initial != "u"))
            best_a = min(best_a, more + user_due + (initial != "a"))
            first = min(first, more + assistant_due + (initial != "u"), more + user_due if initial == "s" else INSERT + best_a)
        out[i] = (min(first, INSERT + best_a), min(best_u, INSERT + best_a), min(best_a, INSERT + best_u))
    return out


def _less(a: tuple | None, b: tuple | None) -> int:
    """Below, at or above zero as the letters of prefix ``a`` stand to those of ``b``; only what they do not share is read."""
    ours, theirs = [], []
    while a is not b:
        if b is None or (a is not None and a[2] >= b[2]):
            ours.append(a[0])
            a = a[1]
        else:
            theirs.append(b[0])
            b = b[1]
    ours.reverse(), theirs.reverse()
    return (ours > theirs) - (ours < theirs)


def cheapest(rows: list[tuple[int, str]]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of ``rows`` (fault, role initial), ties ASCII-least.

    The audit has a letter an edit: K keep, R rerole, D delete, I insert.
    """
    n, bounds = len(rows), lower_bounds(rows)
    due = {START: 0, AFTER_SYSTEM: 1, AFTER_USER: 2, AFTER_ASSISTANT: 1}
    best, path = _NONE, [None]  # the incumbent's cost, and its prefixes by length
    table: dict[tuple[int, int], tuple[int, tuple | None]] = {}
    # a prefix is (letter, prefix before, length)
    stack: list[tuple[int, int, int, tuple | None]] = [(0, START, 0, None)]
    while stack:
        i, state, cost, prefix = stack.pop()
        floor, size = cost + bounds[i][due[state]], prefix[2] if prefix else 0
        if floor > best or (floor == best and _less(prefix, path[min(size, len(path) - 1)]) > 0):
            continue
        if seen := table.get((i, state)):
            if seen[0] < cost or (seen[0] == cost and _less(seen[1], prefix) <= 0):
                continue
        table[i, state] = (cost, prefix)
        if i == n and state in (START, AFTER_ASSISTANT):
            if cost < best or _less(prefix, path[-1]) < 0:
                best, path = cost, [None] * (size + 1)
                while prefix:
                    path[prefix[2]], prefix = prefix, prefix[1]
            continue
        then = _next_role(state)[1]
        steps = [(cost + INSERT + bounds[i][due[then]], "I", i, then, cost + INSERT)]
        for letter, more, then in _moves(*rows[i], state) if i < n else []:
            steps.append((cost + more + bounds[i + 1][due[then]], letter, i + 1, then, cost + more))
        for _, letter, at, then, spent in sorted(steps, reverse=True):  # the most promising is tried first
            stack.append((at, then, spent, (letter, prefix, size + 1)))
    return best, "".join(p[0] for p in path[1:])


class _Conversation:
    """What the first pass knows of one conversation: its codes, digests and counters."""

    def __init__(self):
        self.rows: list[tuple[int, str]] = []
        self.seen: set[bytes] = set()
        self.turns, self.low, self.high, self.last = 0, None, None, None

    def add(self, turn: int | None, initial: str, fault: int, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
        if fault != BLANK and digest in self.seen:
            fault = DUPLICATE
        self.seen.add(digest)
        self.rows.append((fault, initial))

    def report(self) -> dict:
        faults = [f for f, _ in self.rows]
        initials = [r for _, r in self.rows]
        cost, audit = cheapest(self.rows)
        return {
            "gaps": self.high - self.low + 1 - self.turns if self.turns else 0,
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False)),
            "cost": cost, "audit": audit,
        }


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPORT = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _solve(key: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, done = None, None, []

        def flush() -> pa.RecordBatch:
            out = [pa.array([k for k, _ in done], schema_of_key), *[pa.array([r[c] for _, r in done], pa.int64()) for c in _COUNTS], pa.array([r["audit"] for _, r in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(out, [key, *_COUNTS, "audit"])

        schema_of_key = pa.int64()
        for batch in batches:
            schema_of_key = batch.column(0).type
            for conv, turn, initial, fault, digest in zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True):
                if now is None or conv != last:
                    if now is not None:
                        done.append((last, now.report()))
                    last, now = conv, _Conversation()
                if fault != GONE:
                    now.add(turn, initial, fault, digest)
            if len(done) >= 1024:
                yield flush()
        if now is not None:
            done.append((last, now.report()))
        if done:
            yield flush()

    return run


def _digest(key: str, names: list[str]):
    """Rows of each conversation behind its report: the sha256 of what the edits leave, fed row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, hasher, state, at, some = None, None, START, 0, False
        done: list[dict] = []

        def write(role: str, text: str) -> None:
            nonlocal some
            hasher.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True

        def inserts() -> None:
            nonlocal at, state
            audit = report["audit"]
            while at < len(audit) and audit[at] == "I":
                role, state = _next_role(state)
                write(role, "")
                at += 1

        def close() -> None:
            if report is not None:
                inserts()
                done.append(report | {"repaired_sha256": hasher.hexdigest()})

        for batch in batches:
            kept = None
            for row in batch.to_pylist():
                if row["report"] is not None:
                    close()
                    report = {key: row[key]} | row["report"]
                    hasher, state, at, some = hashlib.sha256(), START, 0, False
                    continue
                inserts()
                letter = report["audit"][at]
                at += 1
                if letter == "K":
                    state = _after(row["role"][:1], state)
                    write(row["role"], row["text"])
                elif letter == "R":
                    role, state = _next_role(state)
                    write(role, row["text"])
            kept = batch.schema.field(key).type
            if len(done) >= 1024:
                yield _rows(done, key, kept)
                done = []
        close()
        if done:
            yield _rows(done, key, kept)

    return run


def _rows(done: list[dict], key: str, kind: pa.DataType) -> pa.RecordBatch:
    names = [key, *_COUNTS, "audit", "repaired_sha256"]
    kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], k) for c, k in zip(names, kinds, strict=True)], names)


def faulted(rows: DataFrame, text: Column) -> Column:
    """BLANK, CUT or FINE for a text; duplicates are only known in their conversation."""
    some = text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(~some, BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(FINE)


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, equal turns by role and text. Rows where the boolean column ``gone`` holds
    only make their conversation known. Null roles and texts are one space, so such a text is blank and
    such a role cannot be kept, nor can an empty one; rows of a null key are one conversation; repeated rows are
    duplicates; texts of any length are read whole, one at a time; a conversation without rows has zeros, an
    empty audit and the digest of nothing; other columns are not read; an empty table gives no rows.

    One conversation's faults, initials and digests come together in one task, as its audit has a letter for
    each of them anyway; its texts do not.
    """
    dropped = F.coalesce(column(gone), F.lit(False)) if gone else F.lit(False)
    blank = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    rows = conversations.select(column(key).alias("conv"), column(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), dropped.alias("gone"))
    nth = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    rows = materialize(rows.withColumn("nth", nth), "turns")

    fault = F.when(F.col("gone"), GONE).otherwise(faulted(rows, F.col("text")))
    digest = F.unhex(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256))
    codes = rows.select("conv", "nth", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), digest.alias("digest"))
    codes = codes.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "nth").select("conv", "turn", "initial", "fault", "digest")
    kind = rows.schema["conv"].dataType.simpleString()
    reports = codes.mapInArrow(frugal(_solve("conv", codes.columns)), f"conv {kind}, {_REPORT}")

    told = reports.select("conv", F.lit(0).alias("nth"), F.struct(*_COUNTS, "audit").alias("report"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    said = rows.where("not gone").select("conv", "nth", F.lit(None).cast(told.schema["report"].dataType).alias("report"), "role", "text")
    both = told.unionByName(said).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "nth")
    schema = StructType.fromDDL(f"conv {kind}, {_REPORT}, repaired_sha256 string")
    return both.mapInArrow(frugal(_digest("conv", both.columns)), schema).withColumnRenamed("conv", key)


def damage(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conversations`` with known faults: columns key, turn, role, text and gone.

    By crc32 of ``key:turn`` mod 20: 0 drops a row (``gone``), 1 empties its text, 2 takes its ``.!?`` away,
    3 repeats it, 4 sets the role user. Nulls are one space in what is hashed, and as roles and texts.
    """
    blank = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(key), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = conversations.select(column(key).alias(key), column(turn).alias(turn), blank(role).alias(role), blank(text).alias(text), kind.alias("__kind"))
    said = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(column(text), "[.!?]", "")).otherwise(column(text))
    rows = rows.withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    who = F.when(F.col("__kind") == 4, "user").otherwise(column(role))
    return rows.select(column(key), column(turn), who.alias(role), said.alias(text), (F.col("__kind") == 0).alias("gone"))
