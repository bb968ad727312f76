"""Conversation structure repair: the cheapest edits that make roles alternate.

The turns of a conversation are aligned, as Wagner and Fischer align strings, to
the grammar string ``s?(ua)+`` of every feasible length.  Counted from the end,
the strings of all lengths are one string, so one table of (turns left, symbols
left) has the cost for each length, and of the cheapest lengths the backtraced
audits are compared.  Cells stay in Ukkonen's band: those that more deletions or
insertions lead to than the incumbent (keep or rerole all that may stay, or
delete everything) costs in all are left out.

A table covers at most ``TURNS`` turns.  Longer conversations are several
tables, which meet in the *phase* of the grammar: before anything, after the
system turn, assistant next, user next.  A table gives the cost from phase to
phase; a chain of these costs says in which phase each table ends.  Insertions
stand in front of a turn (only the last table has some at its end), so of two
audits of one table none is the start of the other, and the chain takes the
least one table by table.

Conversations of at most ``LONG_TURNS`` turns and ``LONG_BYTES`` are handled
whole, where their turns meet.  Those beyond are dealt by range, cut in chunks
that are summed up where they are; only the chain of chunk costs and, at the
end, the hash over the repaired text (which has an order) take one task a
conversation, as streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlake.llm.common import BLANKS, bounded, durable, named, slices

#: Turns of one alignment table.
TURNS = 256
#: Beyond either, a conversation is dealt over tasks, in chunks of at most so many turns and characters (or one turn).
LONG_TURNS, LONG_BYTES = 4096, 16 << 20
CHUNK_TURNS, CHUNK_CHARS = 1024, 1 << 20
#: What deletion, insertion, rerole and keeping a truncated turn cost.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Phases: before anything, after the system turn, assistant next, user next.
START, SYSTEM, ASSISTANT, USER = range(4)

_NEVER = 1 << 28
_LEGAL = {"su", "ua", "au"}


class Table:
    """The alignment of up to ``TURNS`` turns (initial, must go, truncated), from any phase to any phase."""

    def __init__(self, turns: list[tuple[str, bool, bool]], last: bool):
        self.turns, self.last = turns, last
        n, gone = len(turns), sum(t[1] for t in turns)
        # What an alignment to any phase costs at most, two insertions for its parity and length included.
        self.incumbent = min(DELETE * n, DELETE * gone + REROLE * (n - gone) + TRUNCATED * sum(t[2] and not t[1] for t in turns)) + 2 * INSERT
        self.costs = {ASSISTANT: None, USER: self._costs(USER)} if last else {end: self._costs(end) for end in (ASSISTANT, USER)}
        self.known: dict[tuple[int, int], tuple[int, str]] = {}

    def symbol(self, k: int, end: int) -> str:
        """The symbol that has k - 1 behind it, where the table ends in phase ``end``."""
        return "a" if (k % 2 == 1) == (end == USER) else "u"

    def _costs(self, end: int) -> np.ndarray:
        """[i, k]: the cheapest alignment of the turns from i on to the last k symbols before ``end``."""
        n = len(self.turns)
        width = n + self.incumbent // INSERT + 1
        inserted = INSERT * np.arange(width)
        other = {c: np.array([REROLE * (self.symbol(k, end) != c) for k in range(width)]) for c in "ua"}
        other[""] = np.full(width, REROLE)
        out = np.full((n + 1, width), _NEVER)
        if self.last:
            out[n] = inserted
        else:
            out[n, 0] = 0
        for i in range(n - 1, -1, -1):
            initial, must_go, cut = self.turns[i]
            row = out[i + 1] + DELETE
            if not must_go:
                row[1:] = np.minimum(row[1:], out[i + 1, :-1] + other[initial if initial in other else ""][1:] + TRUNCATED * cut)
            row = np.minimum.accumulate(row - inserted) + inserted
            low, high = max(0, n - i - self.incumbent // DELETE), n - i + self.incumbent // INSERT
            out[i, low : high + 1] = row[low : high + 1]
        return out

    def _lengths(self, begin: int, end: int) -> slice:
        """The symbols that lead from one phase to the other: both follow the phases' parity, the first two phases need some."""
        odd = (begin == ASSISTANT) != (end == ASSISTANT)
        return slice(1 if odd else 0 if begin in (ASSISTANT, USER) else 2, None, 2)

    def _least(self, i: int, begin: int, end: int) -> tuple[int, list[int]]:
        row, ks = self.costs[end][i], range(self.costs[end].shape[1])[self._lengths(begin, end)]
        best = int(row[self._lengths(begin, end)].min(initial=_NEVER))
        return best, [k for k in ks if row[k] == best]

    def _traced(self, i: int, k: int, end: int) -> str:
        """The least audit of the cheapest alignments of the turns from i on to k symbols."""
        cost, n, out = self.costs[end], len(self.turns), []
        while i < n or k:
            here = cost[i, k]
            if i < n and cost[i + 1, k] + DELETE == here:
                out.append("D")
                i += 1
            elif k and cost[i, k - 1] + INSERT == here:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.turns[i][0] == self.symbol(k, end) else "R")
                i, k = i + 1, k - 1
        return "".join(out)

    def best(self, begin: int, end: int) -> tuple[int, str]:
        """Cost and least audit from phase to phase."""
        if (begin, end) not in self.known:
            self.known[begin, end] = self._best(begin, end)
        return self.known[begin, end]

    def _best(self, begin: int, end: int) -> tuple[int, str]:
        n, found = len(self.turns), []
        if begin == end and begin in (START, SYSTEM):
            return DELETE * n, "D" * n
        if end == START or (end == SYSTEM and begin != START) or (self.last and end in (SYSTEM, ASSISTANT)):
            return _NEVER, ""
        if end != SYSTEM:
            least, ks = self._least(0, begin, end)
            found += [(least, lambda k=k: self._traced(0, k, end)) for k in ks]
        if begin == START:
            # A system turn that is kept, with all before it deleted; of equal ones the last has the least audit.
            for i, (initial, must_go, cut) in enumerate(self.turns):
                if initial == "s" and not must_go:
                    before = DELETE * i + TRUNCATED * cut
                    if end == SYSTEM:
                        found.append((before + DELETE * (n - i - 1), lambda i=i: "D" * i + "K" + "D" * (n - i - 1)))
                    else:
                        least, ks = self._least(i + 1, SYSTEM, end)
                        found += [(before + least, lambda i=i, k=k: "D" * i + "K" + self._traced(i + 1, k, end)) for k in ks]
        least = min((c for c, _ in found), default=_NEVER)
        return (least, min(audit() for c, audit in found if c == least)) if least < _NEVER else (_NEVER, "")


class Stretch:
    """Consecutive turns of a conversation, in tables, from any phase to any phase."""

    def __init__(self, turns: list[tuple[str, bool, bool]], last: bool):
        cuts = range(0, len(turns), TURNS)
        self.tables = [Table(turns[a : a + TURNS], last and a + TURNS >= len(turns)) for a in cuts]

    def best(self, begin: int, end: int) -> tuple[int, str]:
        if len(self.tables) == 1:
            return self.tables[0].best(begin, end)
        steps = [[[t.best(p, q)[0] for q in range(4)] for p in range(4)] for t in self.tables]
        path = chained([(step, lambda p, q, t=t: t.best(p, q)[1]) for step, t in zip(steps, self.tables, strict=True)], begin, [end])
        return (path[0], "".join(t.best(p, q)[1] for t, (p, q) in zip(self.tables, path[1], strict=True))) if path else (_NEVER, "")


def chained(steps: list[tuple[list[list[int]], Callable]], begin: int, ends: list[int]) -> tuple[int, list[tuple[int, int]]] | None:
    """The cheapest way from phase ``begin`` to one of ``ends``: its cost and each step's two phases.

    Each step has its costs from phase to phase and what orders equal ones of
    one first phase (an audit, or its rank).  None where there is no way.
    """
    togo = [[0 if p in ends else _NEVER for p in range(4)]]
    for costs, _ in reversed(steps):
        togo.append([min(costs[p][q] + togo[-1][q] for q in range(4)) for p in range(4)])
    togo.reverse()
    if togo[0][begin] >= _NEVER:
        return None
    path, p = [], begin
    for k, (costs, order) in enumerate(steps):
        q = min((q for q in range(4) if costs[p][q] + togo[k + 1][q] == togo[k][p]), key=lambda q: order(p, q))
        path.append((p, q))
        p = q
    return togo[0][begin], path


def applied(audit: str, turns: list[tuple[str, str]], phase: int) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) after these edits, and the phase that they end in."""
    out, i = [], 0
    for edit in audit:
        role = "assistant" if phase == ASSISTANT else "user"
        if edit == "I":
            out.append((role, ""))
        else:
            if edit != "D":
                out.append((turns[i][0] if edit == "K" else role, turns[i][1]))
            i += 1
        if edit != "D":
            phase = SYSTEM if phase == START and out[-1][0][:1] == "s" else USER if phase == ASSISTANT else ASSISTANT
    return out, phase


def faults(turns: list[tuple[str, str]], seen: set | None = None) -> list[str]:
    """Of each turn (role, text) its first fault (blank, duplicate, truncated) or an empty string."""
    seen, out = set() if seen is None else seen, []
    for turn in turns:
        said = turn[1].rstrip(BLANKS)
        out.append("blank" if not said else "duplicate" if turn in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add(turn)
    return out


def _coded(turns: list[tuple[str, str]], fault: list[str]) -> list[tuple[str, bool, bool]]:
    return [(role[:1], f in ("blank", "duplicate"), f == "truncated") for (role, _), f in zip(turns, fault, strict=True)]


def illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
TURN_SQL = "array<struct<role:string,text:string>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _whole(with_turns: bool):
    """Sorted turns (id, turn, role, text; role null: no turn, only the id) to a row a conversation."""

    def solve(rows: list[tuple]) -> tuple:
        rows = [r for r in rows if r[1] is not None]
        turns, numbers = [r[1:] for r in rows], {r[0] for r in rows} - {None}
        fault = faults(turns)
        table = Stretch(_coded(turns, fault), True)
        cost, audit = min(table.best(START, START), table.best(START, USER)) if turns else (0, "")
        fixed, _ = applied(audit, turns, START)
        said = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in fixed).encode()).hexdigest()
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        return gaps, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal([t[0][:1] for t in turns]), cost, audit, said, fixed

    def emitted(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        out = {"id": pa.array([d[0] for d in done], kind)}
        out |= {name: pa.array([d[1 + k] for d in done], pa.int64()) for k, name in enumerate(COUNTS)}
        out |= {"audit": pa.array([d[7] for d in done], pa.string()), "repaired_sha256": pa.array([d[8] for d in done], pa.string())}
        if with_turns:
            out["turns"] = pa.array([[{"role": r, "text": t} for r, t in d[9]] for d in done], TURN)
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, kind, done = [], None, None, []
        for batch in slices(batches, text=3):
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and row[0] != now:
                    done.append((now, *solve(held)))
                    held = []
                now = row[0]
                held.append(row[1:])
            if done:
                yield emitted(done, kind)
                done = []
        if held:
            yield emitted([(now, *solve(held))], kind)

    return run


def _chunks(most: int):
    """Sorted turns (id, role, text, seen before) to rows of at most ``most`` consecutive turns of one conversation, numbered in their partition."""

    def emitted(held: list[tuple], part: int, no: int, kind: pa.DataType) -> pa.RecordBatch:
        turns = [r[1:3] for r in held]
        alone = [faults([t])[0] for t in turns]
        fault = ["duplicate" if again and f != "blank" else f for f, (*_, again) in zip(alone, held, strict=True)]
        return pa.RecordBatch.from_pydict({
            "id": pa.array([held[0][0]], kind), "part": pa.array([part], pa.int64()), "no": pa.array([no], pa.int64()),
            "turns": pa.array([[{"role": r, "text": t} for r, t in turns]], TURN), "faults": pa.array([fault], pa.list_(pa.string())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, held, chars, kind = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in slices(batches, text=2):
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= most or chars + len(row[2]) > CHUNK_CHARS):
                    yield emitted(held, part, no, kind)
                    held, chars, no = [], 0, no + 1
                held.append(row)
                chars += len(row[2])
        if held:
            yield emitted(held, part, no, kind)

    return run


def _pairs(column: pa.Array) -> list[list[tuple[str, str]]]:
    return [[(t["role"], t["text"]) for t in turns] for turns in column.to_pylist()]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to their costs from phase to phase and the ranks of their audits; both as the last of a conversation and not."""
    for batch in slices(batches, rows=16):
        sums = []
        for turns, fault in zip(_pairs(batch.column(3)), batch.column(4).to_pylist(), strict=True):
            codes, sides = _coded(turns, fault), []
            for last in (False, True):
                found = Stretch(codes, last)
                for p in range(4):
                    best = [found.best(p, q) for q in range(4)]
                    order = sorted(range(4), key=lambda q: best[q][1])  # noqa: B023
                    sides += [b[0] for b in best] + [order.index(q) for q in range(4)]
            initials = [r[:1] for r, _ in turns]
            sums.append((sides, [fault.count(x) for x in ("blank", "duplicate", "truncated")], illegal(initials), initials[0], initials[-1]))
        yield pa.RecordBatch.from_pydict({
            **{name: batch.column(k) for k, name in enumerate(("id", "part", "no"))}, "sides": pa.array([s[0] for s in sums], pa.list_(pa.int64())), "counts": pa.array([s[1] for s in sums], pa.list_(pa.int64())),
            "illegal": pa.array([s[2] for s in sums], pa.int64()), "first": pa.array([s[3] for s in sums], pa.string()), "final": pa.array([s[4] for s in sums], pa.string()),
        })


def _phases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted summaries of chunks to each chunk's two phases; a conversation's counts stand beside its first chunk."""
    names = ("id", "part", "no", "sides", "counts", "illegal", "first", "final")

    def done(held: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        steps = []
        for k, r in enumerate(held):
            side = r["sides"][32 if k == len(held) - 1 else 0 :]
            steps.append(([side[8 * p : 8 * p + 4] for p in range(4)], lambda p, q, side=side: side[8 * p + 4 + q]))
        cost, path = chained(steps, START, [START, USER])
        broken = sum(r["illegal"] for r in held) + illegal_between(held)
        zeros = [0] * len(held)
        first = lambda v: pa.array([v, *zeros[1:]], pa.int64())
        return pa.RecordBatch.from_pydict({
            "id": pa.array([r["id"] for r in held], kind), "part": pa.array([r["part"] for r in held], pa.int64()), "no": pa.array([r["no"] for r in held], pa.int64()),
            "begin": pa.array([p for p, _ in path], pa.int64()), "end": pa.array([q for _, q in path], pa.int64()), "last": pa.array([k == len(held) - 1 for k in range(len(held))]),
            **{name: first(sum(r["counts"][k] for r in held)) for k, name in enumerate(("blank", "duplicate", "truncated"))}, "illegal": first(broken), "cost": first(cost),
        })

    held, kind = [], None
    for batch in slices(batches):
        kind = batch.schema.field(0).type
        for row in batch.select(list(names)).to_pylist():
            if held and row["id"] != held[-1]["id"]:
                yield done(held, kind)
                held = []
            held.append(row)
    if held:
        yield done(held, kind)


def illegal_between(held: list[dict]) -> int:
    return sum(a["final"] + b["first"] not in _LEGAL for a, b in zip(held, held[1:], strict=False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their phases to their audits and repaired turns."""
    for batch in slices(batches, rows=16):
        audits, fixed = [], []
        for turns, fault, begin, end, last in zip(_pairs(batch.column("turns")), *(batch.column(c).to_pylist() for c in ("faults", "begin", "end", "last")), strict=True):
            audits.append(Stretch(_coded(turns, fault), last).best(begin, end)[1])
            fixed.append(applied(audits[-1], turns, begin)[0])
        out = {name: batch.column(name) for name in ("id", "part", "no", *COUNTS[1:])}
        yield pa.RecordBatch.from_pydict(out | {"audit": pa.array(audits, pa.string()), "turns": pa.array([[{"role": r, "text": t} for r, t in f] for f in fixed], TURN)})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to a row a conversation; the text goes through the hash and is not kept."""
    now, parts, counts, hashed, some, kind = None, None, None, None, False, None

    def emitted() -> pa.RecordBatch:
        out = {"id": pa.array([now], kind)} | {c: pa.array([n], pa.int64()) for c, n in zip(COUNTS[1:], counts, strict=True)}
        return pa.RecordBatch.from_pydict(out | {"audit": pa.array(["".join(parts)]), "repaired_sha256": pa.array([hashed.hexdigest()])})

    for batch in slices(batches, rows=16):
        kind = batch.schema.field(0).type
        for row in batch.to_pylist():
            if parts is None or row["id"] != now:
                if parts is not None:
                    yield emitted()
                now, parts, counts, hashed, some = row["id"], [], [0] * len(COUNTS[1:]), hashlib.sha256(), False
            parts.append(row["audit"])
            counts = [a + row[c] for a, c in zip(counts, COUNTS[1:], strict=True)]
            for t in row["turns"]:
                hashed.update(f"{chr(10) * some}{t['role']}:{t['text']}".encode())
                some = True
    if parts is not None:
        yield emitted()


def _rows(turns: DataFrame, id_col: str, turn: str, role: str, text: str, keep: str | None) -> DataFrame:
    """(id, turn, role, text), nulls of role and text as one space; where ``keep`` is false, no role and text."""
    one = lambda c: F.coalesce(named([c])[0].cast("string"), F.lit(" "))
    there = F.lit(True) if keep is None else F.coalesce(*named([keep]), F.lit(False))
    return turns.select(*named([id_col, turn], ["id", "turn"]), F.when(there, one(role)).alias("role"), F.when(there, one(text)).alias("text"))


def _schema(rows: DataFrame, rest: str) -> StructType:
    return StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL(rest)])


def _parts(rows: DataFrame, long_turns: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the conversations that are handled whole, and of those that are dealt out, if any."""
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b")).where(f"n > {long_turns} OR b > {long_bytes}")
    long = durable(sizes.select(F.col("id").alias("long_id")))
    if not long.limit(1).count():
        return rows, None
    few, same = bounded(long), F.col("id").eqNullSafe(F.col("long_id"))
    return rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")


def _sorted(rows: DataFrame) -> DataFrame:
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("id").sortWithinPartitions(*order).select("id", "turn", "role", "text")


def _long_pieces(rows: DataFrame, chunk_turns: int) -> DataFrame:
    """(id, part, no, counts, audit, turns) of the conversations that are dealt out, in pieces that (part, no) order."""
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"), F.col("row"))
    rows = durable(rows.where("role IS NOT NULL").withColumns({"row": F.monotonically_increasing_id(), "said": F.sha2(F.col("text").cast("binary"), 256)}))
    first = rows.groupBy("id", "role", "said").agg(F.min(place).alias("first")).select(F.col("id").alias("f_id"), F.col("role").alias("f_role"), F.col("said").alias("f_said"), "first")
    same = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("role") == F.col("f_role")) & (F.col("said") == F.col("f_said"))
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "row"]
    told = rows.join(first, same).select("id", "turn", "role", "text", "row", (F.col("first") != place).alias("again"))
    chunk = _schema(rows, f"part long, no long, turns {TURN_SQL}, faults array<string>")
    chunks = durable(told.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "role", "text", "again").mapInArrow(_chunks(chunk_turns), chunk))
    sums = chunks.mapInArrow(_summed, _schema(rows, "part long, no long, sides array<long>, counts array<long>, illegal long, first string, final string"))
    deal = ["part", "no"]
    phases = sums.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), *deal).mapInArrow(_phases, _schema(rows, "part long, no long, begin long, end long, last boolean, blank long, duplicate long, truncated long, illegal long, cost long"))
    counts = ", ".join(f"{c} long" for c in COUNTS[1:])
    return chunks.join(durable(phases).drop("id"), deal).mapInArrow(_pieces, _schema(rows, f"part long, no long, {counts}, audit string, turns {TURN_SQL}"))


def audited(turns: DataFrame, *, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep: str | None = None, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """A row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns stand by number (nulls first), equal numbers by role, then text.  Of
    each turn the first fault counts: no character but ASCII white space
    (blank), role and text seen earlier (duplicate), last such character none of
    ``.!?`` (truncated).  Keep costs 0, Rerole to user or assistant 1, Delete 2
    (blank and duplicate turns have to go), Insert of an empty user or assistant
    turn 5; a truncated turn that stays costs 5.  The audit has the initials of
    the cheapest edits that leave role initials ``(s?(ua)+)?``, the least in
    ASCII order of these.  gaps: numbers missing between the least and the
    largest.  repaired_sha256: of ``role:text`` of all turns that are left,
    joined by newlines.

    Null roles and texts are one space; a null id is an id of its own.  Rows
    where the boolean column ``keep`` is false (or null) are no turns, but their
    conversation has its row: without turns zeros, an empty audit and the hash of
    nothing.  Repeated rows are duplicates.  Other columns are not read.
    """
    rows = _rows(turns, id_col, turn, role, text, keep)
    whole, long = _parts(rows, long_turns, long_bytes)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    out = _sorted(whole).mapInArrow(_whole(False), _schema(rows, f"{counts}, audit string, repaired_sha256 string"))
    if long is not None:
        pieces = _long_pieces(long, chunk_turns)
        one = pieces.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "part", "no").mapInArrow(_joined, _schema(rows, ", ".join(f"{c} long" for c in COUNTS[1:]) + ", audit string, repaired_sha256 string"))
        numbers = long.where("role IS NOT NULL").groupBy("id", "turn").agg(F.lit(1).alias("x")).groupBy("id").agg(_gaps().alias("gaps"), F.max("x").alias("x"))
        one = numbers.withColumnRenamed("id", "n_id").join(one, F.col("id").eqNullSafe(F.col("n_id")))
        none = long.groupBy("id").agg(F.count("role").alias("n")).where("n = 0")
        nothing = none.select("id", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
        out = out.unionByName(one.select(*out.columns)).unionByName(nothing)
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def _gaps() -> Column:
    return F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")


def repaired(turns: DataFrame, *, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep: str | None = None, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The turns that ``audited`` leaves: (conv_id, part, no, pos, role, text); the three numbers order a conversation's turns."""
    rows = _rows(turns, id_col, turn, role, text, keep)
    whole, long = _parts(rows, long_turns, long_bytes)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    out = _sorted(whole).mapInArrow(_whole(True), _schema(rows, f"{counts}, audit string, repaired_sha256 string, turns {TURN_SQL}"))
    out = out.select("id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("no"), "turns")
    if long is not None:
        out = out.unionByName(_long_pieces(long, chunk_turns).select("id", "part", "no", "turns"))
    out = out.select("id", "part", "no", F.posexplode("turns").alias("pos", "turn"))
    return out.select(F.col("id").alias(id_col), "part", "no", "pos", F.col("turn")["role"].alias(role), F.col("turn")["text"].alias(text))


def damaged(turns: DataFrame, *, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, keep) with faults by the crc32 of ``conv_id:turn`` modulo 20 (nulls as one space).

    0: keep is false; 1: the text is empty; 2: it loses its ``.!?``; 3: the row
    stands twice; 4: the role is user.  Other columns are not kept.
    """
    one = lambda c: F.coalesce(named([c])[0].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(id_col), F.lit(":"), one(turn)).cast("binary")) % 20
    rows = turns.select(*named([id_col, turn]), one(role).alias("r"), one(text).alias("t"), kind.alias("kind"))
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    rows = rows.withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(*named([id_col, turn]), F.when(F.col("kind") == 4, "user").otherwise(F.col("r")).alias(role), new.alias(text), (F.col("kind") != 0).alias("keep"))
