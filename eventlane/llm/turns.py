"""Repair of conversation structure by dynamic programming over sorted streams.

A conversation should read ``(system? (user assistant)+)?``. Its rows come to
one task sorted by turn, and the state of the search is carried from one Arrow
batch to the next: for each of four places in the pattern the least cost of the
edits so far. Which edits led there is kept as one small number a row. Where a
conversation is so long that these and its rows pass a bound, they go to a
scratch file of the task, and all rows before a point that every surviving
choice goes through are settled and leave.

Whether a row repeats an earlier one is found before, on digests, since it
needs all of a conversation's rows: markers of such rows travel with the stream.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.session import staged

# What is not white space, and the ends of sentences.
_SEEN, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
# Kinds of rows of the stream: a dropped one, a marker of the repeat that follows, a row.
DROPPED, MARK, ROW = range(3)

DELETE, INSERT, KEEP, REROLE = "DIKR"
RETYPE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
# Places in the pattern: before all, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
# Where inserted rows lead, up to two of them.
_INSERTED = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
# Characters of text that are held before they go to the scratch file, and rows between looks at that.
HELD, _LOOK = 1 << 23, 4096


def damaged(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with seeded damage, by the checksum of their id and turn: ``id_col, turn, role, text, dropped``.

    Of twenty values 0 drops the row (it stays, marked), 1 empties its text, 2
    takes out its ``.!?``, 3 repeats it, 4 makes its role ``user``. Null ids and
    turns count as one space in the checksum and stay null; null roles and texts
    become one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn)).cast("binary")) % 20
    own = rows.select(F.col(id_col), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), harm.alias("harm"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    hurt = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = own.select(
        id_col, "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"),
        (F.col("harm") == 0).alias("dropped"), F.explode(copies).alias("copy"),
    )
    return made.drop("copy")


def _stream(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows, dropped rows without content, and markers: ``id, turn, role, digest, kind, text, fault``."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    own = rows.select(F.col(id_col).alias("id"), "turn", "role", "text", F.coalesce("dropped", F.lit(False)).alias("dropped"))
    last = F.col("text").rlike(_ENDED)
    fault = F.when(~F.col("text").rlike(_SEEN), BLANK).when(last, SOUND).otherwise(TRUNCATED)
    live = own.where("not dropped").select("id", "turn", "role", digest.alias("digest"), F.lit(ROW).alias("kind"), "text", fault.alias("fault"))
    gone = own.where("dropped").select("id").distinct().select("id", F.lit(DROPPED).alias("kind"))
    # One narrow row a content and turn; the first turn of a content (null is the least) marks no repeat.
    narrow = live.groupBy("id", "role", "digest", "turn").agg(F.lit(1).alias("one"))
    first = narrow.groupBy("id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    again = staged(narrow.select(F.col("id").alias("i"), F.col("role").alias("r"), F.col("digest").alias("d"), "turn").join(
        first, F.col("i").eqNullSafe(F.col("id")) & (F.col("r") == F.col("role")) & (F.col("d") == F.col("digest"))
    ).where(~F.col("turn").eqNullSafe(F.col("first.turn"))).select("id", "turn", "role", "digest"), "repeats")
    marks = again.withColumn("kind", F.lit(MARK))
    return live.unionByName(marks, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


Best = tuple[int, int, str]  # cost, rank of the edits among those of other places, insertions behind that
Places = tuple[Best | None, ...]
Step = tuple[tuple[int, str, int] | None, ...]  # for each place: the place before, the edit, insertions after


def _inserted(reached: dict[int, tuple[Best, tuple[int, str, int]]]) -> tuple[list, list]:
    """The places with up to two insertions behind the last edit."""
    best: list[Best | None] = [None] * 4
    how: list[tuple[int, str, int] | None] = [None] * 4
    for place, ((cost, rank, _), step) in reached.items():
        ways = [(place, 0), *((to, n) for n, to in enumerate(_INSERTED[place], 1))]
        for to, n in ways:
            found = (cost + n * INSERT_COST, rank, INSERT * n)
            if best[to] is None or found < best[to]:
                best[to], how[to] = found, (step[0], step[1], n)
    return best, how


def _settled(best: list, how: list) -> tuple[Places, int, Step]:
    """Costs from zero on, without places that can no longer be on the way to the best end."""
    # From an assistant row on, all that can follow the start or the system row can follow
    # for at most the cost of deleting a system row; between user and assistant lies an insertion.
    slack = {START: ((ASSISTANT, DELETE_COST),), SYSTEM: ((ASSISTANT, 0),), USER: ((ASSISTANT, INSERT_COST),), ASSISTANT: ((USER, INSERT_COST),)}
    for place, bounds in slack.items():
        if best[place] and any(best[other] and best[place][0] > best[other][0] + more for other, more in bounds):
            best[place] = how[place] = None
    low = min(b[0] for b in best if b)
    return tuple(b and (b[0] - low, *b[1:]) for b in best), low, tuple(how)


def _advance(places: Places, initial: str, fault: int) -> tuple[Places, int, Step]:
    """One row further: (places, what the least cost grew by, how each place was reached)."""
    ways: dict[int, list] = {}
    for place, best in enumerate(places):
        if best is None:
            continue
        cost, rank, tail = best

        def go(to: int, edit: str, more: int, place=place, cost=cost, rank=rank, tail=tail) -> None:
            ways.setdefault(to, []).append((cost + more, rank, tail + edit, place, edit))

        go(place, DELETE, DELETE_COST)
        if fault in (SOUND, TRUNCATED):
            worse = TRUNCATED_COST if fault == TRUNCATED else 0
            if (place, initial) in _AFTER:
                go(_AFTER[place, initial], KEEP, worse)
            go(ASSISTANT if place == USER else USER, REROLE, RETYPE_COST + worse)
    least = {to: min(found) for to, found in ways.items()}
    # The edits of two places never begin one another here, since each ends with this row's edit.
    order = {key: i for i, key in enumerate(sorted((rank, tail) for _, rank, tail, _, _ in least.values()))}
    return _settled(*_inserted({to: ((c, order[r, t], ""), (place, edit, 0)) for to, (c, r, t, place, edit) in least.items()}))


_first_best, _first_how = _inserted({START: ((0, 0, ""), (START, "", 0))})
BEGIN: tuple[Places, Step] = (tuple(_first_best), tuple(_first_how))

# Every step that occurred in this process: few, for costs are relative and places four.
_known: dict[tuple, tuple[Places, int, int]] = {}
_steps: list[Step] = [BEGIN[1]]


def _step(places: Places, initial: str, fault: int) -> tuple[Places, int, int]:
    """``_advance``, remembered; the step by its number."""
    key = (places, initial, fault)
    found = _known.get(key)
    if found is None:
        after, cost, step = _advance(places, initial, fault)
        _steps.append(step)
        found = _known[key] = (after, cost, len(_steps) - 1)
    return found


class _Conversation:
    """The state carried along one conversation."""

    def __init__(self, conversation: object) -> None:
        self.id = conversation
        self.faults = [0] * 4
        self.illegal = self.turns = 0
        self.low = self.high = self.turn = None
        self.last = self.mark = None
        self.before = ""
        self.places, self.cost = BEGIN[0], 0
        self.steps, self.rows, self.size = np.zeros(_LOOK, "<u4"), [], 0
        self.spilled, self.chunks = None, []
        self.begun = False
        self.audit, self.hash, self.lines = bytearray(), hashlib.sha256(), 0

    def add(self, turn: int | None, role: str, digest: bytes, text: str, fault: int) -> None:
        content = (turn, role, digest)
        if fault != BLANK and content in (self.last, self.mark):
            fault = DUPLICATE
        self.last = content
        self.faults[fault] += 1
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        initial = role[:1]
        if sum(self.faults) > 1 and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.places, cost, step = _step(self.places, initial, fault)
        self.cost += cost
        if len(self.rows) == len(self.steps):
            self.steps = np.concatenate([self.steps, np.zeros(len(self.steps), "<u4")])
        self.steps[len(self.rows)] = step
        self.rows.append((role, text))
        self.size += len(role) + len(text)
        if self.size > HELD or len(self.rows) % (64 * _LOOK) == 0:
            self._lighten()

    def _lighten(self) -> None:
        """Write what is settled to the results; if that is nothing, put the rows into the scratch file."""
        live = {place for place, best in enumerate(self.places) if best}
        for i in range(len(self.rows) - 1, -1, -1):
            step = _steps[self.steps[i]]
            live = {step[place][0] for place in live}
            if len(live) == 1:
                rest, steps = self.rows[i:], self.steps[i : len(self.rows)].copy()
                self._settle(live.pop(), i)
                self.rows, self.steps = rest, np.concatenate([steps, np.zeros(_LOOK, "<u4")])
                self.size = sum(len(r) + len(t) for r, t in rest)
                break
        if self.size > HELD // 2 or len(self.rows) > 32 * _LOOK:
            self._spill()

    def _spill(self) -> None:
        if self.spilled is None:
            self.spilled = tempfile.TemporaryFile()
        start = self.spilled.seek(0, 2)
        self.spilled.write(self.steps[: len(self.rows)].tobytes())
        body = self.spilled.tell()
        pickle.dump(self.rows, self.spilled, pickle.HIGHEST_PROTOCOL)
        self.chunks.append((start, body, len(self.rows)))
        self.rows, self.size = [], 0

    def _settle(self, place: int, count: int) -> None:
        """Results of the spilled rows and the first ``count`` held ones, of which the last ends at ``place``."""
        chunks = [*self.chunks, (None, None, count)]
        ends = []
        for start, _, n in reversed(chunks):
            ends.append(place)
            for step in reversed(self._steps_of(start, n)):
                place = _steps[step][place][0]
        for (start, body, n), last in zip(chunks, reversed(ends), strict=True):
            self._emit(self._steps_of(start, n), self.rows[:n] if body is None else self._rows_of(body), last)
        if self.spilled is not None:
            self.spilled.close()
        self.spilled, self.chunks = None, []

    def _steps_of(self, start: int | None, n: int) -> list[int]:
        if start is None:
            return self.steps[:n].tolist()
        self.spilled.seek(start)
        return np.frombuffer(self.spilled.read(4 * n), "<u4").tolist()

    def _rows_of(self, body: int) -> list[tuple[str, str]]:
        self.spilled.seek(body)
        return pickle.load(self.spilled)

    def _emit(self, steps: list[int], rows: list[tuple[str, str]], last: int) -> None:
        """Audit and repaired text of consecutive rows, of which the last ends at ``last``."""
        chosen = []
        for step in reversed(steps):
            chosen.append((_steps[step][last], last))
            last = chosen[-1][0][0]
        if not self.begun:
            self._insert(BEGIN[1][last][2], last)
            self.begun = True
        for ((place, edit, more), to), (role, text) in zip(reversed(chosen), rows, strict=True):
            self.audit += edit.encode()
            if edit == KEEP:
                self._line(f"{role}:{text}")
            elif edit == REROLE:
                self._line(f"{_NAMES[ASSISTANT if place == USER else USER]}:{text}")
            self._insert(more, to)

    def _insert(self, n: int, to: int) -> None:
        """The insertions that end at a place: alternating, the last with that place's role."""
        for left in range(n - 1, -1, -1):
            self.audit += INSERT.encode()
            self._line(_NAMES[to if left % 2 == 0 else USER + ASSISTANT - to] + ":")

    def _line(self, line: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.lines += 1
        self.hash.update(line.encode())

    def result(self) -> tuple:
        ends = [(best, place) for place, best in enumerate(self.places) if best and place in (START, ASSISTANT)]
        (more, _, _), place = min(ends)
        self._settle(place, len(self.rows))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
            self.cost + more, self.audit.decode(), self.hash.hexdigest(),
        )


def repair(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``rows`` has ``id_col, turn, role, text`` and ``dropped`` (such rows only
    name their conversation). A conversation's rows are taken by turn, nulls
    first; rows of one turn by role and text digest. A row's first fault counts:
    blank (nothing but white space), duplicate (role and text of an earlier
    row), truncated (last character no ``.!?``). ``gaps`` counts the turns that
    lack between the first and the last, ``illegal`` the neighbours other than
    system-user, user-assistant and assistant-user.

    The cheapest edits that give ``(system? (user assistant)+)?`` by role
    initials: Keep 0, Rerole 1, Delete 2, Insert an empty row 5; blank and
    duplicate rows must go, truncated ones that stay cost 5 more. ``audit`` holds
    the initials of the edits, of equal costs the least string; the digest is of
    the repaired rows ``role:text`` joined by newlines.

    Null roles and texts count as empty, null ids as one conversation. A
    conversation without rows has zeros, an empty audit and the digest of the
    empty text. Extra columns are ignored; an empty table gives no rows.
    """
    own = rows.select(id_col, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "dropped")
    kind = own.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    # A null id or turn would make its column one of floats in pandas.
    stream = _stream(own, id_col).select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), F.col("id").isNull().alias("unnamed"),
        F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"), "role", "digest", "kind", "text", "fault",
    )
    cast = int if kind in ("tinyint", "smallint", "int", "bigint") else str

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, name, done = None, None, []

        def frame(results: list[tuple]) -> pd.DataFrame:
            names = ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            table = pd.DataFrame(results, columns=names)
            return table.assign(id=pd.Series([r[0] for r in results], dtype="Int64" if cast is int else "object"))

        for batch in batches:
            columns = [batch[c].tolist() for c in ("key", "unnamed", "timed", "turn", "role", "digest", "kind", "text", "fault")]
            for key, unnamed, timed, turn, role, digest, of, text, fault in zip(*columns, strict=True):
                if name != (key, unnamed):
                    if current is not None:
                        done.append(current.result())
                        if len(done) == 1000 or len(done[-1][7]) > HELD:
                            yield frame(done)
                            done = []
                    current, name = _Conversation(None if unnamed else cast(key)), (key, unnamed)
                at = int(turn) if timed else None
                if of == MARK:
                    current.mark = (at, role, digest)
                elif of == ROW:
                    current.add(at, role, digest, text, int(fault))
        if current is not None:
            done.append(current.result())
        if done:
            yield frame(done)

    order = ["key", "unnamed", "timed", "turn", "role", "digest", "kind"]
    found = stream.repartition("key", "unnamed").sortWithinPartitions(*order).mapInPandas(run, schema)
    return found.withColumnRenamed("id", id_col)
