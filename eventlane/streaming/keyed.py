"""Streaming twins of the keyed folds.

Keys are dealt into a fixed number of buckets, and a bucket is the unit of
state: one number per key in a map of the state store. A micro-batch costs one
Python call a bucket, not one a key or row, and reads and writes the state of
the keys it brings. The rules are the ones of ``operators.folds``.

No row is lost. The watermark only moves time: the operators see it, but the
column that carries it is turned into a plain number before, so Spark has
nothing to drop rows by. Each row gets a decision, in one of two orders:

* ``arrival``: at once, by (time, seq) within its micro-batch, against what is
  stored. A row earlier than its key's state is judged against that state.
* ``event``: rows wait until the watermark has passed them, and are then
  judged in order of time. That is the batch fold's answer for all rows that
  come within ``delay``. Rows behind the watermark are judged at once.

State is kept until the watermark is ``delay`` beyond the time at which it
stopped to matter. A row from before state that is gone, or in event order one
from before what its key last accepted, has the decision ``late``.

Operators can follow each other in one query: none of their outputs carries a
watermark column, and Spark passes the watermark itself on. ``prepare`` selects
the RocksDB state store, which these operators need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from eventlane.functions.text import safe_key
from eventlane.operators.folds import (
    ACCEPT,
    COOLDOWN,
    DUPLICATE,
    accepted_positions,
    bucket_admissions,
    refill_period_ms,
)

LATE = "late"
BUCKETS = 256
# Rows that are judged and given out at once.
BLOCK = 50_000
_MOST = 1 << 24


class Rule:
    """How the rows of a key are judged in order, with one number as state."""

    def judge(self, times: list[int], stored: int | None) -> tuple[list[bool], int]:
        """(accepted per row, value to store) for sorted times."""
        raise NotImplementedError

    def ends(self, stored: int) -> int | None:
        """The event time in ms from which the stored value no longer matters; None for never."""
        raise NotImplementedError

    def unknown(self, time: int, stored: int | None, floor_ms: int, exact: bool) -> bool:
        """Whether a row cannot be judged any more: state that ended before ``floor_ms`` is gone."""
        return False


class TtlRule(Rule):
    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def judge(self, times, stored):
        accepted = [False] * len(times)
        kept, expiry = accepted_positions(times, 0, len(times), stored, self.ttl)
        for i in kept:
            accepted[i] = True
        return accepted, expiry

    def ends(self, stored):
        return stored * 1000

    def unknown(self, time, stored, floor_ms, exact):
        if stored is None:
            return time * 1000 < floor_ms
        return exact and time < stored - self.ttl


class CountRule(Rule):
    """The key names one bucket of time, so its state goes when that has ended."""

    def __init__(self, limit: int, bucket_seconds: int) -> None:
        if not 0 <= limit < _MOST:
            raise ValueError(f"a stream counts up to {_MOST - 1} a bucket")
        self.limit, self.bucket_seconds = limit, bucket_seconds

    def judge(self, times, stored):
        # The stored number holds the bucket's end beside the count.
        end, used = (self.end(times[0]), 0) if stored is None else divmod(stored, _MOST)
        accepted = [used + i < self.limit for i in range(len(times))]
        return accepted, end * _MOST + min(used + len(times), self.limit)

    def end(self, time: int) -> int:
        return time // self.bucket_seconds + 1

    def ends(self, stored):
        return stored // _MOST * self.bucket_seconds * 1000

    def unknown(self, time, stored, floor_ms, exact):
        return stored is None and self.end(time) * self.bucket_seconds * 1000 < floor_ms


class TokenRule(Rule):
    """An idle bucket holds one request more than a fresh one, so its state, one
    number an address, is kept for good, as the batch rule keeps it."""

    def __init__(self, limit: int) -> None:
        self.limit, self.period = limit, refill_period_ms(limit)

    def judge(self, times, stored):
        accepted, full_at = [], stored
        for now in times:
            hits, full_at = bucket_admissions([now], [1], 0, 1, full_at, self.period, self.limit)
            accepted.append(bool(hits))
        return accepted, full_at

    def ends(self, stored):
        return None


HELD = ("fold_key", "fold_time", "at_us", "seq", "carried")
ROW = "fold_key string, fold_time bigint, at_us bigint, seq bigint, carried string"


@dataclass
class _Block:
    codes: np.ndarray
    times: np.ndarray
    seq: np.ndarray
    at_us: np.ndarray
    carried: np.ndarray | None


class _Rows:
    """Rows of one bucket in numbers: a few keys can bring most of a micro-batch.

    A key is held once and its rows name it by number, and rows that carry
    nothing hold nothing for it; texts and Python numbers are made a block at a time.
    """

    def __init__(self) -> None:
        self.names: list[str] = []
        self.numbers: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.carried: list[np.ndarray] = []

    def add(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            return
        codes, found = pd.factorize(rows["fold_key"].to_numpy(object))
        for name in found:
            if name not in self.numbers:
                self.numbers[name] = len(self.names)
                self.names.append(name)
        known = np.array([self.numbers[name] for name in found], np.int64)
        # Copies: a view would keep the whole batch. Numbers that may be null come as floats, and nulls go last.
        self.parts.append((known[codes], *(rows[c].to_numpy(copy=True) for c in ("fold_time", "seq", "at_us"))))
        carried = rows["carried"]
        self.carried.append(carried.to_numpy(object, copy=True) if carried.notna().any() else np.empty(0, object))

    def named(self, codes: np.ndarray) -> np.ndarray:
        """The keys of numbers."""
        used, place = np.unique(codes, return_inverse=True)
        return np.array([self.names[u] for u in used], object)[place]

    def in_order(self, size: int = BLOCK) -> Iterator[_Block]:
        """The rows by key, time and seq, some at a time; they are given up."""
        if not self.parts:
            return
        carried = None
        if any(len(c) for c in self.carried):
            carried = np.concatenate([c if len(c) else np.full(len(p[0]), None, object) for c, p in zip(self.carried, self.parts, strict=True)])
        parts, self.parts, self.carried = self.parts, [], []
        codes, times, seq, at_us = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        order = np.lexsort((seq, times, codes))
        for start in range(0, len(order), size):
            at = order[start : start + size]
            yield _Block(codes[at], times[at], seq[at], at_us[at], None if carried is None else carried[at])


class Judge(StatefulProcessor):
    """Applies a rule to the rows of one bucket of keys; rows without a key pass."""

    def __init__(self, rule: Rule, refused: str, delay_ms: int, exact: bool) -> None:
        self.rule, self.refused, self.delay_ms, self.exact = rule, refused, delay_ms, exact

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "fold_key string", "value bigint")
        self.timer = handle.getValueState("timer", "at bigint")
        # The watermark up to which ended state has been removed.
        self.swept = handle.getValueState("swept", "at bigint")
        self.waiting = handle.getListState("waiting", ROW) if self.exact else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, came = _Rows(), False
        for batch in rows:
            keyed = batch["fold_key"].notna().to_numpy()
            if not keyed.all():
                yield self._passed(batch[~keyed])
                batch = batch[keyed]
            came = came or len(batch) > 0
            if self.exact:
                due = (batch["at_us"] // 1000 < now).to_numpy()
                self._hold(batch[~due])
                batch = batch[due]
            held.add(batch)
        if self.exact and came:
            held.add(self._ready(now))
        yield from self._judged(held, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        if self.exact:
            held = _Rows()
            held.add(self._ready(now))
            yield from self._judged(held, now)
        self._sweep(now)

    def close(self) -> None:
        pass

    def _hold(self, rows: pd.DataFrame) -> None:
        """Keep rows that the watermark has not passed."""
        if len(rows):
            self.waiting.appendList(list(zip(*[rows[c].tolist() for c in HELD], strict=True)))
            self._wake(int(rows["at_us"].min()) // 1000 + 1)

    def _ready(self, now: int) -> pd.DataFrame:
        """Take out the kept rows that the watermark has passed."""
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=list(HELD))
        due = (held["at_us"].astype("int64") // 1000 < now).to_numpy()
        if due.any():
            self.waiting.clear()
            self._hold(held[~due])
        return held[due]

    def _judged(self, held: _Rows, now: int) -> Iterator[pd.DataFrame]:
        """Decisions on rows in order of key, time and seq, and the state after them."""
        swept = self.swept.get()[0] if self.swept.exists() else None
        floor = -(1 << 62) if swept is None else swept - self.delay_ms
        wake = None
        codes = name = first = stored = None
        for block in held.in_order():
            decision = np.full(len(block.codes), self.refused, object)
            starts = [0, *(np.flatnonzero(block.codes[1:] != block.codes[:-1]) + 1).tolist()]
            for start, end in zip(starts, [*starts[1:], len(block.codes)], strict=True):
                if block.codes[start] != codes:
                    wake = self._keep(name, first, stored, wake)
                    codes, name = block.codes[start], (held.names[block.codes[start]],)
                    got = self.values.getValue(name)
                    first = stored = None if got is None else got[0]
                times, own = block.times[start:end].tolist(), range(start, end)
                # What is lost is told by the state that was stored before the batch.
                lost = {i for i, t in zip(own, times, strict=True) if self.rule.unknown(t, first, floor, self.exact)}
                if lost:
                    decision[sorted(lost)] = LATE
                    times, own = [t for i, t in zip(own, times, strict=True) if i not in lost], [i for i in own if i not in lost]
                    if not own:
                        continue
                accepted, stored = self.rule.judge(times, stored)
                decision[[i for i, ok in zip(own, accepted, strict=True) if ok]] = ACCEPT
            yield self._out(block.seq, held.named(block.codes), block.at_us, block.carried, decision)
        wake = self._keep(name, first, stored, wake)
        if wake is not None:
            self._wake(max(wake, now) + self.delay_ms)

    def _keep(self, name: tuple | None, before: int | None, value: int | None, wake: int | None) -> int | None:
        """Store a key's number if it changed; the earliest end of what was stored."""
        if name is None or value == before:
            return wake
        self.values.updateValue(name, (value,))
        ends = self.rule.ends(value)
        return wake if ends is None else ends if wake is None else min(wake, ends)

    def _wake(self, at_ms: int) -> None:
        """One timer a bucket is enough: the earliest."""
        held = self.timer.get() if self.timer.exists() else None
        if held is None or at_ms < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(at_ms)
            self.timer.update((at_ms,))

    def _sweep(self, now: int) -> None:
        """Remove what ended ``delay`` ago, and wake again for the rest."""
        gone, later = [], None
        for name, (value,) in self.values.iterator():
            ends = self.rule.ends(value)
            if ends is None:
                continue
            if ends + self.delay_ms <= now:
                gone.append(name)
            else:
                later = ends if later is None else min(later, ends)
        for name in gone:
            self.values.removeKey(name)
        if gone:
            self.swept.update((now,))
        if later is not None:
            self._wake(max(later, now) + self.delay_ms)

    def _passed(self, rows: pd.DataFrame) -> pd.DataFrame:
        return self._out(*(rows[c].to_numpy() for c in ("seq", "fold_key", "at_us", "carried")), ACCEPT)

    @staticmethod
    def _out(seq, fold_key, at_us, carried, decision) -> pd.DataFrame:
        return pd.DataFrame({"seq": seq, "fold_key": fold_key, "at_us": at_us, "carried": carried, "decision": decision})


def judged(
    df: DataFrame, rule: Rule, key: Column, time: Column, at: Column, refused: str,
    carry: Column | None = None, delay: str = "10 minutes", order: str = "arrival", buckets: int = BUCKETS,
) -> DataFrame:
    """(seq, fold_key, at_us, carried, decision) of a stream under a rule; blank keys are accepted.

    ``df`` has ``seq`` and, somewhere before, a watermark; ``carry`` is one
    string column that rows take along. A bucket of keys is one Python call a
    micro-batch, whose rows must fit in its memory, some 40 bytes each and what
    they carry: bound a trigger's rows.
    At most ``buckets`` tasks share the work, and a checkpoint is bound to the number.
    """
    if order not in ("arrival", "event"):
        raise ValueError("order is arrival or event")
    named = F.when(F.coalesce(key, F.lit("")) != "", key)
    spread = F.pmod(F.xxhash64(F.coalesce(named, F.col("seq").cast("string"))), F.lit(buckets)).cast("int")
    rows = df.select(
        spread.alias("bucket"), named.alias("fold_key"), time.cast("bigint").alias("fold_time"), F.unix_micros(at).alias("at_us"),
        F.col("seq").cast("bigint").alias("seq"), (F.lit(None) if carry is None else carry).cast("string").alias("carried"),
    )
    work = Judge(rule, refused, int(pd.Timedelta(delay).total_seconds() * 1000), order == "event")
    schema = "seq bigint, fold_key string, at_us bigint, carried string, decision string"
    return rows.groupBy("bucket").transformWithStateInPandas(work, schema, "Append", "EventTime")


def _run(
    df: DataFrame, rule: Rule, delay: str, key: Column, time: Column, at: str, refused: str, carry: tuple[str, ...] = (), order: str = "arrival"
) -> DataFrame:
    """Decisions of all rows; those with a blank key never meet the state and are accepted."""
    taken = F.to_json(F.struct(*carry), {"ignoreNullFields": "false"}) if carry else None
    found = judged(df.withWatermark(at, delay), rule, key, time, F.col(at), refused, taken, delay, order)
    kept = []
    if carry:
        found = found.withColumn("row", F.from_json("carried", df.select(*carry).schema))
        kept = [F.col("row")[c].alias(c) for c in carry]
    return found.select("seq", "fold_key", F.timestamp_micros("at_us").alias("at"), "decision", *kept)


def dedup_ttl_stream(
    df: DataFrame, ttl_seconds: int = 604_800, key: str = "dedup_key", epoch: str = "received_epoch",
    at: str = "received_at", delay: str = "10 minutes", carry: tuple[str, ...] = (), order: str = "arrival",
) -> DataFrame:
    """(seq, fold_key, at, decision) of a stream under the time-to-live rule, and the columns to ``carry``."""
    return _run(df, TtlRule(ttl_seconds), delay, F.col(key), F.col(epoch), at, DUPLICATE, carry, order)


def cooldown_stream(
    df: DataFrame, cooldown_seconds: int = 30, key: str = "cooldown_key", epoch: str = "received_epoch",
    at: str = "received_at", delay: str = "10 minutes", carry: tuple[str, ...] = (), order: str = "arrival",
) -> DataFrame:
    """Same for dedup survivors under their cooldown key."""
    return _run(df, TtlRule(cooldown_seconds), delay, F.col(key), F.col(epoch), at, COOLDOWN, carry, order)


def idempotency_stream(
    df: DataFrame, dedup_ttl_seconds: int = 604_800, cooldown_seconds: int = 30, dedup_key: str = "dedup_key",
    cooldown_key: str = "cooldown_key", epoch: str = "received_epoch", at: str = "received_at", delay: str = "10 minutes",
    order: str = "arrival",
) -> DataFrame:
    """(seq, decision): dedup, then cooldown of its survivors, as two operators of one query.

    In event order the second operator waits for the watermark as the first
    does: a row that the first passes on is by then behind it, and judged at
    once, in the order in which the first settled it.
    """
    taken = F.to_json(F.struct(F.col(cooldown_key).alias("ck"), F.col(epoch).alias("t")))
    first = judged(
        df.withWatermark(at, delay), TtlRule(dedup_ttl_seconds), F.col(dedup_key), F.col(epoch), F.col(at), DUPLICATE, taken, delay, order
    ).withColumn("row", F.from_json("carried", "ck string, t bigint"))
    # All rows go on, so that the first operator stands once in the plan.
    passed = (F.col("decision") == ACCEPT) & F.col("fold_key").isNotNull()
    second = judged(
        first.withColumn("before", F.col("decision")), TtlRule(cooldown_seconds), F.when(passed, F.col("row.ck")), F.col("row.t"),
        F.timestamp_micros("at_us"), COOLDOWN, F.col("before"), delay,
    )
    return second.select("seq", F.when(F.col("carried") == ACCEPT, F.col("decision")).otherwise(F.col("carried")).alias("decision"))


def alert_throttle_stream(
    df: DataFrame, cooldown_seconds: int = 300, key: str = "event", epoch: str = "epoch", at: str = "at", delay: str = "10 minutes",
    order: str = "arrival",
) -> DataFrame:
    return _run(df, TtlRule(cooldown_seconds), delay, safe_key(key), F.col(epoch), at, "suppressed", order=order)


def bucket_key(source: Column, epoch: Column, bucket_seconds: int) -> Column:
    """A source and its bucket of time as one key, so that few sources still spread."""
    bucket = F.call_function("div", epoch, F.lit(bucket_seconds)).cast("string")
    return F.when(source.isNotNull(), F.concat_ws("@", source, bucket))


def rate_limit_source_stream(
    df: DataFrame, limit: int = 500, bucket_seconds: int = 60, source: str = "source",
    epoch: str = "received_epoch", at: str = "received_at", delay: str = "10 minutes", order: str = "arrival",
) -> DataFrame:
    """First ``limit`` rows per source and bucket."""
    key = F.concat_ws("@", F.col(source), F.call_function("div", F.col(epoch), F.lit(bucket_seconds)).cast("string"))
    return _run(df, CountRule(limit, bucket_seconds), delay, key, F.col(epoch), at, "limited", order=order)


def rate_limit_ip_stream(
    df: DataFrame, limit_per_minute: int = 100, ip: str = "client_ip", millis: str = "received_ms",
    at: str = "received_at", delay: str = "10 minutes", order: str = "arrival",
) -> DataFrame:
    """Token bucket per address; rows without an address are accepted."""
    return _run(df, TokenRule(limit_per_minute), delay, F.col(ip), F.col(millis), at, "limited", order=order)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators dropped behind the watermark, over its known progress."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])


def dedup_approximate(df: DataFrame, key: str = "dedup_key", at: str = "received_at", delay: str = "7 days") -> DataFrame:
    """Built-in alternative whose retention follows the watermark, not first-seen + ttl."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
