"""Shaping, sending and settling deliveries."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.text import truncate_bytes
from eventlane.operators.envelopes import compact_envelope
from eventlane.session import staged

MIN_MESSAGE_BYTES = 128


def shape_http_payload(envelope: Column, max_bytes: int = 4000) -> Column:
    """``{source, eventType, id, receivedAt, payload}`` with truncated payload text."""
    if max_bytes < MIN_MESSAGE_BYTES:
        raise ValueError(f"max_bytes must be at least {MIN_MESSAGE_BYTES}")
    return F.to_json(
        F.struct(
            envelope["source"].alias("source"),
            envelope["event_type"].alias("eventType"),
            envelope["id"].alias("id"),
            envelope["received_at"].alias("receivedAt"),
            truncate_bytes(F.to_json(envelope["payload"]), max_bytes).alias("payload"),
        )
    )


def shape_tool_call(envelope: Column, tool_name: str, jsonrpc: bool = False, request_id: str = "1") -> Column:
    """Tool invocation around the whole envelope, plain or as a JSON-RPC call.

    Keys come out sorted, as JSON objects do on this wire. ``request_id`` names
    a JSON-RPC call.
    """
    arguments = F.struct(F.parse_json(F.to_json(compact_envelope(envelope))).alias("envelope"))
    if not jsonrpc:
        return F.to_json(F.struct(arguments.alias("arguments"), F.lit(tool_name).alias("tool")))
    return F.to_json(
        F.struct(
            F.lit(request_id).alias("id"),
            F.lit("2.0").alias("jsonrpc"),
            F.lit("tools/call").alias("method"),
            F.struct(arguments.alias("arguments"), F.lit(tool_name).alias("name")).alias("params"),
        )
    )


KEY_MODES = ("event_id", "source", "none")


def kafka_key(envelope: Column, mode: str = "event_id") -> Column:
    if mode not in KEY_MODES:
        raise ValueError(f"unsupported kafka_output key_mode '{mode}'")
    if mode == "none":
        return F.lit(None).cast("string")
    return envelope["id"] if mode == "event_id" else envelope["source"]


# --- sending -----------------------------------------------------------------


@dataclass(frozen=True)
class RetryPolicy:
    """``max_retries`` counts attempts. ``retry_all`` retries every error
    (frame clients); otherwise 4xx other than 429 is permanent. Tool calls use
    a single attempt."""

    max_retries: int = 5
    backoff_base: float = 1
    backoff_max: float = 30
    retry_all: bool = False

    def __post_init__(self) -> None:
        if self.max_retries < 1:
            raise ValueError("max_retries must be at least 1")

    def delay(self, attempt_index: int) -> float:
        if self.retry_all:
            return self.backoff_base
        return min(self.backoff_base * 2 ** min(attempt_index, 31), self.backoff_max)


FRAMES = RetryPolicy(max_retries=1, backoff_base=0.2, retry_all=True)
SINGLE = RetryPolicy(max_retries=1)

# A sender gets (idempotency key, body) and returns an HTTP status, or raises
# TimeoutError / ConnectionError for a retryable transport failure.
Send = Callable[[str, str], int]


def retryable(status: int | None, error: str | None, policy: RetryPolicy) -> bool:
    if policy.retry_all:
        return True
    if status is None:
        return error in ("timeout", "connection")
    return status >= 500 or status == 429


def attempt_rows(
    key: str, body: str, send: Send, policy: RetryPolicy, sleep: Callable[[float], None], until: float | None = None
) -> list[tuple]:
    """(attempt, status, transport error, backoff) of one delivery.

    A pause that would end after ``until`` (monotonic seconds) is not taken:
    the delivery is left pending for a later run.
    """
    rows = []
    for attempt in range(1, policy.max_retries + 1):
        status, error = None, None
        try:
            status = send(key, body)
        except TimeoutError:
            error = "timeout"
        except ConnectionError:
            error = "connection"
        except Exception as other:  # a permanent request error is a result, not a crash
            error = f"request: {type(other).__name__}"
        ok = status is not None and 200 <= status < 300
        again = not ok and attempt < policy.max_retries and retryable(status, error, policy)
        delay = policy.delay(attempt - 1) if again else None
        rows.append((attempt, status, error, delay))
        if not again or (until is not None and time.monotonic() + delay > until):
            break
        sleep(delay)
    return rows


ATTEMPTS = (
    "id string, step int, route_id string, adapter_id string, required boolean, "
    "attempt int, http_status int, error string, backoff double"
)


@dataclass(frozen=True)
class Receiver:
    """How one adapter's rows are sent: a client for each thread, and when to try again."""

    make_send: Callable[[], Send]
    policy: RetryPolicy = RetryPolicy()


class _Clients(threading.local):
    def __init__(self, receivers: Mapping[str, Receiver]) -> None:
        self.receivers, self.made = receivers, {}

    def __getitem__(self, adapter: str) -> Send:
        if adapter not in self.made:
            self.made[adapter] = self.receivers[adapter].make_send()
        return self.made[adapter]


def deliver_in_order(
    deliveries: DataFrame,
    receivers: Mapping[str, Receiver],
    key: str = "record",
    partitions: int | None = None,
    concurrency: int = 8,
    deadline: float | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Walk each record's steps in order and return one row per attempt.

    ``key`` names a record, so records of equal id stay apart. A record stops
    at its first required step that fails or whose plugins failed; what comes
    later is not sent. One pass serves all adapters. ``concurrency`` records of
    a task are under way at once; after ``deadline`` seconds a task starts no
    retry, and what is left pends. Delivery is at least once: a retried task
    sends again under the same idempotency key (event id, step).
    """
    columns = [key, "id", "step", "route_id", "adapter_id", "required", "plugin_error", "body"]
    spread = deliveries.select(*columns)
    spread = (spread.repartition(partitions, key) if partitions else spread.repartition(key)).sortWithinPartitions(key, "step")
    schema = f"{key} bigint, {ATTEMPTS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = _Clients(receivers)
        until = None if deadline is None else time.monotonic() + deadline

        def walk(rows: list) -> list[tuple]:
            out = []
            for row in rows:
                ok = False
                if row.plugin_error is None:
                    policy = receivers[row.adapter_id].policy
                    tries = attempt_rows(f"{row.id}/{row.step}", row.body, clients[row.adapter_id], policy, sleep, until)
                    out += [(row[0], row.id, row.step, row.route_id, row.adapter_id, row.required, *t) for t in tries]
                    ok = tries[-1][1] is not None and 200 <= tries[-1][1] < 300
                if row.required and not ok:
                    break
            return out

        def frame(done: Iterable[list[tuple]]) -> pd.DataFrame:
            names = [*columns[:6], "attempt", "http_status", "error", "backoff"]
            return pd.DataFrame([t for rows in done for t in rows], columns=names).astype({"http_status": "Int32"})

        held: list = []
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                records: list[list] = []
                for row in batch.itertuples(index=False):
                    if held and held[0][0] != row[0]:
                        records.append(held)
                        held = []
                    held.append(row)
                yield frame(pool.map(walk, records))
            if held:
                yield frame([walk(held)])

    return spread.mapInPandas(run, schema)


def deliver(
    deliveries: DataFrame,
    make_send: Callable[[], Send],
    policy: RetryPolicy = RetryPolicy(),
    partitions: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    concurrency: int = 8,
    deadline: float | None = None,
) -> DataFrame:
    """Send each row's ``body`` and return one row per attempt.

    ``make_send`` builds a client for each thread. Delivery over HTTP is at
    least once: a retried task sends again under the same idempotency key
    (event id, step), so receivers can drop the repeat. Rows are spread over
    ``partitions`` tasks by event id; a task has at most ``concurrency``
    requests under way, so a slow receiver does not stall all its rows.
    """
    spread = deliveries.repartition(partitions, "id") if partitions else deliveries
    columns = ["id", "step", "route_id", "adapter_id", "required"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = _Clients({"": Receiver(make_send)})
        until = None if deadline is None else time.monotonic() + deadline

        def tries(row) -> list[tuple]:
            rows = attempt_rows(f"{row.id}/{row.step}", row.body, clients[""], policy, sleep, until)
            return [(row.id, row.step, row.route_id, row.adapter_id, row.required, *t) for t in rows]

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                out = [t for rows in pool.map(tries, batch.itertuples(index=False)) for t in rows]
                yield pd.DataFrame(
                    out, columns=[*columns, "attempt", "http_status", "error", "backoff"]
                ).astype({"http_status": "Int32"})

    return spread.select(*columns, "body").mapInPandas(run, ATTEMPTS)


deliver_http = deliver


def deliver_tool(deliveries: DataFrame, make_send: Callable[[], Send], **options) -> DataFrame:
    """One tool call per event, no retry."""
    return deliver(deliveries, make_send, SINGLE, **options)


def deliver_frames(deliveries: DataFrame, make_send: Callable[[], Send], policy: RetryPolicy = FRAMES, **options) -> DataFrame:
    """One text frame per event; every error is retried after a fixed pause."""
    return deliver(deliveries, make_send, policy, **options)


# --- outcomes ------------------------------------------------------------------


def attempt_outcome(attempts: DataFrame, max_retries: int = 5, keys: tuple[str, ...] = ("id", "step")) -> DataFrame:
    """Last attempt of each delivery classed as success, permanent or exhausted.

    Combined map-side: only the last attempt per delivery travels.
    """
    others = [c for c in ("route_id", "adapter_id", "required") if c in attempts.columns and c not in keys]
    last = F.max_by(F.struct("http_status", "error", *others), "attempt").alias("last")
    grouped = attempts.groupBy(*keys).agg(F.max("attempt").alias("attempts"), last)
    status, error = F.col("last.http_status"), F.col("last.error")
    success = status.between(200, 299)
    retry = (status >= 500) | (status == 429) | error.isin("timeout", "connection")
    outcome = (
        F.when(F.coalesce(success, F.lit(False)), "success")
        .when(F.coalesce(retry, F.lit(False)) & (F.col("attempts") >= max_retries), "exhausted")
        .when(F.coalesce(retry, F.lit(False)), "pending")
        .otherwise("permanent")
    )
    detail = F.coalesce(F.concat(F.lit("destination returned "), status.cast("string")), error)
    message = (
        F.when(outcome == "exhausted", F.concat(F.lit("forward failed after "), F.col("attempts").cast("string"), F.lit(" attempts: "), detail))
        .when(outcome == "permanent", F.concat(F.lit("forward failed permanently: "), detail))
    )
    return grouped.select(
        *keys, *(F.col(f"last.{c}").alias(c) for c in others), "attempts",
        status.alias("http_status"), outcome.alias("outcome"), message.alias("error"),
    )


def settle(steps: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per-event outcome from its delivery steps.

    ``steps`` holds (id, step, route_id, adapter_id, required, failed, error).
    Steps count in order up to the first required failure, which dead-letters
    the event and leaves it uncommitted; optional failures are ignored. ``keys``
    name a record: where ids can repeat, give the record beside the id. A plain
    aggregate, combined map-side.
    """
    broken = F.col("required") & F.col("failed")
    first = F.min_by(
        F.struct("step", "route_id", "adapter_id", "error"), F.when(broken, F.col("step"))
    ).alias("first")
    reason = F.concat(
        F.lit("required destination adapter '"), F.col("first.adapter_id"), F.lit("' failed on route '"),
        F.col("first.route_id"), F.lit("': "), F.col("first.error"),
    )
    return (
        steps.groupBy(*keys)
        .agg(
            first,
            F.count(F.lit(1)).alias("planned_steps"),
            F.count_if(~F.col("required") & F.col("failed")).alias("optional_failures"),
        )
        .select(
            *keys,
            F.when(F.col("first").isNotNull(), "dlq").otherwise("commit").alias("outcome"),
            F.col("first.step").alias("failed_step"),
            reason.alias("reason"),
            "planned_steps",
            "optional_failures",
        )
    )


def executed_steps(steps: DataFrame, settled: DataFrame) -> DataFrame:
    """Steps that ran: those up to and including the first required failure.

    The cuts are staged: where ``settled`` comes of ``steps``, one task would
    otherwise sort the steps twice at once.
    """
    cut = staged(settled.filter(F.col("failed_step").isNotNull()).select(F.col("id").alias("cut_id"), "failed_step"), "cuts")
    return (
        steps.join(cut, F.col("id") == F.col("cut_id"), "left")
        .filter(F.col("failed_step").isNull() | (F.col("step") <= F.col("failed_step")))
        .drop("cut_id", "failed_step")
    )


def dead_letters(events: DataFrame, settled: DataFrame, failed_at: Column, key: str = "record") -> DataFrame:
    """Dead-letter rows (failed_at, error, envelope) of records settled as ``dlq``."""
    lost = settled.filter(F.col("outcome") == "dlq").select(F.col(key).alias("lost"), "reason")
    return events.join(lost, F.col(key) == F.col("lost")).select(
        failed_at.alias("failed_at"), F.col("reason").alias("error"), "envelope"
    )
