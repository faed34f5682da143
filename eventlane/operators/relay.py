"""Moving records between topics: fan-in, replay, stage reconciliation, tracing."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.operators.envelopes import decode_dlq, decode_envelope, encode_envelope


def relay_fan_in(records: DataFrame, core_topic: str, mode: str = "envelope") -> tuple[DataFrame, DataFrame]:
    """(forwarded, left behind) of a multi-topic scan.

    Key and value bytes are kept, headers are not. Envelope mode leaves
    undecodable records behind; both modes leave null values behind.
    """
    if mode not in ("envelope", "raw"):
        raise ValueError("mode must be 'envelope' or 'raw'")
    checked = decode_envelope(records) if mode == "envelope" else records.withColumn(
        "decode_error", F.when(F.col("value").isNull(), F.lit("missing payload"))
    )
    forwarded = checked.filter(F.col("decode_error").isNull()).select(
        F.lit(core_topic).alias("topic"), "key", "value"
    )
    left = checked.filter(F.col("decode_error").isNotNull()).select(*records.columns, "decode_error")
    return forwarded, left


def fan_in(*topics: DataFrame) -> DataFrame:
    """Several topic scans as one, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), topics)


def replay_dlq(dead_letters: DataFrame, core_topic: str, condition: Column | None = None) -> DataFrame:
    """Core-topic records of the inner envelopes of dead-letter records.

    ``condition`` may use ``failed_at``, ``error`` and ``envelope``.
    """
    rows = dead_letters if "envelope" in dead_letters.columns else decode_dlq(dead_letters)
    if "decode_error" in rows.columns:
        rows = rows.filter(F.col("decode_error").isNull())
    if condition is not None:
        rows = rows.filter(condition)
    return rows.select(
        F.lit(core_topic).alias("topic"),
        F.col("envelope.id").alias("key"),
        encode_envelope("envelope").alias("value"),
    )


def replay_topic(
    records: DataFrame,
    target_topic: str,
    condition: Column | None = None,
    since: str | None = None,
    until: str | None = None,
    first_offset: int | None = None,
    last_offset: int | None = None,
) -> DataFrame:
    """Retained records re-addressed to another topic.

    Bounds on timestamp and offset (both inclusive) are plain filters on
    scan columns and so are pushed into the scan.
    """
    rows = records
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.filter(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    if first_offset is not None:
        rows = rows.filter(F.col("offset") >= first_offset)
    if last_offset is not None:
        rows = rows.filter(F.col("offset") <= last_offset)
    if condition is not None:
        rows = rows.filter(condition)
    return rows.select(F.lit(target_topic).alias("topic"), "key", "value")


def reconcile_stages(source_ids: DataFrame, core_ids: DataFrame, done_ids: DataFrame) -> DataFrame:
    """Events lost between stages as (id, missing).

    ``done_ids`` holds both delivered and dead-lettered ids. Each input has an
    ``id`` column; anti joins on it need no more than the ids.
    """
    not_relayed = source_ids.select("id").join(core_ids.select("id"), "id", "left_anti")
    not_done = core_ids.select("id").join(done_ids.select("id"), "id", "left_anti")
    return not_relayed.withColumn("missing", F.lit("core")).unionByName(
        not_done.withColumn("missing", F.lit("delivery"))
    )


def reconcile_stages_stream(
    source: DataFrame, core: DataFrame, delay: str = "10 minutes", time: str = "timestamp"
) -> DataFrame:
    """Streaming twin for one hop: (id) rows of ``source`` that do not show up in
    ``core`` within ``delay``. A left outer join bounded by watermarks, so its
    state is dropped once the answer is known."""
    left = source.select("id", F.col(time).alias("sent_at")).withWatermark("sent_at", delay)
    right = core.select(F.col("id").alias("core_id"), F.col(time).alias("seen_at")).withWatermark("seen_at", delay)
    joined = left.join(
        right,
        (F.col("id") == F.col("core_id"))
        & (F.col("seen_at") >= F.col("sent_at"))
        & (F.col("seen_at") <= F.col("sent_at") + F.expr(f"interval {delay}")),
        "leftOuter",
    )
    return joined.filter(F.col("core_id").isNull()).select("id", "sent_at")


def trace_event(stages: Mapping[str, DataFrame], event_id: str | None = None, trace_id: str | None = None) -> DataFrame:
    """All stage rows of one event or trace, in stage order.

    Each stage table has (id, trace_id, at, detail). The filter is applied
    before the union and reaches every scan.
    """
    if (event_id is None) == (trace_id is None):
        raise ValueError("give either event_id or trace_id")
    wanted = F.col("id") == event_id if event_id is not None else F.col("trace_id") == trace_id
    parts = [
        table.filter(wanted).select(
            F.lit(order).alias("stage_order"), F.lit(name).alias("stage"), "id", "trace_id", "at", "detail"
        )
        for order, (name, table) in enumerate(stages.items())
    ]
    return fan_in(*parts).orderBy("stage_order", "at")
