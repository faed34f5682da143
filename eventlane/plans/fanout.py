"""Core-topic records to destinations: decode, route, deliver, settle, dead-letter."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlane.operators import delivery
from eventlane.operators.delivery import RetryPolicy, Send
from eventlane.operators.envelopes import bad, decode_envelope, encode_envelope, good
from eventlane.operators.plugins import Plugin
from eventlane.operators.routing import (
    NoOutputPolicy,
    SmashRoute,
    apply_destination_plugins,
    expand_destinations,
    no_output,
    route_smash,
)
from eventlane.session import staged
from eventlane.sources.batches import BatchSink, read_batches


@dataclass(frozen=True)
class Adapter:
    """A destination: how its body is shaped and how it is sent (None where attempts of others are only judged)."""

    id: str
    make_send: Callable[[], Send] | None
    shape: Callable[[Column], Column] = encode_envelope
    policy: RetryPolicy = RetryPolicy()
    plugins: tuple[Plugin, ...] = ()


@dataclass(frozen=True)
class FanoutConfig:
    routes: Sequence[SmashRoute]
    adapters: Sequence[Adapter] = ()
    no_output: NoOutputPolicy = NoOutputPolicy()
    partitions: int | None = None
    concurrency: int = 8
    deadline: float | None = None


@dataclass(frozen=True)
class Planned:
    """One batch: its routed events, planned deliveries, and what reaches nothing or cannot be read."""

    events: DataFrame
    deliveries: DataFrame
    unreached: DataFrame
    undecodable: DataFrame
    unread: DataFrame = field(repr=False)


def routed_events(records: DataFrame, config: FanoutConfig) -> DataFrame:
    """Records decoded and routed once (batch or stream); undecodable ones keep their bytes and ``decode_error``."""
    decoded = decode_envelope(records)
    kept = [c for c in ("topic", "partition", "offset", "record") if c in decoded.columns]
    bytes_of_bad = F.when(F.col("decode_error").isNotNull(), F.col("value")).alias("value")
    events = decoded.select(*kept, bytes_of_bad, "envelope", "decode_error", "envelope.id", "envelope.event_type")
    return route_smash(events, config.routes)


def plan_deliveries(records: DataFrame, config: FanoutConfig) -> Planned:
    """Stateless half (batch or stream): one row per record and destination."""
    return planned(routed_events(records, config), config)


def planned(routed: DataFrame, config: FanoutConfig) -> Planned:
    """Deliveries of routed events, and the events that have none."""
    live = good(routed)
    own = ["record"] if "record" in routed.columns else []
    steps = expand_destinations(live).select(
        *own, "id", "topic", "envelope", "event_type", "envelope.payload", "envelope.meta", "step", "route_id", "adapter_id", "required"
    )
    plugins: Mapping[str, Sequence[Plugin]] = {a.id: a.plugins for a in config.adapters if a.plugins}
    done = apply_destination_plugins(steps, plugins, [a.id for a in config.adapters] or None)
    changed = F.struct(
        F.col("envelope.id").alias("id"), F.col("envelope.source").alias("source"), F.col("event_type").alias("event_type"),
        F.col("envelope.received_at").alias("received_at"), F.col("payload").alias("payload"), F.col("meta").alias("meta"),
    )
    deliveries = done.withColumn("envelope", changed).drop("payload", "meta", "event_type")
    unread = bad(routed)
    undecodable = unread.drop("matches", "envelope", "id", "event_type", "record")
    return Planned(live, deliveries, no_output(live, config.no_output), undecodable, unread)


def shaped(deliveries: DataFrame, config: FanoutConfig) -> DataFrame:
    """Deliveries with the ``body`` their adapter sends, in one pass for all adapters."""
    body = F.lit(None).cast("string")
    for adapter in config.adapters:
        body = F.when(F.col("adapter_id") == adapter.id, adapter.shape(F.col("envelope"))).otherwise(body)
    columns = ("record", "id", "step", "route_id", "adapter_id", "required", "plugin_error")
    return deliveries.select(*columns, body.alias("body"))


def send_all(ready: DataFrame, config: FanoutConfig) -> DataFrame:
    """Attempt the steps of each record in order, up to its first required failure."""
    if not config.adapters:
        raise ValueError("no adapter is configured")
    receivers = {a.id: delivery.Receiver(a.make_send, a.policy) for a in config.adapters}
    return delivery.deliver_in_order(
        ready, receivers, partitions=config.partitions, concurrency=config.concurrency, deadline=config.deadline
    )


def step_results(deliveries: DataFrame, attempts: DataFrame) -> DataFrame:
    """(record, id, step, route_id, adapter_id, required, failed, error) of every planned step.

    A step that its record never came to has not failed; the step that stopped
    the record has.
    """
    keys = ("record", "step")
    outcomes = delivery.attempt_outcome(attempts.select(*keys, "attempt", "http_status", "error"), 1, keys).select(
        F.col("record").alias("o_record"), F.col("step").alias("o_step"), "outcome", F.col("error").alias("send_error")
    )
    joined = deliveries.select("record", "id", "step", "route_id", "adapter_id", "required", "plugin_error").join(
        outcomes, (F.col("record") == F.col("o_record")) & (F.col("step") == F.col("o_step")), "left"
    )
    failed = F.col("plugin_error").isNotNull() | F.coalesce(F.col("outcome") != "success", F.lit(False))
    return joined.select(
        "record", "id", "step", "route_id", "adapter_id", "required", failed.alias("failed"),
        F.coalesce(F.col("plugin_error"), F.col("send_error")).alias("error"),
    )


Write = Callable[[DataFrame], None] | BatchSink


def process_batch(
    records: DataFrame,
    config: FanoutConfig,
    attempts_path: str,
    batch_id: int,
    write_dead: Write,
    write_undecodable: Write,
    write_unreached: Write | None = None,
    query: str = "fanout",
) -> DataFrame:
    """One micro-batch end to end, for ``foreachBatch``.

    Returns one row per record (record, id, topic, outcome, reason): ``commit``,
    ``dlq``, ``discard``, ``error`` or ``undecodable``. An event without a
    destination follows the no-output policy; where that is an error, it goes
    to ``write_unreached``, and without one the batch fails before anything is
    sent, so that the stream's offsets do not pass it.

    A batch that failed may be run again. Its steps (``routed``, ``bodies``,
    ``attempts``, ``accounts`` below ``attempts_path``) are kept by query and
    batch id. Until its delivery is finished, a repeated batch is routed anew,
    so a corrected configuration counts; after that the steps are read, so
    nothing is sent again and records keep their numbers. A ``BatchSink`` as
    writer holds the batch's rows once however often it is run; a plain
    function is called again. A batch that was finished only gives its account.
    Records are told apart by place, not by event id.
    """
    spark = records.sparkSession
    steps = {name: BatchSink(f"{attempts_path.rstrip('/')}/{name}", query) for name in (*_WORK, "attempts", "accounts", "finished")}
    if steps["finished"].committed(spark, batch_id) is not None:
        return steps["accounts"].committed(spark, batch_id)

    attempts = steps["attempts"].committed(spark, batch_id)
    if attempts is None:
        routed = routed_events(records, config).withColumn("record", F.monotonically_increasing_id())
        plan = planned(steps["routed"].replace(routed, batch_id), config)
        if write_unreached is None:
            _refuse_unreached(plan, batch_id)
        ready = steps["bodies"].replace(shaped(plan.deliveries, config), batch_id)
        attempts = steps["attempts"].replace(send_all(ready, config), batch_id)
    else:
        plan = planned(steps["routed"].committed(spark, batch_id), config)
        ready = steps["bodies"].committed(spark, batch_id)

    def judged() -> DataFrame:
        return _account(plan, delivery.settle(step_results(ready, attempts), ("record", "id")))

    account = steps["accounts"].once(judged, spark, batch_id)
    failed_at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    _put(write_dead, delivery.dead_letters(plan.events, account, failed_at), batch_id)
    _put(write_undecodable, plan.undecodable, batch_id)
    if write_unreached is not None:
        _put(write_unreached, plan.unreached.filter("outcome = 'error'").drop("record"), batch_id)
    steps["finished"].replace(account.groupBy("topic", "outcome").agg(F.count("*").alias("records")), batch_id)
    for name in _WORK:
        steps[name].vacuum(spark, batch_id, keep_last=False)
    return account


# Steps whose rows are of no use once the batch is finished.
_WORK = ("routed", "bodies")


def _refuse_unreached(plan: Planned, batch_id: int) -> None:
    lost = plan.unreached.filter("outcome = 'error'")
    if count := lost.count():
        raise RuntimeError(f"{count} events of batch {batch_id} reach no destination: {lost.first()['reason']}")


def _put(write: Write, df: DataFrame, batch_id: int) -> None:
    if isinstance(write, BatchSink):
        write.replace(df, batch_id)
    else:
        write(df)


def account_of(records: DataFrame, attempts: DataFrame, config: FanoutConfig) -> DataFrame:
    """What became of each record of a log, judged by landed attempts: rows as ``process_batch`` gives them.

    ``records`` carry a unique ``record``; ``attempts`` hold (record, step,
    attempt, http_status, error), whoever sent them. The last attempt of a step
    counts. A step without an attempt has not failed, and attempts of steps that
    the configuration does not plan are ignored.
    """
    plan = planned(staged(routed_events(records, config), "routed"), config)
    return _account(plan, delivery.settle(step_results(plan.deliveries, attempts), ("record", "id")))


def read_attempts(spark: SparkSession, attempts_path: str) -> DataFrame:
    """Delivery attempts of all batches, with ``query`` and ``batch_id``."""
    return read_batches(spark, f"{attempts_path.rstrip('/')}/attempts")


def _account(plan: Planned, settled: DataFrame) -> DataFrame:
    """One row per record of a batch."""
    topics = plan.events.select(F.col("record").alias("of"), "topic")
    sent = settled.join(topics, F.col("record") == F.col("of")).select("record", "id", "topic", "outcome", "reason")
    outcome = F.when(F.col("outcome") == "commit", "discard").otherwise(F.col("outcome")).alias("outcome")
    unreached = plan.unreached.select("record", "id", "topic", outcome, "reason")
    none = F.lit(None).cast("string")
    unread = plan.unread.select("record", none.alias("id"), "topic", F.lit("undecodable").alias("outcome"), F.col("decode_error").alias("reason"))
    return sent.unionByName(unreached).unionByName(unread)


def start(
    records: DataFrame,
    config: FanoutConfig,
    attempts_path: str,
    checkpoint: str,
    write_dead: Write,
    write_undecodable: Write,
    write_settled: Write = lambda settled: None,
    trigger: dict | None = None,
    write_unreached: Write | None = None,
    query: str = "fanout",
):
    """Run the fan-out over a stream of topic records, batch by batch.

    Offsets advance once a batch is sent, settled and dead-lettered. Batch
    numbers are those of the checkpoint: with a new checkpoint, give a new
    ``query`` or ``attempts_path``.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        account = process_batch(df, config, attempts_path, batch_id, write_dead, write_undecodable, write_unreached, query)
        _put(write_settled, account, batch_id)

    writer = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
