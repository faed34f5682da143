"""Sinks. Retries and acknowledgements belong to the Kafka client and the checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.operators.delivery import kafka_key
from eventlane.operators.envelopes import encode_dlq, encode_envelope

RECORD = ("topic", "key", "value")


def to_records(df: DataFrame, topic: Column | str, envelope: str = "envelope", key_mode: str = "event_id") -> DataFrame:
    """Kafka sink rows (topic, key, value) of envelopes."""
    target = F.lit(topic) if isinstance(topic, str) else topic
    env = F.col(envelope)
    return df.select(
        target.alias("topic"), kafka_key(env, key_mode).alias("key"), encode_envelope(env).alias("value")
    )


def dlq_records(dead: DataFrame, topic: str) -> DataFrame:
    """Kafka sink rows of dead letters, keyed by event id."""
    return dead.select(
        F.lit(topic).alias("topic"),
        F.col("envelope.id").alias("key"),
        encode_dlq(F.col("failed_at"), F.col("error"), F.col("envelope")).alias("value"),
    )


def kafka_options(bootstrap: str, max_retries: int = 5, backoff_ms: int = 200, max_backoff_ms: int = 5000) -> dict[str, str]:
    """Producer settings of a publish policy; the client counts the tries after the first."""
    if max_retries < 1 or not 0 <= backoff_ms <= max_backoff_ms:
        raise ValueError("a publish policy needs at least one attempt and a backoff of at most its maximum")
    return {
        "kafka.bootstrap.servers": bootstrap,
        "kafka.acks": "all",
        "kafka.retries": str(max_retries - 1),
        "kafka.retry.backoff.ms": str(backoff_ms),
        "kafka.retry.backoff.max.ms": str(max_backoff_ms),
    }


def write_topic(
    records: DataFrame,
    bootstrap: str | None = None,
    table_path: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    max_retries: int = 5,
    backoff_ms: int = 200,
    max_backoff_ms: int = 5000,
    **options,
):
    """Publish (topic, key, value) rows; the ``topic`` column picks the target.

    A stream needs ``checkpoint`` and returns the started query. With
    ``table_path`` the rows go to a table partitioned by topic instead.
    ``max_retries`` counts attempts, the first included; the pause between them
    doubles from ``backoff_ms`` to ``max_backoff_ms``.
    """
    missing = [c for c in RECORD if c not in records.columns]
    if missing:
        raise ValueError(f"records need columns {missing}")
    if (bootstrap is None) == (table_path is None):
        raise ValueError("give either bootstrap or table_path")
    if table_path is None:
        options = {**kafka_options(bootstrap, max_retries, backoff_ms, max_backoff_ms), **options}
    fmt = "kafka" if table_path is None else "parquet"
    if records.isStreaming:
        if checkpoint is None:
            raise ValueError("a stream needs a checkpoint folder")
        writer = records.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
        writer = writer.options(**options).trigger(**(trigger or {"availableNow": True}))
        if table_path is not None:
            return writer.partitionBy("topic").start(table_path)
        return writer.start()
    writer = records.write.format(fmt).options(**options)
    if table_path is not None:
        return writer.mode("append").partitionBy("topic").save(table_path)
    return writer.save()


def write_output_topic(df: DataFrame, topic: str, key_mode: str = "event_id", **target):
    """Egress to a topic under a key mode."""
    return write_topic(to_records(df, topic, key_mode=key_mode), **target)


def write_dlq(dead: DataFrame, topic: str, **target):
    return write_topic(dlq_records(dead, topic), **target)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", checkpoint: str | None = None
):
    """Append to an audit table, partitioned for pruning (for example by date and source)."""
    if df.isStreaming:
        if checkpoint is None:
            raise ValueError("a stream needs a checkpoint folder")
        writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
        writer = writer.partitionBy(*partition_by) if partition_by else writer
        return writer.trigger(availableNow=True).start(path)
    writer = df.write.format(fmt).mode("append")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    return writer.save(path)


def quarantine(df: DataFrame, path: str, reason: str = "decode_error", **options):
    """Append the rows that carry a reason; nothing is dropped silently."""
    return write_table(df.filter(F.col(reason).isNotNull()), path, **options)
