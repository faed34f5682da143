"""Scans of landed data. Each works in batch and, unless noted, as a stream."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlane import model
from eventlane.operators.envelopes import decode_envelope


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def read_requests(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet", **options) -> DataFrame:
    """Landed HTTP deliveries as raw request rows."""
    return _reader(spark, stream).format(fmt).schema(model.RAW_REQUEST).options(**options).load(path)


def read_topics(
    spark: SparkSession,
    topics: Sequence[str],
    bootstrap: str | None = None,
    table_path: str | None = None,
    stream: bool = False,
    starting_offsets: str | None = None,
    ending_offsets: str | None = None,
    **options,
) -> DataFrame:
    """Several topics as one scan with the Kafka source schema.

    With ``bootstrap`` it is the Kafka source (its connector jar is needed);
    with ``table_path`` a table of the same schema, partitioned by topic, so
    that the topic filter prunes files. New streams start at the latest offset.
    """
    if not topics:
        raise ValueError("at least one topic is needed")
    if (bootstrap is None) == (table_path is None):
        raise ValueError("give either bootstrap or table_path")
    if table_path is not None:
        table = _reader(spark, stream).schema(model.TOPIC_RECORD).options(**options).parquet(table_path)
        return table.filter(F.col("topic").isin(*topics))
    reader = (
        _reader(spark, stream)
        .format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting_offsets or ("latest" if stream else "earliest"))
        .options(**options)
    )
    if ending_offsets and not stream:
        reader = reader.option("endingOffsets", ending_offsets)
    return reader.load().select(*model.TOPIC_RECORD.fieldNames())


def read_replay_files(spark: SparkSession, path: str, envelope_mode: bool = True) -> DataFrame:
    """One JSON envelope per file, as ``value`` bytes (batch only).

    Envelope mode adds ``envelope`` and ``decode_error``; raw mode passes bytes.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("content").alias("value"), F.col("path"))
    return decode_envelope(files) if envelope_mode else files


LOG_TIME = r"\A(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"


def read_logs(
    spark: SparkSession, path: str, since: str | None = None, until: str | None = None, stream: bool = False
) -> DataFrame:
    """Log lines as (source, ts, line_no, line).

    The source is the file's path below ``path`` without ``.log``, or its name
    where ``path`` is the file. ``line_no`` grows along a file but has gaps: it
    is the place of the line's split in the file plus the line's number in its
    task, which stays below the size of a split. A stream has no ``line_no``.
    """
    lines = _reader(spark, stream).option("recursiveFileLookup", "true").text(path)
    root = re.sub(r"\A[a-z]+:/+", "/", path).rstrip("/")
    below = F.regexp_replace("_metadata.file_path", rf"\A.*?{re.escape(root)}/", "")
    name = F.when(F.contains("_metadata.file_path", F.lit(root + "/")), below).otherwise(F.element_at(F.split("_metadata.file_path", "/"), -1))
    number = F.lit(None).cast("bigint")
    if not stream:
        number = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = lines.select(
        F.regexp_replace(name, r"\.log\z", "").alias("source"),
        F.regexp_extract(F.col("value"), LOG_TIME, 1).try_cast("timestamp").alias("ts"),
        number.alias("line_no"),
        F.col("value").alias("line"),
    )
    return log_bounds(tagged, since, until)


def log_bounds(lines: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Lines with ``since <= ts <= until``; undated lines, such as those of a traceback, always stay."""
    undated = F.col("ts").isNull()
    if since is not None:
        lines = lines.filter(undated | (F.col("ts") >= F.lit(since).cast("timestamp")))
    if until is not None:
        lines = lines.filter(undated | (F.col("ts") <= F.lit(until).cast("timestamp")))
    return lines


def read_heartbeats(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Heartbeat snapshots (nested JSON) with a fixed schema, no inference pass."""
    return _reader(spark, stream).schema(model.HEARTBEAT).json(path)

