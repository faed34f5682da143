"""Counters, histograms, lag and listings over the pipeline's own tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.functions.injection import PATTERNS, pattern_hits
from eventlane.functions.text import folded_lower, redact_text

# Counter names and their labels.
METRICS = {
    "serve_ingress_events_total": ("adapter", "source"),
    "serve_publish_success_total": ("topic",),
    "serve_publish_failure_total": ("topic", "reason"),
    "smash_consume_events_total": ("topic",),
    "smash_egress_success_total": ("adapter",),
    "smash_egress_failure_total": ("adapter", "reason"),
    "smash_commit_total": ("topic",),
    "smash_dlq_total": ("topic",),
}
LABELS = ("adapter", "source", "topic", "reason")


def metrics(events: DataFrame, window: str | None = None, time: str = "received_at") -> DataFrame:
    """Counters from a long table of (metric, adapter, source, topic, reason).

    Labels a metric does not have are blanked. With ``window`` (for example
    ``1 minute``) counts are per window; on a stream set a watermark first.
    """
    keep = {
        label: F.when(F.col("metric").isin(*[m for m, labels in METRICS.items() if label in labels]), F.col(label))
        for label in LABELS
    }
    known = events.filter(F.col("metric").isin(*METRICS)).withColumns(keep)
    keys: list = ["metric", *LABELS]
    if window is not None:
        keys.insert(0, F.window(time, window).alias("window"))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


@dataclass(frozen=True)
class Count:
    """One counter a row may feed: the metric, when it does, and its labels."""

    metric: str
    when: Column
    labels: Mapping[str, Column]

    def __post_init__(self) -> None:
        unknown = set(self.labels) - set(METRICS[self.metric])
        if unknown:
            raise ValueError(f"{self.metric} has no labels {sorted(unknown)}")


def metric_rows(df: DataFrame, *counts: Count) -> DataFrame:
    """Long metric rows of several counters from one pass over ``df``."""
    hits = [
        F.when(
            count.when,
            F.struct(
                F.lit(count.metric).alias("metric"),
                *(count.labels.get(name, F.lit(None)).cast("string").alias(name) for name in LABELS),
            ),
        )
        for count in counts
    ]
    # A generator's own expressions are not compiled, so it is given a column.
    held = df.select(F.array(*hits).alias("_hits"))
    return held.select(F.inline("_hits")).filter(F.col("metric").isNotNull())


def latency_histogram(
    df: DataFrame,
    keys: Sequence[str],
    latency: str = "latency_ms",
    failed: str = "failed",
    bounds: Sequence[float] = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 20000),
) -> DataFrame:
    """Events and errors per latency bucket; ``le`` is the upper bound, null above all."""
    le = F.coalesce(*(F.when(F.col(latency) <= bound, F.lit(float(bound))) for bound in bounds))
    return df.groupBy(*keys, le.alias("le")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col(failed)).alias("errors")
    )


def latency_percentiles(df: DataFrame, keys: Sequence[str], latency: str = "latency_ms", accuracy: int = 10_000) -> DataFrame:
    """p50, p95 and p99 per key from a mergeable sketch of bounded size."""
    marks = F.percentile_approx(latency, [0.5, 0.95, 0.99], accuracy)
    return df.groupBy(*keys).agg(marks.alias("p")).select(
        *keys, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99")
    )


def dlq_summary(dead: DataFrame) -> DataFrame:
    """Dead letters per source, event type and error, with the latest failure time."""
    return dead.groupBy(
        F.col("envelope.source").alias("source"), F.col("envelope.event_type").alias("event_type"), "error"
    ).agg(F.count(F.lit(1)).alias("dead_letters"), F.max("failed_at").alias("last_failed_at"))


def consumer_lag(records: DataFrame, committed: DataFrame) -> DataFrame:
    """End offset minus committed offset per group, topic and partition.

    ``committed`` has (group, topic, partition, committed): the next offset to
    read. The record side is reduced to one row per partition first.
    """
    ends = records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    return committed.join(ends, ["topic", "partition"], "left").select(
        "group", "topic", "partition",
        F.coalesce("end_offset", F.lit(0)).alias("end_offset"),
        "committed",
        F.greatest(F.coalesce("end_offset", F.lit(0)) - F.col("committed"), F.lit(0)).alias("lag"),
    )


def tail_logs(lines: DataFrame, n: int = 300, source: str = "source", order: Sequence[str] = ("ts", "line_no")) -> DataFrame:
    """Last ``n`` lines per log source.

    Spark drops rows beyond rank ``n`` before the shuffle, so a long log does
    not travel.
    """
    if n < 1:
        raise ValueError("n must be positive")
    window = Window.partitionBy(source).orderBy(*(F.col(c).desc() for c in order))
    return lines.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n).drop("rn")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Last or first ``k`` rows of the whole table under an order."""
    return df.orderBy(*order).limit(k)


def log_manifest(lines: DataFrame, collectors: DataFrame) -> DataFrame:
    """Per collector: name, file, success, error.

    ``collectors`` has (name, file, error). A collector without an error
    succeeded, with or without lines; ``lines`` counts what it gave.
    """
    counted = lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"))
    return collectors.join(counted, collectors["name"] == counted["source"], "left").select(
        "name",
        F.when(F.col("error").isNull(), F.col("file")).alias("file"),
        F.col("error").isNull().alias("success"),
        "error",
        F.coalesce("lines", F.lit(0)).alias("lines"),
    )


def redact_logs(lines: DataFrame, column: str = "line") -> DataFrame:
    """Mask secrets in single lines. A key block spans lines: use whole texts for it."""
    return lines.withColumn(column, redact_text(column))


def scan_text(texts: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per-pattern counts of texts that hold an injection phrase.

    Whole texts are tested; the counts combine map-side, so only one short row
    per pattern and task is shuffled.
    """
    hits = pattern_hits(F.col(text), F.col("_folded"))
    numbered = F.array(*(F.when(hit, F.lit(i)) for i, hit in enumerate(hits)))
    found = (
        texts.select(*keep, text, folded_lower(text).alias("_folded"))
        .select(*keep, F.explode(F.array_compact(numbered)).alias("pattern_id"))
    )
    names = F.array(*(F.lit(p) for p in PATTERNS))
    return (
        found.groupBy(*keep, "pattern_id")
        .agg(F.count(F.lit(1)).alias("texts"))
        .withColumn("pattern", F.element_at(names, F.col("pattern_id") + 1))
    )
