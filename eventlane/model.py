"""Schemas of the records that flow through the pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw delivery as landed by a collector: header names are lower-cased on landing.
RAW_REQUEST = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("adapter_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("peer_ip", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),
    ]
)

META = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("ingress_adapter", T.StringType()),
        T.StructField("route_key", T.StringType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("received_at", T.StringType()),
        T.StructField("payload", T.VariantType()),
        T.StructField("meta", META),
    ]
)

DLQ_ENVELOPE = T.StructType(
    [
        T.StructField("failed_at", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("envelope", ENVELOPE),
    ]
)

# Column layout of the Kafka source, also used by the table-backed topic log.
TOPIC_RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

_VM = [
    T.StructField("ping", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("firecracker_pid", T.StringType()),
    T.StructField("firecracker_state", T.StringType()),
]

BROKER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("port_9092", T.StringType()),
        *_VM,
    ]
)

HEARTBEAT = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("uptime_seconds", T.DoubleType()),
        T.StructField("load", T.StringType()),
        T.StructField(
            "memory",
            T.StructType(
                [
                    T.StructField("available_kb", T.LongType()),
                    T.StructField("total_kb", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "vms",
            T.StructType(
                [
                    T.StructField(
                        "relay", T.StructType([T.StructField("port_8080", T.StringType()), *_VM])
                    ),
                    T.StructField("kafka_brokers", T.ArrayType(BROKER)),
                ]
            ),
        ),
        T.StructField("services", T.MapType(T.StringType(), T.StringType())),
        T.StructField("health_endpoint", T.StringType()),
        T.StructField("external_connectivity", T.StringType()),
    ]
)

ATTEMPT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("adapter_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("backoff", T.LongType()),
    ]
)
