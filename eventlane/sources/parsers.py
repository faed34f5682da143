"""Parsing landed socket, tool and Kafka records into (source, payload, event_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.payload import (
    at,
    body_text,
    computed_once,
    optional_string,
    parse_json,
    string_at,
    tokens_at,
    value_type,
)


def _document(df: DataFrame, value: str) -> DataFrame:
    return computed_once(df, _doc=parse_json(body_text(value)))


def _event_type() -> Column:
    return F.transform(tokens_at("_doc", [("event_type",)]), optional_string)[0]


def parse_kafka_ingress(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``source``, ``payload``, ``event_type`` and ``parse_error``.

    Both accepted shapes, the full envelope and the compact object, agree on
    these three fields, so one strict read of them covers both; inbound id,
    time and meta are not kept. A null record is marked ``missing payload``.
    """
    read = computed_once(
        _document(df, value),
        _source=string_at("_doc", "source"), _payload=at("_doc", "payload"), _event=_event_type(),
    )
    valid = F.col("_source").isNotNull() & F.col("_payload").isNotNull() & F.coalesce(F.col("_event.fits"), F.lit(False))
    return computed_once(
        read,
        source=F.when(valid, F.col("_source")),
        payload=F.when(valid, F.col("_payload")),
        event_type=F.when(valid, F.col("_event.text")),
        parse_error=F.when(F.col(value).isNull(), F.lit("missing payload"))
        .when(F.col("_doc").isNull(), F.lit("invalid json"))
        .when(~valid, F.lit("missing or mistyped field")),
    ).drop("_doc", "_source", "_payload", "_event")


# A tool call has the compact shape.
parse_mcp_call = parse_kafka_ingress


def parse_ws_frame(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``payload``, ``event_type`` and ``parse_error`` of text frames.

    A frame without a (non-null) ``payload`` field, or with an event type that
    is not a string, is itself the payload.
    """
    read = computed_once(_document(df, value), _inner=at("_doc", "payload"), _event=_event_type())
    framed = F.coalesce(F.col("_event.fits"), F.lit(False))
    inner = F.col("_inner")
    given = inner.isNotNull() & (value_type(inner) != "VOID")
    return computed_once(
        read,
        payload=F.when(framed & given, inner).otherwise(F.col("_doc")),
        event_type=F.when(framed, F.col("_event.text")),
        parse_error=F.when(F.col("_doc").isNull(), F.lit("parse websocket frame JSON")),
    ).drop("_doc", "_inner", "_event")
