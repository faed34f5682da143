"""Building, encoding and decoding the fixed envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.payload import (
    at,
    body_text,
    bound,
    computed_once,
    optional_string,
    parse_json,
    strings_at,
    tokens_at,
    value_type,
)

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def rfc3339(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), RFC3339)


def uuid_text(*parts: Column) -> Column:
    """UUID-shaped id that depends only on ``parts``.

    A retried task or a replay gives the same id, so downstream writes can be
    made idempotent. Version and variant digits are set as for version 4.
    """
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def build_meta(trace_id: Column, ingress_adapter: Column, route_key: Column, flags: Column) -> Column:
    """Meta struct, null when all four parts are empty."""
    empty = trace_id.isNull() & ingress_adapter.isNull() & route_key.isNull() & (
        F.coalesce(F.size(flags), F.lit(0)) <= 0
    )
    return F.when(
        ~empty,
        F.struct(
            trace_id.alias("trace_id"),
            ingress_adapter.alias("ingress_adapter"),
            route_key.alias("route_key"),
            flags.alias("flags"),
        ),
    )


def build_envelope(df: DataFrame, dedup_key: str | None = "dedup_key") -> DataFrame:
    """Add ``envelope`` from source, event_type, received_epoch, payload and meta.

    The id is derived from (source, dedup key, seq).
    """
    key = F.coalesce(F.col(dedup_key), F.lit("")) if dedup_key else F.lit("")
    return df.withColumn(
        "envelope",
        F.struct(
            uuid_text(F.col("source"), key, F.col("seq").cast("string")).alias("id"),
            F.col("source").alias("source"),
            F.col("event_type").alias("event_type"),
            rfc3339(F.col("received_epoch")).alias("received_at"),
            F.col("payload").alias("payload"),
            F.col("meta").alias("meta"),
        ),
    )


def _compact_meta(meta: Column) -> Column:
    return F.when(
        meta.isNotNull(),
        F.struct(
            meta["trace_id"].alias("trace_id"),
            meta["ingress_adapter"].alias("ingress_adapter"),
            meta["route_key"].alias("route_key"),
            F.when(F.size(meta["flags"]) > 0, meta["flags"]).alias("flags"),
        ),
    )


def compact_envelope(envelope: Column) -> Column:
    """Envelope struct whose empty optionals are null, so that JSON leaves them out."""
    return F.struct(
        envelope["id"].alias("id"),
        envelope["source"].alias("source"),
        envelope["event_type"].alias("event_type"),
        envelope["received_at"].alias("received_at"),
        envelope["payload"].alias("payload"),
        _compact_meta(envelope["meta"]).alias("meta"),
    )


def encode_envelope(envelope: Column | str) -> Column:
    """Wire JSON of an envelope; null meta, null optionals and empty flags omitted."""
    value = F.col(envelope) if isinstance(envelope, str) else envelope
    return F.to_json(compact_envelope(value))


def encode_dlq(failed_at: Column, error: Column, envelope: Column) -> Column:
    return F.to_json(
        F.struct(failed_at.alias("failed_at"), error.alias("error"), compact_envelope(envelope).alias("envelope"))
    )


_TEXTS = ("id", "source", "event_type", "received_at")
_META_TEXTS = ("trace_id", "ingress_adapter", "route_key")


def envelope_from(doc: Column) -> Column:
    """Envelope struct of a parsed document, null when it is not one.

    Required fields are strict, extra fields are ignored, ``payload`` may be
    JSON null but must be there. ``flags`` may be absent but not null.
    """
    parts = F.struct(
        strings_at(doc, [(name,) for name in _TEXTS]).alias("texts"),
        at(doc, "payload").alias("payload"),
        at(doc, "meta").alias("meta"),
        F.transform(tokens_at(doc, [("meta", name) for name in _META_TEXTS]), optional_string).alias("options"),
        at(doc, "meta", "flags").alias("flags"),
    )
    return bound(parts, _envelope_of)


def _envelope_of(parts: Column) -> Column:
    texts, payload, meta, options, flags = (parts[n] for n in ("texts", "payload", "meta", "options", "flags"))
    flag_items = F.try_variant_get(flags, "$", "array<variant>")
    flags_fit = flags.isNull() | F.coalesce(
        F.forall(flag_items, lambda item: F.coalesce(value_type(item) == "STRING", F.lit(False))), F.lit(False)
    )
    has_meta = meta.isNotNull() & ~F.coalesce(value_type(meta) == "VOID", F.lit(False))
    # Casting to a map of values is null for anything but an object.
    meta_fits = (
        F.try_variant_get(meta, "$", "map<string,variant>").isNotNull()
        & F.forall(options, lambda o: o["fits"])
        & flags_fit
    )
    valid = payload.isNotNull() & F.forall(texts, lambda t: t.isNotNull()) & (~has_meta | meta_fits)
    struct = F.struct(
        *(texts[i].alias(name) for i, name in enumerate(_TEXTS)),
        payload.alias("payload"),
        F.when(
            has_meta,
            F.struct(
                *(options[i]["text"].alias(name) for i, name in enumerate(_META_TEXTS)),
                F.coalesce(F.try_variant_get(flags, "$", "array<string>"), F.array().cast("array<string>")).alias("flags"),
            ),
        ).alias("meta"),
    )
    return F.when(valid, struct)


def _problem(value: str, decoded: Column, kind: str) -> Column:
    return (
        F.when(F.col(value).isNull(), F.lit("missing payload"))
        .when(F.col("_doc").isNull(), F.lit("invalid json"))
        .when(decoded.isNull(), F.lit(kind))
    )


def decode_envelope(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``envelope`` and ``decode_error`` (null when it decoded).

    Split with :func:`good` and :func:`bad`, so that undecodable rows are kept.
    """
    parsed = computed_once(df, _doc=parse_json(body_text(value)))
    decoded = computed_once(parsed, envelope=envelope_from(F.col("_doc")))
    return computed_once(decoded, decode_error=_problem(value, F.col("envelope"), "invalid envelope")).drop("_doc")


def decode_dlq(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``failed_at``, ``error``, ``envelope`` and ``decode_error`` of dead letters."""
    parsed = computed_once(df, _doc=parse_json(body_text(value)))
    outer = strings_at("_doc", [("failed_at",), ("error",)])
    decoded = computed_once(parsed, _outer=outer, _inner=bound(at("_doc", "envelope"), envelope_from))
    typed = F.forall("_outer", lambda t: t.isNotNull())
    named = decoded.select(
        "*",
        F.col("_outer")[0].alias("failed_at"),
        F.col("_outer")[1].alias("error"),
        F.when(typed, F.col("_inner")).alias("envelope"),
    )
    problem = _problem(value, F.col("envelope"), "invalid dead letter")
    return computed_once(named, decode_error=problem).drop("_doc", "_outer", "_inner")


def good(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("decode_error").isNull()).drop("decode_error")


def bad(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("decode_error").isNotNull()).drop("envelope")
