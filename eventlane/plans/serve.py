"""Landed HTTP deliveries to routed envelopes.

Two passes over the requests, for the sake of what is shuffled:

* ``decide`` reads each request once, evaluates all stateless gates in one
  projection and keeps a narrow row (ids, keys, codes; no body). Rate limits
  and the keyed folds run on narrow rows only.
* ``envelopes`` joins the accepted narrow rows back to the requests on the
  unique ``seq``, the only time bodies move, and sanitizes just those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.net import resolve_client_ip
from eventlane.functions.payload import computed_once, is_object_text
from eventlane.functions.signing import secrets_table
from eventlane.functions.text import blank_to_null, normalize_source
from eventlane.operators import folds, gates
from eventlane.operators.envelopes import build_envelope, build_meta, uuid_text
from eventlane.operators.plugins import Plugin, run_plugins
from eventlane.operators.routing import ServeRoute, route_serve
from eventlane.session import staged
from eventlane.sources.specs import BUILT_IN, SourceSpec, source_topic
from eventlane.sources.writers import to_records
from eventlane.streaming import keyed


@dataclass(frozen=True)
class ServeConfig:
    secrets: Mapping[str, str] = field(default_factory=dict, repr=False)
    enabled_sources: tuple[str, ...] = ("github", "linear")
    specs: tuple[SourceSpec, ...] = tuple(BUILT_IN.values())
    max_payload_bytes: int = 1_048_576
    source_limit: int = 500
    source_bucket_seconds: int = 60
    ip_limit_per_minute: int | None = 100
    trust_proxy_headers: bool = False
    trusted_cidrs: tuple[str, ...] = ()
    dedup_ttl_seconds: int = 604_800
    cooldown_seconds: int = 30
    adapter_id: str | None = None
    plugins: tuple[Plugin, ...] = ()
    routes: tuple[ServeRoute, ...] = ()
    source_topics: tuple[str, ...] = ()
    topic_prefix: str = "webhooks"

    def __post_init__(self) -> None:
        without = {s.strip().lower() for s in self.enabled_sources} - {s.name for s in self.specs}
        if without:
            raise ValueError(f"enabled sources without a spec: {sorted(without)}")
        if not self.enabled_sources:
            raise ValueError("no source is enabled")


def examine(requests: DataFrame, config: ServeConfig, checked: bool = True) -> DataFrame:
    """Requests with parsed payload, keys, route and the three stateless verdicts.

    ``early`` holds the size and source gates, ``middle`` authentication to
    keys, ``late`` object check to route. ``checked=False`` is the pre-validated
    path: no signature and no keys.
    """
    spark = requests.sparkSession
    specs = [s for s in config.specs if s.name in {n.strip().lower() for n in config.enabled_sources}]
    df = requests.withColumn("source", normalize_source("source"))
    if "received_epoch" not in df.columns:
        df = df.withColumn("received_epoch", F.unix_seconds("received_at"))
    early = F.coalesce(
        gates.failed_when(F.octet_length("body") > config.max_payload_bytes, 413, "payload too large"),
        gates.source_enabled_failure(F.col("source"), config.enabled_sources, config.specs),
    )
    df = gates.with_payload(df.withColumn("early", early))
    df = gates.with_secrets(df, secrets_table(spark, config.secrets))
    df = gates.with_keys(df, specs)
    view = gates.request_view()
    middle = F.coalesce(
        *gates.auth_failures(view, specs),
        gates.failed_when(F.col("payload").isNull(), 400, "invalid json payload"),
        *gates.payload_failures(view, specs),
        *gates.key_failures(specs),
    )
    df = computed_once(df, middle=F.when(F.col("early").isNull(), middle))
    return _with_route(df, config).drop("secret_source", "secret_ipad", "secret_opad", "secret_token")


def _with_route(df: DataFrame, config: ServeConfig) -> DataFrame:
    plugged = run_plugins(config.plugins, F.col("event_type"), F.col("payload"))
    missing = F.concat(F.lit("payload missing required field '"), plugged.missing_pointer, F.lit("'"))
    df = computed_once(df, event_type=plugged.event_type, flags=plugged.flags, _missing=missing)
    df = route_serve(df, config.routes, source_topic(F.col("source"), config.source_topics, config.topic_prefix))
    unrouted = F.col("route_key").isNull() if config.routes else F.lit(False)
    late = F.coalesce(
        gates.failed_when(~is_object_text("body_text"), 400, "invalid payload"),
        gates.failed_when(F.col("_missing").isNotNull(), 400, F.col("_missing")),
        gates.failed_when(unrouted, 400, "no matching serve route"),
    )
    return df.withColumn("late", late).drop("_missing")


NARROW = ("seq", "received_epoch", "source", "event_type", "dedup_key", "cooldown_key", "route_key", "topic", "early", "middle", "late")
JUDGED = tuple(c for c in NARROW if c not in ("early", "middle"))


def decide(requests: DataFrame, config: ServeConfig) -> DataFrame:
    """One narrow row per request with (status, http_code, reason) and its keys."""
    df = examine(requests, config)
    extra = []
    if config.ip_limit_per_minute is not None:
        client = resolve_client_ip("peer_ip", "headers", config.trust_proxy_headers, config.trusted_cidrs)
        df = df.withColumn("client_ip", client).withColumn("received_ms", F.unix_millis("received_at"))
        extra = ["client_ip", "received_ms"]
    narrow = staged(df.select(*NARROW, *extra), "requests")
    blocked = F.col("early")
    if config.ip_limit_per_minute is not None:
        narrow = folds.rate_limit_ip(narrow, config.ip_limit_per_minute)
        blocked = F.coalesce(
            gates.failed_when(~F.col("within_ip_limit"), 429, "client rate limit exceeded"), blocked
        )
    narrow = narrow.withColumn("blocked", blocked)
    # Requests stopped this early are not counted by the source limiter.
    narrow = narrow.withColumn("counted_source", F.when(F.col("blocked").isNull(), F.col("source")))
    narrow = rate_limited(narrow, config)
    blocked = F.coalesce(
        F.col("blocked"),
        gates.failed_when(~F.col("within_limit"), 429, "source rate limit exceeded"),
        F.col("middle"),
    )
    # Three steps read what the limits left, which costs several passes to find.
    limited = staged(narrow.select(*JUDGED, blocked.alias("blocked")), "limited")
    open_, shut = limited.filter(F.col("blocked").isNull()), limited.filter(F.col("blocked").isNotNull())
    decisions = folds.idempotency_decisions(open_, config.dedup_ttl_seconds, config.cooldown_seconds).select(
        F.col("seq").alias("decided_seq"), "decision"
    )
    # Only requests that the folds saw have a decision to look up.
    judged = open_.join(decisions, F.col("seq") == F.col("decided_seq"), "left")
    decision = F.coalesce(F.col("decision"), F.lit(folds.DUPLICATE))
    ignored = F.when(decision != folds.ACCEPT, decision)
    final = F.when(ignored.isNull(), F.col("late"))
    kept = [c for c in JUDGED if c != "late"]
    refused = shut.select(*kept, F.lit("rejected").alias("status"), "blocked.http_code", "blocked.reason")
    return judged.select(
        *kept,
        F.when(ignored.isNotNull(), "ignored").when(final.isNotNull(), "rejected").otherwise("accepted").alias("status"),
        F.coalesce(final["http_code"], F.lit(200)).alias("http_code"),
        F.coalesce(ignored, final["reason"]).alias("reason"),
    ).unionByName(refused)


def decide_stream(requests: DataFrame, config: ServeConfig, at: str = "received_at", delay: str = "10 minutes", order: str = "arrival") -> DataFrame:
    """``decide`` for a stream: one query in which the keyed operators follow each other, no table in between.

    Every request passes through each operator, so that each stands once in the
    plan; it meets a limit or a fold only where ``decide`` has it meet one, and
    carries its narrow row along as one string. In event order the first keyed
    operator waits for the watermark, and the rest take its order over. A row
    that comes after the state that would judge it is gone is ignored as ``late``.
    """
    df = examine(requests.withWatermark(at, delay), config)
    columns = [c for c in NARROW if c != "seq"]
    if config.ip_limit_per_minute is not None:
        client = resolve_client_ip("peer_ip", "headers", config.trust_proxy_headers, config.trusted_cidrs)
        df = df.withColumn("client_ip", client).withColumn("received_ms", F.unix_millis("received_at"))
        columns += ["client_ip", "received_ms"]
    # ``blocked`` stops a request for good, ``ignored`` is what a fold said.
    fields = df.select(*columns).schema.add("blocked", df.schema["early"].dataType).add("ignored", "string")
    df = df.withColumns({"blocked": F.col("early"), "ignored": F.lit(None).cast("string")}).select("seq", F.unix_micros(at).alias("at_us"), *fields.names)
    waits = order == "event"

    def through(rows: DataFrame, rule: keyed.Rule, key: Column, time: str, refused: str) -> DataFrame:
        """The rows behind one operator, with its ``decision``."""
        nonlocal waits
        carried = F.to_json(F.struct(*fields.names), {"ignoreNullFields": "false"})
        found = keyed.judged(rows, rule, key, F.col(time), F.timestamp_micros("at_us"), refused, carried, delay, "event" if waits else "arrival")
        waits = False
        return found.select("seq", "at_us", "decision", F.from_json("carried", fields).alias("row")).select("seq", "at_us", "decision", "row.*")

    refused = F.col("decision") == "limited"
    late = F.when(F.col("decision") == keyed.LATE, F.lit(keyed.LATE))
    if config.ip_limit_per_minute is not None:
        df = through(df, keyed.TokenRule(config.ip_limit_per_minute), F.col("client_ip"), "received_ms", "limited")
        df = df.withColumns({"blocked": F.coalesce(gates.failed_when(refused, 429, "client rate limit exceeded"), F.col("early")), "ignored": late})
    open_ = F.col("blocked").isNull() & F.col("ignored").isNull()
    limited = F.lit(config.source_limit == 0)
    if config.source_limit:
        key = F.when(open_, keyed.bucket_key(F.col("source"), F.col("received_epoch"), config.source_bucket_seconds))
        df = through(df, keyed.CountRule(config.source_limit, config.source_bucket_seconds), key, "received_epoch", "limited")
        df, limited = df.withColumn("ignored", F.coalesce("ignored", late)), refused
    over = gates.failed_when(limited, 429, "source rate limit exceeded")
    df = df.withColumn("blocked", F.coalesce(F.col("blocked"), over, F.col("middle")))
    # Without a dedup key a request that nothing stopped counts as a duplicate.
    df = through(df, keyed.TtlRule(config.dedup_ttl_seconds), F.when(open_, F.col("dedup_key")), "received_epoch", folds.DUPLICATE)
    blank = F.when(open_ & (F.coalesce("dedup_key", F.lit("")) == ""), folds.DUPLICATE)
    df = df.withColumn("ignored", F.coalesce("ignored", blank, F.when(F.col("decision") != folds.ACCEPT, F.col("decision"))))
    df = through(df, keyed.TtlRule(config.cooldown_seconds), F.when(open_, F.col("cooldown_key")), "received_epoch", folds.COOLDOWN)
    ignored = F.coalesce("ignored", F.when(F.col("decision") != folds.ACCEPT, F.col("decision")))
    final = F.coalesce(F.col("blocked"), F.when(ignored.isNull(), F.col("late")))
    return df.select(
        "seq", "received_epoch", "source", "event_type", "dedup_key", "cooldown_key", "route_key", "topic",
        F.when(ignored.isNotNull(), "ignored").when(final.isNotNull(), "rejected").otherwise("accepted").alias("status"),
        F.coalesce(final["http_code"], F.lit(200)).alias("http_code"),
        F.coalesce(ignored, final["reason"]).alias("reason"),
    )


def rate_limited(narrow: DataFrame, config: ServeConfig) -> DataFrame:
    if config.source_limit == 0:
        return narrow.withColumn("within_limit", F.lit(False))
    cutoffs = folds.bucket_cutoffs(
        narrow.filter(F.col("counted_source").isNotNull()).select(
            F.col("counted_source").alias("cut_source"),
            F.call_function("div", F.col("received_epoch"), F.lit(config.source_bucket_seconds)).alias("cut_bucket"),
            F.col("received_epoch").alias("at"),
            "seq",
        ),
        config.source_limit,
    )
    bucket = F.call_function("div", F.col("received_epoch"), F.lit(config.source_bucket_seconds))
    order = F.struct(F.col("received_epoch").alias("at"), F.col("seq").alias("seq"))
    return (
        narrow.join(cutoffs, (F.col("counted_source") == F.col("cut_source")) & (bucket == F.col("cut_bucket")), "left")
        .withColumn("within_limit", F.col("cutoff").isNull() | (order <= F.col("cutoff")))
        .drop("cut_source", "cut_bucket", "cutoff", "counted_source")
    )


def envelopes(requests: DataFrame, decisions: DataFrame, config: ServeConfig) -> DataFrame:
    """Accepted requests as (seq, topic, flagged, envelope)."""
    accepted = decisions.filter(F.col("status") == "accepted").select(
        F.col("seq").alias("accepted_seq"), "source", "event_type", "dedup_key", "route_key", "topic", "received_epoch"
    )
    bodies = requests.select("seq", "body")
    df = bodies.join(accepted, F.col("seq") == F.col("accepted_seq")).drop("accepted_seq")
    df = gates.sanitize_payload(df.withColumn("body_text", F.col("body").cast("string")))
    return wrap(df, config)


def wrap(df: DataFrame, config: ServeConfig, always_traced: bool = False) -> DataFrame:
    """Add meta and envelope to rows with source, event_type, payload, route_key and topic."""
    flags = F.array(*(F.lit(p.flag) for p in _unique_flags(config.plugins))).cast("array<string>")
    adapter = F.lit(config.adapter_id).cast("string")
    trace = uuid_text(F.lit("trace"), F.col("source"), F.col("seq").cast("string"))
    traced = F.lit(True) if always_traced else F.col("route_key").isNotNull() | adapter.isNotNull()
    meta = build_meta(F.when(traced, trace), adapter, F.col("route_key"), flags)
    keyed = df if "dedup_key" in df.columns else df.withColumn("dedup_key", F.lit(None).cast("string"))
    return build_envelope(keyed.withColumn("meta", meta)).select("seq", "topic", "flagged", "envelope")


def _unique_flags(plugins: Sequence[Plugin]) -> list:
    seen: dict[str, Plugin] = {}
    for plugin in plugins:
        if hasattr(plugin, "flag"):
            seen.setdefault(plugin.flag, plugin)
    return list(seen.values())


def serve(requests: DataFrame, config: ServeConfig) -> tuple[DataFrame, DataFrame]:
    """(records for the topics, decisions on all requests)."""
    decisions = decide(requests, config)
    routed = envelopes(requests, decisions, config)
    return to_records(routed, F.col("topic")), decisions


def prevalidated(calls: DataFrame, config: ServeConfig) -> DataFrame:
    """Socket, tool and Kafka ingress: (seq, status, reason, topic, flagged, envelope).

    Input rows have ``seq``, ``received_epoch``, ``source``, ``payload`` and an
    optional ``event_type`` override. No signature, limit or dedup applies, so
    this is stateless and runs on streams as it is. An unmatched route falls
    back to the source topic.
    """
    names = {n.strip().lower() for n in config.enabled_sources}
    specs = [s for s in config.specs if s.name in names]
    df = calls.withColumn("source", normalize_source("source"))
    df = df.withColumns(
        {
            "headers": F.create_map().cast("map<string,string>"),
            "body": F.lit(None).cast("binary"),
            "secret_ipad": F.lit(None).cast("binary"),
            "secret_opad": F.lit(None).cast("binary"),
            "secret_token": F.lit(None).cast("string"),
            "override": F.col("event_type"),
        }
    )
    df = gates.with_keys(df, specs).drop("secret_ipad", "secret_opad", "secret_token", "headers", "body")
    df = df.withColumn(
        "event_type", F.when(F.col("override").isNotNull(), blank_to_null("override")).otherwise(F.col("event_type"))
    ).withColumn("body_text", F.to_json("payload"))
    plugged = run_plugins(config.plugins, F.col("event_type"), F.col("payload"))
    failures = F.coalesce(
        F.when(F.col("source").isNull(), F.lit("source cannot be empty")),
        F.when(~F.col("source").isin(*names), F.concat(F.lit("source '"), F.col("source"), F.lit("' is not enabled"))),
        F.when(F.col("override").isNotNull() & F.col("event_type").isNull(), F.lit("event_type override cannot be empty")),
        F.when(F.col("event_type").isNull(), F.lit("derive event_type failed")),
        F.when(~is_object_text("body_text"), F.lit("payload sanitizer rejected request: sanitized payload is not an object")),
        F.when(
            plugged.missing_pointer.isNotNull(),
            F.concat(F.lit("payload missing required field '"), plugged.missing_pointer, F.lit("'")),
        ),
    )
    df = df.withColumns({"reason": failures, "event_type": plugged.event_type}).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )
    df = route_serve(df, config.routes, source_topic(F.col("source"), config.source_topics, config.topic_prefix))
    clean = F.when(F.col("status") == "accepted", F.col("body_text"))
    df = gates.sanitize_payload(df.withColumn("body_text", clean))
    kept = df.withColumn("dedup_key", F.lit(None).cast("string"))
    flags = F.array(*(F.lit(p.flag) for p in _unique_flags(config.plugins))).cast("array<string>")
    trace = uuid_text(F.lit("trace"), F.col("source"), F.col("seq").cast("string"))
    meta = build_meta(trace, F.lit(config.adapter_id).cast("string"), F.col("route_key"), flags)
    built = build_envelope(kept.withColumn("meta", meta))
    ok = F.col("status") == "accepted"
    return built.select(
        "seq", "status", "reason",
        F.when(ok, F.col("topic")).alias("topic"),
        F.when(ok, F.col("flagged")).alias("flagged"),
        F.when(ok, F.col("envelope")).alias("envelope"),
    )
