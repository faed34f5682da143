"""Topic routing of accepted events and fan-out to destinations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.text import wildcard_match
from eventlane.operators.plugins import Plugin, run_plugins

# Above this many routes matching is done once per distinct (topic, type).
INLINE_ROUTES = 100


@dataclass(frozen=True)
class ServeRoute:
    """Source and event-type patterns mapped to a topic; list order decides."""

    id: str
    source_match: str
    event_type_pattern: str
    target_topic: str

    def __post_init__(self) -> None:
        for name in ("id", "source_match", "event_type_pattern", "target_topic"):
            if not getattr(self, name).strip():
                raise ValueError(f"serve route needs a non-empty {name}")


@dataclass(frozen=True)
class Destination:
    adapter_id: str
    required: bool = True

    def __post_init__(self) -> None:
        if not self.adapter_id.strip():
            raise ValueError("destination needs an adapter_id")


@dataclass(frozen=True)
class SmashRoute:
    """Topic pattern and event filters mapped to destinations; all matches fire."""

    id: str
    source_topic_pattern: str
    event_filters: tuple[str, ...] = ()
    destinations: tuple[Destination, ...] = ()

    def __post_init__(self) -> None:
        if not self.id.strip() or not self.source_topic_pattern.strip():
            raise ValueError("smash route needs an id and a topic pattern")

    def ordered(self) -> list[Destination]:
        """Required destinations first, list order kept."""
        return [d for d in self.destinations if d.required] + [d for d in self.destinations if not d.required]


def serve_route_column(
    routes: Sequence[ServeRoute], source: Column, event_type: Column
) -> Column:
    """First matching route as struct (route_key, target_topic), else null.

    One chain of tests: no join and no shuffle.
    """
    chain = [
        F.when(
            wildcard_match(route.source_match, source) & wildcard_match(route.event_type_pattern, event_type),
            F.struct(F.lit(route.id).alias("route_key"), F.lit(route.target_topic).alias("target_topic")),
        )
        for route in routes
    ]
    nothing = F.lit(None).cast("struct<route_key:string,target_topic:string>")
    return F.coalesce(*chain, nothing) if chain else nothing


def route_serve(df: DataFrame, routes: Sequence[ServeRoute], default_topic: Column) -> DataFrame:
    """Add ``route_key`` and ``topic``; without a match the topic is the default."""
    return (
        df.withColumn("_route", serve_route_column(routes, F.col("source"), F.col("event_type")))
        .withColumns(
            {
                "route_key": F.col("_route.route_key"),
                "topic": F.coalesce(F.col("_route.target_topic"), default_topic),
            }
        )
        .drop("_route")
    )


STEP = "array<struct<step:int,route_id:string,adapter_id:string,required:boolean>>"
MATCH = f"array<struct<ordinal:int,route_id:string,destinations:{STEP}>>"


def _route_hit(route: SmashRoute, topic: Column, event_type: Column) -> Column:
    hit = wildcard_match(route.source_topic_pattern, topic)
    if route.event_filters:
        wanted = F.lit(False)
        for pattern in route.event_filters:
            wanted = wanted | wildcard_match(pattern, event_type)
        hit = hit & wanted
    return hit


def _route_struct(ordinal: int, first_step: int, route: SmashRoute) -> Column:
    steps = [
        F.struct(
            F.lit(first_step + i).alias("step"),
            F.lit(route.id).alias("route_id"),
            F.lit(d.adapter_id).alias("adapter_id"),
            F.lit(d.required).alias("required"),
        )
        for i, d in enumerate(route.ordered())
    ]
    destinations = F.array(*steps).cast(STEP) if steps else F.array().cast(STEP)
    return F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(route.id).alias("route_id"), destinations.alias("destinations")
    )


def smash_matches(routes: Sequence[SmashRoute], topic: Column, event_type: Column) -> Column:
    """All matching routes, in order, as an array. Steps number the destinations
    over the whole route list, so their order is the delivery order."""
    if not routes:
        return F.array().cast(MATCH)
    tests, first_step = [], 0
    for ordinal, route in enumerate(routes):
        tests.append(F.when(_route_hit(route, topic, event_type), _route_struct(ordinal, first_step, route)))
        first_step += len(route.destinations)
    return F.filter(F.array(*tests), lambda r: r.isNotNull()).cast(MATCH)


def route_smash(
    df: DataFrame, routes: Sequence[SmashRoute], topic: str = "topic", event_type: str = "event_type"
) -> DataFrame:
    """Add ``matches``: every route whose topic pattern and filters fit.

    Up to ``INLINE_ROUTES`` routes are one expression (no join). For more, on a
    batch table, the expression runs once per distinct (topic, event type) and
    the result is joined back on that pair, still without a theta join.
    """
    column = smash_matches(routes, F.col(topic), F.col(event_type))
    if len(routes) <= INLINE_ROUTES or df.isStreaming:
        return df.withColumn("matches", column)
    pairs = df.select(F.col(topic).alias("_topic"), F.col(event_type).alias("_type")).distinct()
    matched = pairs.withColumn("matches", smash_matches(routes, F.col("_topic"), F.col("_type")))
    return (
        df.join(
            matched,
            F.col(topic).eqNullSafe(F.col("_topic")) & F.col(event_type).eqNullSafe(F.col("_type")),
            "left",
        )
        .drop("_topic", "_type")
    )


def expand_destinations(routed: DataFrame) -> DataFrame:
    """One row per (event, route, destination) in delivery order."""
    steps = F.flatten(F.transform("matches", lambda m: m["destinations"]))
    return (
        routed.withColumn("_step", F.explode(steps))
        .select(*[c for c in routed.columns if c != "matches"], "_step.*")
    )


def apply_destination_plugins(
    deliveries: DataFrame, plugins: Mapping[str, Sequence[Plugin]], known_adapters: Sequence[str] | None = None
) -> DataFrame:
    """Run each destination's plugins on its own copy of the event.

    Needs ``adapter_id``, ``event_type``, ``payload`` and ``meta``. Adds
    ``plugin_error``; a failure belongs to that destination only.
    """
    adapter = F.col("adapter_id")
    event_type, meta, error = F.col("event_type"), F.col("meta"), F.lit(None).cast("string")
    for adapter_id, steps in plugins.items():
        here = adapter == adapter_id
        result = run_plugins(steps, F.col("event_type"), F.col("payload"), F.col("meta.flags"))
        failed = F.concat(
            F.lit(f"smash adapter '{adapter_id}' plugin require_payload_field missing '"),
            result.missing_pointer,
            F.lit("'"),
        )
        event_type = F.when(here, result.event_type).otherwise(event_type)
        if any(hasattr(step, "flag") for step in steps):
            flagged = F.struct(
                F.col("meta.trace_id").alias("trace_id"),
                F.col("meta.ingress_adapter").alias("ingress_adapter"),
                F.col("meta.route_key").alias("route_key"),
                result.flags.alias("flags"),
            )
            meta = F.when(here, flagged).otherwise(meta)
        error = F.when(here, failed).otherwise(error)
    if known_adapters is not None:
        unknown = ~adapter.isin(*known_adapters)
        error = F.coalesce(
            F.when(unknown, F.concat(F.lit("no adapter configured for '"), adapter, F.lit("'"))), error
        )
    return deliveries.withColumns({"event_type": event_type, "meta": meta, "plugin_error": error})


@dataclass(frozen=True)
class NoOutputPolicy:
    """What to do with events that reach no destination."""

    allow: bool = False
    sink: str | None = None

    def __post_init__(self) -> None:
        if self.sink not in (None, "discard", "dlq"):
            raise ValueError("no_output sink must be 'discard' or 'dlq'")


def no_output(routed: DataFrame, policy: NoOutputPolicy, topic: str = "topic", event_type: str = "event_type") -> DataFrame:
    """Events without any destination, with ``reason`` and ``outcome``.

    ``outcome`` is ``commit`` (discarded), ``dlq`` (dead-lettered, committed)
    or ``error`` (not committed).
    """
    reached = F.size(F.flatten(F.transform("matches", lambda m: m["destinations"])))
    what = F.when(F.size("matches") == 0, F.lit("no matching smash route")).otherwise(
        F.lit("no active smash destinations")
    )
    reason = F.concat(
        what, F.lit(" for topic '"), F.col(topic), F.lit("' and event '"), F.col(event_type), F.lit("'")
    )
    if not policy.allow:
        outcome = "error"
    elif policy.sink == "discard":
        outcome = "commit"
    elif policy.sink == "dlq":
        outcome = "dlq"
    else:
        outcome, reason = "error", F.lit("allow_no_output=true requires no_output_sink, but none configured")
    return (
        routed.filter(reached == 0)
        .withColumns({"reason": reason, "outcome": F.lit(outcome)})
        .drop("matches")
    )
