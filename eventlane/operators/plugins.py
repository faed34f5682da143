"""Event plugins: alias an event type, require a payload field, add a meta flag."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.payload import pointer_exists, pointer_segments

NO_FLAGS = "array<string>"


@dataclass(frozen=True)
class EventTypeAlias:
    from_type: str
    to_type: str

    def __post_init__(self) -> None:
        if not self.from_type.strip() or not self.to_type.strip():
            raise ValueError("event_type_alias needs non-empty names")


@dataclass(frozen=True)
class RequirePayloadField:
    pointer: str

    def __post_init__(self) -> None:
        if not self.pointer.strip():
            raise ValueError("require_payload_field needs a pointer")
        pointer_segments(self.pointer)


@dataclass(frozen=True)
class AddMetaFlag:
    flag: str

    def __post_init__(self) -> None:
        if not self.flag.strip():
            raise ValueError("add_meta_flag needs a flag")


Plugin = EventTypeAlias | RequirePayloadField | AddMetaFlag
CustomPlugin = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PluginResult:
    event_type: Column
    flags: Column
    missing_pointer: Column


def event_type_alias(event_type: Column, steps: Sequence[EventTypeAlias]) -> Column:
    """Exact rewrites applied in order; a later step sees the earlier result."""
    for step in steps:
        event_type = F.when(event_type == step.from_type, F.lit(step.to_type)).otherwise(event_type)
    return event_type


def add_meta_flag(flags: Column, flag: str) -> Column:
    """Append a flag unless it is there; order is kept."""
    return F.when(F.array_contains(flags, flag), flags).otherwise(F.array_append(flags, F.lit(flag)))


def run_plugins(
    plugins: Sequence[Plugin], event_type: Column, payload: Column, flags: Column | None = None
) -> PluginResult:
    """Fold a plugin list into columns. The first missing pointer is reported."""
    flags = F.array().cast(NO_FLAGS) if flags is None else F.coalesce(flags, F.array().cast(NO_FLAGS))
    missing: list[Column] = []
    for plugin in plugins:
        if isinstance(plugin, EventTypeAlias):
            event_type = event_type_alias(event_type, [plugin])
        elif isinstance(plugin, RequirePayloadField):
            missing.append(F.when(~pointer_exists(payload, plugin.pointer), F.lit(plugin.pointer)))
        else:
            flags = add_meta_flag(flags, plugin.flag)
    return PluginResult(event_type, flags, F.coalesce(*missing) if missing else F.lit(None).cast("string"))


def apply_plugins(df: DataFrame, plugins: Sequence[Plugin | CustomPlugin]) -> DataFrame:
    """Run plugins over ``event_type``, ``payload`` and ``flags`` columns.

    Adds ``plugin_error``. A callable plugin gets and returns the DataFrame.
    """
    out = df if "flags" in df.columns else df.withColumn("flags", F.array().cast(NO_FLAGS))
    out = out.withColumn("plugin_error", F.lit(None).cast("string"))
    for plugin in plugins:
        if isinstance(plugin, (EventTypeAlias, RequirePayloadField, AddMetaFlag)):
            result = run_plugins([plugin], F.col("event_type"), F.col("payload"), F.col("flags"))
            error = F.concat(
                F.lit("payload missing required field '"), result.missing_pointer, F.lit("'")
            )
            # After a failure the rest of the list has no effect.
            live = F.col("plugin_error").isNull()
            out = out.withColumns(
                {
                    "event_type": F.when(live, result.event_type).otherwise(F.col("event_type")),
                    "flags": F.when(live, result.flags).otherwise(F.col("flags")),
                    "plugin_error": F.coalesce(F.col("plugin_error"), error),
                }
            )
        else:
            out = plugin(out)
    return out
