"""Gates over landed requests.

A gate never drops a row: it fills ``rejection`` (``http_code``, ``reason``)
if no earlier gate did. ``coalesce`` stops at the first failure, so costly
gates (HMAC, JSON) are not evaluated for rows that already failed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.injection import flagged_leaves, sanitized_text
from eventlane.functions.payload import (
    as_tokens,
    body_text,
    computed_once,
    is_object_text,
    parse_json,
    pointer_exists,
    string_at,
    tokens_at,
)
from eventlane.functions.signing import adapter_token_ok
from eventlane.functions.text import normalize_source
from eventlane.sources.specs import RequestView, SourceSpec, by_source, outside_window

REJECTION = "struct<http_code:int,reason:string>"
REJECTION_FIELD = "rejection"


def failure(http_code: int, reason: str | Column) -> Column:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(http_code).alias("http_code"), text.alias("reason"))


def failed_when(condition: Column, http_code: int, reason: str | Column) -> Column:
    return F.when(condition, failure(http_code, reason))


def add_gate(df: DataFrame, *failures: Column) -> DataFrame:
    """Append failures to the rejection column; the first one present wins."""
    before = [F.col(REJECTION_FIELD)] if REJECTION_FIELD in df.columns else []
    return df.withColumn(REJECTION_FIELD, F.coalesce(*before, *failures))


def with_status(df: DataFrame) -> DataFrame:
    """Spell the rejection out as (status, http_code, reason)."""
    return df.withColumns(
        {
            "status": F.when(F.col("rejection").isNull(), F.lit("accepted")).otherwise(F.lit("rejected")),
            "http_code": F.coalesce(F.col("rejection.http_code"), F.lit(200)),
            "reason": F.col("rejection.reason"),
        }
    ).drop("rejection")


def source_enabled_failure(source: Column, enabled: Sequence[str], specs: Sequence[SourceSpec]) -> Column:
    names = {name.strip().lower() for name in enabled} & {spec.name for spec in specs}
    known = F.coalesce(source.isin(*sorted(names)), F.lit(False)) if names else F.lit(False)
    return failed_when(~known, 404, "not found")


def gate_source_enabled(
    df: DataFrame, enabled: Sequence[str], specs: Sequence[SourceSpec], source: str = "source"
) -> DataFrame:
    """404 unless the normalized source is enabled and has a spec."""
    return add_gate(df, source_enabled_failure(normalize_source(source), enabled, specs))


def gate_payload_size(df: DataFrame, max_bytes: int = 1_048_576, body: str | Column = "body") -> DataFrame:
    """413 when the body (or any serialized payload) is larger than ``max_bytes``."""
    size = F.octet_length(F.col(body) if isinstance(body, str) else body)
    return add_gate(df, failed_when(size > max_bytes, 413, "payload too large"))


def gate_adapter_token(
    df: DataFrame, auth_mode: str, expected: Column | str | None, headers: str = "headers"
) -> DataFrame:
    """401 unless the adapter's token rule is met."""
    return add_gate(df, failed_when(~adapter_token_ok(headers, auth_mode, expected), 401, "unauthorized"))


def gate_signature(df: DataFrame, specs: Sequence[SourceSpec], secrets: DataFrame) -> DataFrame:
    """401 unless the request authenticates under its source's rule.

    ``secrets`` (see ``secrets_table``) has one row per configured source.
    """
    joined = with_secrets(df, secrets)
    return add_gate(joined, *auth_failures(request_view(), specs)).drop(*secrets.columns)


gate_shared_token = gate_signature


def gate_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """400 unless the body parsed as a whole JSON document."""
    return add_gate(df, failed_when(F.col(payload).isNull(), 400, "invalid json payload"))


def gate_object(df: DataFrame, text: str = "body_text") -> DataFrame:
    """400 unless the (valid) JSON document is an object."""
    return add_gate(df, failed_when(~is_object_text(text), 400, "invalid payload"))


def gate_timestamp_window(
    df: DataFrame, window_seconds: int = 60, enforce: bool = True, now_epoch: str = "received_epoch"
) -> DataFrame:
    """401 unless the sender's timestamp is within the window of the receipt time."""
    if not enforce:
        return add_gate(df, F.lit(None).cast(REJECTION))
    late = outside_window(F.col("payload"), F.col(now_epoch), window_seconds)
    return add_gate(df, failed_when(late, 401, "linear webhook rejected due to timestamp window check"))


def require_payload_field(df: DataFrame, pointer: str) -> DataFrame:
    """400 unless the payload holds the pointer."""
    missing = ~pointer_exists("payload", pointer)
    return add_gate(df, failed_when(missing, 400, f"payload missing required field '{pointer}'"))


def loop_guard(
    df: DataFrame,
    agent_user_id: str | None = None,
    bot_suffix: str = "[bot]",
    github_actions: Sequence[str] = ("opened", "synchronize", "reopened", "submitted", "created"),
    linear_types: Sequence[str] = ("Issue", "Comment"),
    linear_skip_actions: Sequence[str] = ("remove",),
) -> DataFrame:
    """Keep only events worth an agent's attention, never its own.

    Works on envelopes (``source``, ``payload``); other sources pass unchanged.
    """
    login = string_at("payload", "sender", "login")
    action = string_at("payload", "action")
    github = ~F.coalesce(F.endswith(login, F.lit(bot_suffix)), F.lit(False)) & F.coalesce(
        action.isin(*github_actions), F.lit(False)
    )
    linear = F.coalesce(string_at("payload", "type").isin(*linear_types), F.lit(False)) & ~F.coalesce(
        action.isin(*linear_skip_actions), F.lit(False)
    )
    if agent_user_id is not None:
        own = string_at("payload", "data", "userId") == agent_user_id
        linear = linear & ~F.coalesce(own, F.lit(False))
    keep = F.when(F.col("source") == "github", github).when(F.col("source") == "linear", linear)
    return df.filter(F.coalesce(keep, F.lit(True)))


# --- shared by the whole-pipeline plan ---------------------------------------


def with_secrets(df: DataFrame, secrets: DataFrame) -> DataFrame:
    """Each row with its source's secret. The table has a row a source, so it goes to the requests:
    a shuffle by source would move every body, into as many tasks as there are sources."""
    return df.join(F.broadcast(secrets), F.col("source") == F.col("secret_source"), "left")


def request_view() -> RequestView:
    return RequestView(
        headers=F.col("headers"),
        body=F.col("body"),
        payload=F.col("payload"),
        tokens=F.col("_tokens"),
        received_epoch=F.col("received_epoch"),
        ipad=F.col("secret_ipad"),
        opad=F.col("secret_opad"),
        token=F.col("secret_token"),
    )


def _per_source(specs: Sequence[SourceSpec], builder) -> list[Column]:
    failures = []
    for spec in specs:
        for one in builder(spec):
            here = (F.col("source") == spec.name) & one.when
            failures.append(failed_when(here, one.http_code, one.reason))
    return failures or [F.lit(None).cast(REJECTION)]


def auth_failures(view: RequestView, specs: Sequence[SourceSpec]) -> list[Column]:
    return _per_source(specs, lambda spec: spec.auth(view))


def payload_failures(view: RequestView, specs: Sequence[SourceSpec]) -> list[Column]:
    return _per_source(specs, lambda spec: spec.payload_check(view))


def with_payload(df: DataFrame) -> DataFrame:
    """Add ``body_text`` and ``payload``: each body is decoded and parsed once."""
    text = body_text("body")
    return computed_once(df, body_text=text, payload=parse_json(text))


def with_keys(df: DataFrame, specs: Sequence[SourceSpec]) -> DataFrame:
    """Add ``event_type``, ``dedup_key`` and ``cooldown_key`` of each request.

    Only the paths of the row's own source are read.
    """
    source = F.col("source")
    values = by_source(source, specs, lambda s: tokens_at("payload", s.paths))
    df = computed_once(df, _tokens=as_tokens(values))
    view = request_view()
    keys = computed_once(
        df,
        event_type=by_source(source, specs, lambda s: s.event_type(s, view)),
        dedup_key=by_source(source, specs, lambda s: s.dedup_key(view)),
        cooldown_key=by_source(source, specs, lambda s: s.cooldown_key(s, view)),
    )
    return keys.drop("_tokens")


def key_failures(specs: Sequence[SourceSpec]) -> list[Column]:
    """Missing event type, then missing delivery id, with each source's wording."""
    source = F.col("source")
    return [
        failed_when(
            F.col("event_type").isNull(), 400, by_source(source, specs, lambda s: F.lit(s.missing_event_type))
        ),
        failed_when(
            F.col("dedup_key").isNull(), 400, by_source(source, specs, lambda s: F.lit(s.missing_delivery))
        ),
    ]


def sanitize_payload(df: DataFrame, text: str = "body_text") -> DataFrame:
    """Mark the payload as sanitized and flag leaves with injection phrases.

    Nothing is removed. Adds ``flagged`` and replaces ``payload``.
    """
    flagged = computed_once(df.withColumn("_flagged", flagged_leaves(F.col(text))), flagged=F.col("_flagged")).drop("_flagged")
    spliced = sanitized_text(F.col(text), F.col("flagged"))
    return flagged.withColumn("payload", F.parse_json(spliced))
