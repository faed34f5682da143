"""How each source authenticates, checks and names its deliveries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlane.functions.payload import integer_at
from eventlane.functions.signing import hmac_sha256_hex, normalize_signature
from eventlane.functions.text import ascii_lower, blank_to_null, header_value

UNAUTHORIZED = 401
BAD_REQUEST = 400


@dataclass(frozen=True)
class Failure:
    """A condition that rejects a request, with its code and reason."""

    when: Column
    http_code: int
    reason: str


@dataclass(frozen=True)
class RequestView:
    """The columns a source may look at."""

    headers: Column
    body: Column
    payload: Column
    tokens: Column
    received_epoch: Column
    ipad: Column
    opad: Column
    token: Column


@dataclass(frozen=True)
class SourceSpec:
    """Column builders of one source. All sources merge into one projection."""

    name: str
    auth: Callable[[RequestView], Sequence[Failure]]
    event_type: Callable[[SourceSpec, RequestView], Column]
    missing_event_type: str
    delivery_id: Callable[[RequestView], Column]
    missing_delivery: str
    entity_id: Callable[[SourceSpec, RequestView], Column]
    cooldown_key: Callable[[SourceSpec, RequestView], Column]
    paths: tuple[tuple[str, ...], ...]
    payload_check: Callable[[RequestView], Sequence[Failure]] = field(default=lambda _view: ())

    def __post_init__(self) -> None:
        if self.name != self.name.strip().lower() or not self.name:
            raise ValueError(f"source name {self.name!r} must be trimmed lower case")

    def token(self, view: RequestView, *paths: tuple[str, ...]) -> Column:
        """First token found at the given paths, which must be listed in ``paths``."""
        return F.coalesce(*(view.tokens[self.paths.index(path)]["text"] for path in paths))

    def string(self, view: RequestView, path: tuple[str, ...]) -> Column:
        """Same for one path, strings only."""
        token = view.tokens[self.paths.index(path)]
        return F.when(token["is_string"], token["text"])

    def dedup_key(self, view: RequestView) -> Column:
        """``source:delivery:action:entity``; null when the delivery id is missing."""
        action = F.coalesce(self.token(view, ("action",)), F.lit("unknown"))
        return F.concat(
            F.lit(f"{self.name}:"), self.delivery_id(view), F.lit(":"), action, F.lit(":"), self.entity_id(self, view)
        )


def _hmac_auth(source: str, header: str) -> Callable[[RequestView], list[Failure]]:
    def build(view: RequestView) -> list[Failure]:
        given = header_value(view.headers, header)
        wanted = hmac_sha256_hex(view.body, view.ipad, view.opad)
        return [
            Failure(view.ipad.isNull(), UNAUTHORIZED, f"missing {source} secret"),
            Failure(given.isNull(), UNAUTHORIZED, f"missing {source} signature"),
            Failure(normalize_signature(F.element_at(view.headers, header)) != wanted, UNAUTHORIZED, f"invalid {source} signature"),
        ]

    return build


def _dotted(head: Column, tail: Column) -> Column:
    """``head.tail``, the head alone without a tail, null without a head. Names each once."""
    return F.concat(head, F.coalesce(F.concat(F.lit("."), tail), F.lit("")))


# --- github -----------------------------------------------------------------

# Payload paths tried in order.
GITHUB_COOLDOWN_ENTITY = (("pull_request", "number"), ("issue", "number"), ("number",))
GITHUB_ENTITY = (*GITHUB_COOLDOWN_ENTITY, ("comment", "id"), ("review", "id"), ("repository", "id"))
LINEAR_COOLDOWN_ENTITY = (("data", "id"), ("data", "identifier"))
LINEAR_ENTITY = (*LINEAR_COOLDOWN_ENTITY, ("webhookId",))
EXAMPLE_COOLDOWN_ENTITY = (("data", "id"), ("id",))
EXAMPLE_ENTITY = (*EXAMPLE_COOLDOWN_ENTITY, ("resource", "id"))
EXAMPLE_SCOPE = (("scope",), ("tenant",), ("project", "id"))


GITHUB_PATHS = (("action",), ("repository", "full_name"), *GITHUB_ENTITY)
LINEAR_PATHS = (("action",), ("type",), ("data", "team", "key"), *LINEAR_ENTITY)
EXAMPLE_PATHS = (("action",), ("event_type",), ("type",), *EXAMPLE_SCOPE, *EXAMPLE_ENTITY)


def _github_event_type(spec: SourceSpec, view: RequestView) -> Column:
    event = header_value(view.headers, "x-github-event")
    return _dotted(event, spec.string(view, ("action",)))


def _github_cooldown(spec: SourceSpec, view: RequestView) -> Column:
    repo = F.replace(spec.token(view, ("repository", "full_name")), F.lit("/"), F.lit("-"))
    return F.concat(F.lit("cooldown-github-"), repo, F.lit("-"), spec.token(view, *GITHUB_COOLDOWN_ENTITY))


GITHUB = SourceSpec(
    name="github",
    paths=GITHUB_PATHS,
    auth=_hmac_auth("github", "x-hub-signature-256"),
    event_type=_github_event_type,
    missing_event_type="missing X-GitHub-Event",
    delivery_id=lambda view: header_value(view.headers, "x-github-delivery"),
    missing_delivery="missing X-GitHub-Delivery",
    entity_id=lambda spec, view: F.coalesce(spec.token(view, *GITHUB_ENTITY), F.lit("unknown")),
    cooldown_key=_github_cooldown,
)


# --- linear -----------------------------------------------------------------

MILLIS_ABOVE = 10_000_000_000


def sent_epoch(payload: Column) -> Column:
    """``webhookTimestamp`` in seconds; large values are milliseconds."""
    raw = integer_at(payload, "webhookTimestamp")
    return F.when(raw > MILLIS_ABOVE, F.call_function("div", raw, F.lit(1000))).otherwise(raw)


def outside_window(payload: Column, received_epoch: Column, window_seconds: int) -> Column:
    """Whether the sender's time is missing or too far from the receipt time."""
    distance = F.abs(received_epoch - sent_epoch(payload))
    return F.coalesce(distance > window_seconds, F.lit(True))


def _linear_event_type(spec: SourceSpec, view: RequestView) -> Column:
    kind = F.coalesce(spec.string(view, ("type",)), header_value(view.headers, "linear-event"))
    action = spec.string(view, ("action",))
    return _dotted(ascii_lower(kind), ascii_lower(action))


def linear_source(window_seconds: int = 60, enforce_window: bool = True) -> SourceSpec:
    def window_check(view: RequestView) -> list[Failure]:
        if not enforce_window:
            return []
        return [
            Failure(
                outside_window(view.payload, view.received_epoch, window_seconds),
                UNAUTHORIZED,
                "linear webhook rejected due to timestamp window check",
            )
        ]

    return SourceSpec(
        name="linear",
        paths=LINEAR_PATHS,
        auth=_hmac_auth("linear", "linear-signature"),
        payload_check=window_check,
        event_type=_linear_event_type,
        missing_event_type="missing linear type",
        delivery_id=lambda view: header_value(view.headers, "linear-delivery"),
        missing_delivery="missing Linear-Delivery",
        entity_id=lambda spec, view: F.coalesce(spec.token(view, *LINEAR_ENTITY), F.lit("unknown")),
        cooldown_key=lambda spec, view: F.concat(
            F.lit("cooldown-linear-"),
            spec.token(view, ("data", "team", "key")),
            F.lit("-"),
            spec.token(view, *LINEAR_COOLDOWN_ENTITY),
        ),
    )


LINEAR = linear_source()


# --- example ----------------------------------------------------------------


def _example_auth(view: RequestView) -> list[Failure]:
    given = header_value(view.headers, "x-example-token")
    return [
        Failure(view.token.isNull(), UNAUTHORIZED, "missing example secret"),
        Failure(given.isNull(), UNAUTHORIZED, "missing example token"),
        Failure(normalize_signature(F.element_at(view.headers, "x-example-token")) != view.token, UNAUTHORIZED, "invalid example token"),
    ]


def _example_event_type(spec: SourceSpec, view: RequestView) -> Column:
    event = F.coalesce(
        header_value(view.headers, "x-example-event"), spec.token(view, ("event_type",), ("type",))
    )
    action = spec.token(view, ("action",))
    return _dotted(ascii_lower(event), ascii_lower(action))


EXAMPLE = SourceSpec(
    name="example",
    paths=EXAMPLE_PATHS,
    auth=_example_auth,
    event_type=_example_event_type,
    missing_event_type="missing example event",
    delivery_id=lambda view: header_value(view.headers, "x-example-delivery"),
    missing_delivery="missing X-Example-Delivery",
    entity_id=lambda spec, view: F.coalesce(spec.token(view, *EXAMPLE_ENTITY), F.lit("unknown")),
    cooldown_key=lambda spec, view: F.concat(
        F.lit("cooldown-example-"),
        spec.token(view, *EXAMPLE_SCOPE),
        F.lit("-"),
        spec.token(view, *EXAMPLE_COOLDOWN_ENTITY),
    ),
)

BUILT_IN: Mapping[str, SourceSpec] = {spec.name: spec for spec in (EXAMPLE, GITHUB, LINEAR)}


def by_source(
    source: Column, specs: Sequence[SourceSpec], build: Callable[[SourceSpec], Column]
) -> Column:
    """One CASE over the source name; null for an unknown source."""
    chain = None
    for spec in specs:
        branch = build(spec)
        chain = F.when(source == spec.name, branch) if chain is None else chain.when(source == spec.name, branch)
    return chain if chain is not None else F.lit(None).cast("string")


def source_topic(source: Column, topics: Sequence[str] = (), prefix: str = "webhooks") -> Column:
    """First configured topic equal to the source or ending in ``.source``, else ``prefix.source``."""
    if not prefix.strip():
        raise ValueError("topic prefix cannot be empty")
    name = ascii_lower(blank_to_null(source))
    matches = []
    for topic in topics:
        lowered = topic.strip().lower()
        matches.append(
            F.when((name == lowered) | F.endswith(F.lit(lowered), F.concat(F.lit("."), name)), F.lit(topic))
        )
    return F.coalesce(*matches, F.concat(F.lit(prefix.strip() + "."), name))
