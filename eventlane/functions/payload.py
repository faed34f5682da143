"""Reading parts of JSON payloads held as VARIANT."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.functions.text import blank_to_null, ws_trim

_I64_MAX = 9223372036854775807
_U64_MAX = 18446744073709551615


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    Columns are written out at each use, and generators and lambdas evaluate
    each copy anew; the variable of a lambda is evaluated once.
    """
    return F.transform(F.array(value), use)[0]


def body_text(body: Column | str) -> Column:
    """Body bytes as text, null when they are not valid UTF-8."""
    return F.try_validate_utf8(_col(body).cast("string"))


def parse_json(text: Column | str) -> Column:
    """VARIANT of a whole JSON document, null when it is not one.

    ``try_parse_json`` stops after the first value and so accepts trailing
    text. The document is therefore parsed once as a field in front of an end
    marker: trailing text either breaks the parse or hides the marker.
    """
    plain = "~end~"

    def parsed(body: Column) -> Column:
        # A body that holds the marker itself gets one it cannot contain.
        marker = F.when(F.contains(body, F.lit(plain)), F.sha2(body, 256)).otherwise(F.lit(plain))
        wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit(',"m":"'), marker, F.lit('"}')))
        parts = F.try_variant_get(wrapped, "$", "struct<v:variant,m:variant>")
        # Neither marker needs an escape. As JSON a value is far cheaper to get than by a cast.
        return bound(parts, lambda doc: F.when(F.to_json(doc["m"]) == F.concat(F.lit('"'), marker, F.lit('"')), doc["v"]))

    return bound(_col(text), parsed)


def is_object_text(text: Column | str) -> Column:
    """Whether valid JSON text is an object (cheaper than typing the VARIANT)."""
    return F.startswith(F.ltrim(_col(text), F.lit(" \t\n\r")), F.lit("{"))


def json_path(segments: tuple[str, ...] | list[str]) -> str:
    """VARIANT path for object keys; odd names are quoted."""
    out = "$"
    for segment in segments:
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", segment):
            out += f".{segment}"
        elif "'" not in segment:
            out += f"['{segment}']"
        else:
            out += f'["{segment}"]'
    return out


def at(payload: Column | str, *segments: str) -> Column:
    """Sub-value at object keys, as VARIANT; null when missing."""
    return F.try_variant_get(_col(payload), json_path(segments), "variant")


def value_type(value: Column) -> Column:
    """SQL type name of a VARIANT value: STRING, BIGINT, VOID for JSON null, ..."""
    return F.schema_of_variant(value)


def string_of(value: Column) -> Column:
    """Text of a JSON string value, null for any other kind."""
    return F.when(value_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


def strings_at(payload: Column | str, paths: Sequence[tuple[str, ...]]) -> Column:
    """Array of the string values at several paths, null where not a string."""
    return F.transform(tokens_at(payload, paths), string_of)


def string_at(payload: Column | str, *segments: str) -> Column:
    return strings_at(payload, [segments])[0]


def _typed(value: Column) -> Column:
    kind = value_type(value).alias("kind")
    return F.when(value.isNotNull(), F.struct(kind, value.alias("value"), F.to_json(value).alias("json")))


def _string_text(typed: Column) -> Column:
    """Text of a typed string: without escapes it is what the quotes of its JSON enclose.

    A cast of a VARIANT to text builds an expression for every value.
    """
    json = typed["json"]
    inner = F.substr(json, F.lit(2), F.length(json) - 2)
    return F.when(F.contains(json, F.lit("\\")), F.try_variant_get(typed["value"], "$", "string")).otherwise(inner)


def _token(typed: Column) -> Column:
    """(text, is_string) of a typed value, null without one; the text is null unless it is a token.

    A token is a non-blank string, trimmed, or an integer of 64 bits, signed
    or unsigned, as decimal text. ``1.0`` is typed as a decimal of scale 0
    too, so decimals count only above the signed range.
    """
    kind, json = typed["kind"], typed["json"]
    number = F.try_variant_get(typed["value"], "$", "decimal(20,0)")
    token = (
        F.when(kind == "STRING", blank_to_null(_string_text(typed)))
        .when(kind == "BIGINT", json)
        .when(
            kind.like("DECIMAL(%,0)")
            & (number > F.lit(_I64_MAX).cast("decimal(20,0)"))
            & (number <= F.lit(str(_U64_MAX)).cast("decimal(20,0)")),
            number.cast("string"),
        )
    )
    return F.when(kind.isNotNull(), F.struct(token.alias("text"), (kind == "STRING").alias("is_string")))


def tokens_at(payload: Column | str, paths: Sequence[tuple[str, ...]]) -> Column:
    """Values at several paths as VARIANTs, for one pass of :func:`as_tokens`.

    All paths are read in one walk over the document, unless their names cannot
    stand in one struct.
    """
    fields = _as_fields(paths)
    if len(paths) < 2 or fields is None:
        return F.array(*(at(payload, *path) for path in paths))

    def values(doc: Column) -> Column:
        return F.array(*(reduce(lambda part, name: part.getField(name), path, doc) for path in paths))

    # Also where the payload is no object the array holds a null for each path.
    return bound(F.try_variant_get(_col(payload), "$", fields), values)


def _as_fields(paths: Sequence[tuple[str, ...]]) -> str | None:
    """The paths as the type of one struct with a VARIANT at each end, null where they do not fit in one."""
    heads: dict[str, list[tuple[str, ...]]] = {}
    for path in paths:
        if not path or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", path[0]):
            return None
        heads.setdefault(path[0], []).append(path[1:])
    # Columns are found whatever their case, and a value cannot be a whole and its parts at once.
    if len({name.lower() for name in heads}) < len(heads) or any(() in tails and set(tails) != {()} for tails in heads.values()):
        return None
    types = {name: "variant" if () in tails else _as_fields(tails) for name, tails in heads.items()}
    if None in types.values():
        return None
    return f"struct<{','.join(f'`{name}`:{kind}' for name, kind in types.items())}>"


def as_tokens(values: Column) -> Column:
    """(text, is_string) tokens of an array of values.

    The lambdas state the rule once, which keeps the generated code small
    whatever the number of paths, and type each value once.
    """
    return F.transform(F.transform(values, _typed), _token)


def payload_token(payload: Column | str, *segments: str) -> Column:
    """Token text at one path."""
    return as_tokens(tokens_at(payload, [segments]))[0]["text"]


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator.

    Catalyst copies the definition of a plain column into every filter and
    projection above it; a JSON parse would then run once per use. It does not
    do so across a generator, so each column here is computed once per row.
    A generator's own expressions are not compiled: it is given a finished struct.
    """
    names = set(columns)
    kept = [c for c in df.columns if c not in names]
    held = df.select(*kept, F.struct(*(c.alias(n) for n, c in columns.items())).alias("_once"))
    return held.select(*kept, F.inline(F.array("_once")))


def pointer_segments(pointer: str) -> list[str]:
    """Unescaped reference tokens of an RFC 6901 pointer."""
    if not pointer.startswith("/"):
        raise ValueError("a JSON pointer must start with '/'")
    return [part.replace("~1", "/").replace("~0", "~") for part in pointer[1:].split("/")]


def pointer_exists(payload: Column | str, pointer: str) -> Column:
    """Whether the pointer resolves; a JSON null at the end counts as present.

    A numeric token is an index in an array and a key in an object.
    """
    readings = ["$"]
    for segment in pointer_segments(pointer):
        step = [json_path([segment])[1:]]
        if re.fullmatch(r"0|[1-9][0-9]{0,8}", segment):
            step.append(f"[{segment}]")
        readings = [path + one for path in readings for one in step]
    if len(readings) > 64:
        raise ValueError("too many numeric tokens in the pointer")
    found = F.lit(False)
    for path in readings:
        found = found | F.try_variant_get(_col(payload), path, "variant").isNotNull()
    return found


def integer_of(value: Column) -> Column:
    kind = value_type(value)
    text = F.try_variant_get(value, "$", "string")
    exact = (kind == "STRING") & F.regexp_like(text, F.lit(r"\A[+-]?[0-9]+\z"))
    return F.when(kind == "BIGINT", F.to_json(value).try_cast("bigint")).when(exact, text.try_cast("bigint"))


def integer_at(payload: Column | str, *segments: str) -> Column:
    """BIGINT from a JSON integer or from a string holding exactly an integer."""
    return F.transform(tokens_at(payload, [segments]), integer_of)[0]


def optional_string(value: Column) -> Column:
    """(text, fits) of an optional string: absent and JSON null fit as null."""
    kind = value_type(value)
    return F.struct(
        string_of(value).alias("text"),
        (value.isNull() | F.coalesce(kind.isin("STRING", "VOID"), F.lit(False))).alias("fits"),
    )
