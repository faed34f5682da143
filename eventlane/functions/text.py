"""Text helpers with the exact trimming, matching and truncation rules of the wire format."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space spelled out, so that no slow (?U) flag is needed.
UNICODE_SPACE = r"[\s\x{85}\p{Z}]"
SPACE_CHARS = "".join(
    chr(c)
    for c in (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ws_trim(value: Column | str) -> Column:
    """Strip Unicode white space at both ends (``trim`` strips spaces only)."""
    return F.trim(_col(value), F.lit(SPACE_CHARS))


def ascii_lower(value: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(_col(value), _UPPER, _LOWER)


def lower_without_spaces(value: Column | str) -> Column:
    """Lower-case A-Z and drop all Unicode white space, in one pass."""
    return F.translate(_col(value), _UPPER + SPACE_CHARS, _LOWER)


def ascii_upper(value: Column | str) -> Column:
    return F.translate(_col(value), _LOWER, _UPPER)


def _unless_empty(value: Column) -> Column:
    """``nullif(value, '')`` that names the value once: columns are written out at each use."""
    return F.get(F.array_remove(F.array(value), F.lit("")), F.lit(0))


def blank_to_null(value: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    return _unless_empty(ws_trim(value))


def normalize_source(value: Column | str) -> Column:
    """Trimmed, ASCII-lower-cased source name; null when blank."""
    return _unless_empty(ascii_lower(ws_trim(value)))


def header_value(headers: Column | str, name: str) -> Column:
    """Trimmed value of a header, null when absent or blank.

    Landed header names are already lower-cased.
    """
    return blank_to_null(F.element_at(_col(headers), F.lit(name.lower())))


def _like_escape(literal: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", literal)


def wildcard_match(pattern: str, value: Column | str) -> Column:
    """Whole-string, case-sensitive match where ``*`` is any run of characters.

    Constant patterns become ``=`` or ``LIKE``, which Catalyst further reduces
    to prefix, suffix or substring tests and can push into the scan.
    """
    pattern = pattern.strip()
    subject = _col(value)
    if not pattern:
        return F.lit(False)
    if set(pattern) == {"*"}:
        return subject.isNotNull()
    if "*" not in pattern:
        return subject == F.lit(pattern)
    collapsed = re.sub(r"\*+", "*", pattern)
    return subject.like("%".join(_like_escape(part) for part in collapsed.split("*")))


def wildcard_match_column(pattern: Column | str, value: Column | str) -> Column:
    """Same rule with the pattern in a column.

    ``*`` maps to ``%`` and LIKE's own special characters are escaped, so no
    regular expression is assembled per row.
    """
    trimmed = ws_trim(pattern)
    escaped = F.replace(F.replace(F.replace(trimmed, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))
    return (trimmed != "") & F.like(_col(value), F.replace(escaped, F.lit("*"), F.lit("%")))


def truncate_chars(value: Column | str, limit: int) -> Column:
    """At most ``limit`` code points, the last three being ``...`` when cut."""
    subject = _col(value)
    keep = max(limit - 3, 0)
    return F.when(
        F.length(subject) > limit, F.concat(F.substring(subject, 1, keep), F.lit("..."))
    ).otherwise(subject)


def truncate_bytes(value: Column | str, limit: int = 4000) -> Column:
    """At most ``limit`` UTF-8 bytes without splitting a character, ``...`` when cut."""
    if limit < 3:
        raise ValueError("limit must be at least 3 bytes")
    subject = _col(value)
    raw = subject.cast("binary")
    # A UTF-8 character has at most four bytes, so at most three steps back
    # reach the end of the previous whole character.
    prefixes = [
        F.try_validate_utf8(F.substring(raw, 1, size).cast("string"))
        for size in range(limit - 3, max(limit - 7, -1), -1)
    ]
    return F.when(
        F.octet_length(subject) > limit, F.concat(F.coalesce(*prefixes, F.lit("")), F.lit("..."))
    ).otherwise(subject)


def backoff(attempt_index: Column | str, base: int, maximum: int) -> Column:
    """``min(base * 2^min(i, 31), maximum)``, saturating instead of overflowing."""
    exponent = F.least(_col(attempt_index).cast("int"), F.lit(31))
    scaled = F.try_multiply(F.lit(base).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent))
    return F.least(F.coalesce(scaled, F.lit(maximum).cast("bigint")), F.lit(maximum).cast("bigint"))


# The words that mark a name as sensitive.
SENSITIVE_WORDS = ("SECRET", "TOKEN", "PASSWORD", "PRIVATE_KEY", "SASL")

# Java's \b looks at ASCII word characters only here; these spell out the
# Unicode word boundary.
WORD_CHAR = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}]"
_NOT_SPACE = r"[^\s\x{85}\p{Z}]"
_KELVIN_S = {"s": "[sſ]", "k": "[kK]"}


def fold_letters(pattern: str) -> str:
    """Add the two non-ASCII letters that fold to an ASCII letter (s and k).

    With this, the ASCII-only ``(?i)`` flag gives simple Unicode case folding
    and none of Java's extra Turkish i matches.
    """

    def expand(match: re.Match) -> str:
        return _KELVIN_S.get(match.group(0).lower(), match.group(0))

    return re.sub(r"\\.|[sSkK]", expand, pattern)


def folded_lower(value: Column | str) -> Column:
    """Lower case in which every letter folding to an ASCII letter is that letter.

    Used for cheap substring tests that must never miss a case-insensitive hit.
    """
    return F.translate(F.lower(_col(value)), "ſ", "s")


# The three redaction rules, with the non-ASCII letters that fold to s and k.
REDACT_ASSIGNMENT = (
    rf"(?i)(?<!{WORD_CHAR})([A-Z0-9_ſK]*(?:[sſ]ECRET|TO[kK]EN|PA[sſ][sſ]WORD|PRIVATE_[kK]EY|[sſ]A[sſ]L)[A-Z0-9_ſK]*)=({_NOT_SPACE}+)"
)
REDACT_BEARER = rf"(?i)(authorization{UNICODE_SPACE}*:{UNICODE_SPACE}*bearer{UNICODE_SPACE}+)({_NOT_SPACE}+)"
REDACT_PEM = r"(?s)-----BEGIN [A-Z ]+PRIVATE KEY-----.*?-----END [A-Z ]+PRIVATE KEY-----"


def redact_text(value: Column | str) -> Column:
    """Mask secrets in a whole text: assignments, bearer headers, PEM key blocks.

    Each rule runs only where a plain substring it needs is present, which
    keeps the regular expressions off the bulk of the text.
    """
    subject = _col(value)
    folded = folded_lower(subject)
    named = F.lit(False)
    for word in SENSITIVE_WORDS:
        named = named | F.contains(folded, F.lit(word.lower()))
    masked = F.when(
        F.contains(subject, F.lit("=")) & named,
        F.regexp_replace(subject, REDACT_ASSIGNMENT, "$1=[REDACTED]"),
    ).otherwise(subject)
    masked = F.when(
        F.contains(F.lower(masked), F.lit("bearer")),
        F.regexp_replace(masked, REDACT_BEARER, "$1[REDACTED]"),
    ).otherwise(masked)
    return F.when(
        F.contains(masked, F.lit("PRIVATE KEY-----")),
        F.regexp_replace(masked, REDACT_PEM, "[REDACTED_PRIVATE_KEY]"),
    ).otherwise(masked)


def redact_map(value: Column | str) -> Column:
    """Mask the values of map keys whose upper-cased name holds a sensitive word."""

    def mask(key: Column, val: Column) -> Column:
        name = ascii_upper(key)
        hit = F.lit(False)
        for word in SENSITIVE_WORDS:
            hit = hit | F.contains(name, F.lit(word))
        return F.when(hit, F.lit("[REDACTED]")).otherwise(val)

    return F.transform_values(_col(value), mask)


def safe_key(value: Column | str) -> Column:
    """Runs of characters outside ``A-Za-z0-9._-`` become one underscore."""
    return F.regexp_replace(_col(value), r"[^A-Za-z0-9._-]+", "_")


def safe_file_name(value: Column | str) -> Column:
    """Each character outside ``A-Za-z0-9_-`` becomes an underscore."""
    return F.regexp_replace(_col(value), r"[^A-Za-z0-9_-]", "_")


def parse_kmsg(value: Column | str) -> Column:
    """Kernel log record ``pri,seq,ts,flags;message`` rendered as one text line."""
    record = _col(value)
    head = F.substring_index(record, ";", 1)
    message = F.substr(record, F.length(head) + F.lit(2))
    parts = F.split(head, ",", 4)
    # Python int() allows surrounding space, a sign and single underscores.
    digits = ws_trim(parts[0])
    number = F.when(
        F.regexp_like(digits, F.lit(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z")),
        F.replace(digits, F.lit("_"), F.lit("")),
    )
    # The low three bits only need the last digits of the decimal text.
    tail = F.right(F.regexp_replace(number, r"^[+-]", ""), F.lit(3)).cast("int") % F.lit(8)
    low_bits = F.when(F.startswith(number, F.lit("-")), (F.lit(8) - tail) % F.lit(8)).otherwise(tail)
    level = F.coalesce(low_bits, F.lit(-1)).cast("string")
    rendered = F.concat(
        F.lit("seq="), parts[1], F.lit(" level="), level, F.lit(" ktime_us="), parts[2],
        F.lit(" flags="), parts[3], F.lit(" msg="), message,
    )
    ok = F.contains(record, F.lit(";")) & (F.size(parts) == 4)
    return F.when(ok, rendered).otherwise(F.concat(F.lit("raw="), record))


def hour_minute(seconds: Column | str) -> Column:
    """Seconds rendered as ``<h>h <m>m``."""
    total = _col(seconds)
    return F.concat(
        F.floor(total / 3600).cast("string"),
        F.lit("h "),
        F.floor((total % 3600) / 60).cast("string"),
        F.lit("m"),
    )
