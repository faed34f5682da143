"""Request authentication as plain column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlane.functions.text import UNICODE_SPACE, ascii_lower, header_value, lower_without_spaces, ws_trim

_BLOCK = 64

SECRETS = T.StructType(
    [
        T.StructField("secret_source", T.StringType(), False),
        T.StructField("secret_ipad", T.BinaryType(), False),
        T.StructField("secret_opad", T.BinaryType(), False),
        T.StructField("secret_token", T.StringType(), False),
    ]
)


def pads(secret: str) -> tuple[bytes, bytes]:
    """The inner and outer HMAC-SHA256 key blocks of a secret."""
    key = secret.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def normalize_text(raw: str) -> str:
    """Driver-side twin of :func:`normalize_signature` for configured tokens."""
    text = raw.strip().removeprefix("sha256=")
    text = re.sub(r"\s+", "", text)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def secrets_table(spark: SparkSession, secrets: Mapping[str, str]) -> DataFrame:
    """One row per source; joined in so that no key shows up in a query plan."""
    rows = [(name, *map(bytearray, pads(value)), normalize_text(value)) for name, value in secrets.items()]
    return spark.createDataFrame(rows, SECRETS)


def hmac_sha256_hex(body: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 in hex from the two key blocks, inside code generation."""
    inner = F.unhex(F.sha2(F.concat(ipad, body), 256))
    return F.sha2(F.concat(opad, inner), 256)


def normalize_signature(value: Column | str) -> Column:
    """Trim, drop one ``sha256=`` prefix, drop all white space, ASCII-lower.

    What trimming would leave out is dropped with all white space; the value is named once.
    """
    return lower_without_spaces(F.regexp_replace(value, rf"\A{UNICODE_SPACE}*sha256=", ""))


def adapter_token_ok(headers: Column | str, auth_mode: str, expected: Column | str | None) -> Column:
    """Adapter authorization: none, bearer or hmac (the last two compare a token).

    A bearer header wins over ``x-adapter-token``; unknown modes refuse.
    ``expected`` is a column, or a token given as text.
    """
    mode = auth_mode.strip().lower()
    if mode == "none":
        return F.lit(True)
    if mode not in ("bearer", "hmac") or expected is None:
        return F.lit(False)
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    authorization = header_value(headers, "authorization")
    prefixed = ascii_lower(F.substring(authorization, 1, 7)) == "bearer "
    bearer = F.nullif(ws_trim(F.substring(authorization, 8, 2147483647)), F.lit(""))
    provided = F.coalesce(F.when(prefixed, bearer), header_value(headers, "x-adapter-token"))
    return F.coalesce(provided == wanted, F.lit(False))
