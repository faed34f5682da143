"""Client addresses behind trusted proxies."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlane.functions.text import ascii_lower, ws_trim

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def is_ipv4(text: Column) -> Column:
    return F.regexp_like(text, F.lit(IPV4))


def ipv4_number(text: Column) -> Column:
    """IPv4 text as a number, null for anything else."""
    octets = F.split(text, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.try_element_at(octets, F.lit(i + 1)).try_cast("bigint")
    return F.when(is_ipv4(text), number)


def _canonical(text: str | None) -> str | None:
    if text is None or "%" in text:
        return None
    try:
        return str(ipaddress.ip_address(text))
    except ValueError:
        return None


@F.arrow_udf(T.StringType())
def _canonical_ipv6(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else _canonical(t) for t in batch.to_pylist()], pa.string())


def canonical_ip(text: Column) -> Column:
    """Address in canonical text, null when unparseable. Only candidates with a
    colon reach Python; IPv4 stays in the JVM."""
    six = _canonical_ipv6(F.when(F.contains(text, F.lit(":")), text))
    return F.when(is_ipv4(text), text).otherwise(six)


def in_cidrs(address: Column, cidrs: Sequence[str]) -> Column:
    """Whether an address is in any of the networks of a configured list."""
    networks = [ipaddress.ip_network(c.strip(), strict=False) for c in cidrs]
    four = [n for n in networks if n.version == 4]
    six = [n for n in networks if n.version == 6]
    number = ipv4_number(address)
    hit = F.lit(False)
    for net in four:
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    hit = F.coalesce(hit, F.lit(False))
    if six:

        @F.arrow_udf(T.BooleanType())
        def six_hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            def inside(text):
                if text is None:
                    return False
                try:
                    ip = ipaddress.ip_address(text)
                except ValueError:
                    return False
                return ip.version == 6 and any(ip in net for net in six)

            for batch in batches:
                yield pa.array([inside(t) for t in batch.to_pylist()], pa.bool_())

        hit = hit | six_hit(F.when(F.contains(address, F.lit(":")), address))
    return hit


def _first_ip(candidates: Column, ipv6: bool) -> Column:
    """First parseable address of an array of texts."""
    if ipv6:
        return _first_parseable(candidates)
    return F.try_element_at(F.filter(candidates, is_ipv4), F.lit(1))


@F.arrow_udf(T.StringType())
def _first_parseable(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for parts in batch.to_pylist():
            out.append(next((ip for ip in map(_canonical, parts or ()) if ip), None))
        yield pa.array(out, pa.string())


def resolve_client_ip(
    peer: Column | str,
    headers: Column | str,
    trust_proxy_headers: bool = False,
    trusted_cidrs: Sequence[str] = (),
    ipv6: bool = True,
) -> Column:
    """Client address of a request.

    The peer counts unless proxy headers are trusted and the peer is in a
    trusted network; then X-Forwarded-For, X-Real-IP and Forwarded are tried.
    ``ipv6=False`` keeps the whole expression inside the JVM.
    """
    peer_col = F.col(peer) if isinstance(peer, str) else peer
    if not trust_proxy_headers or not trusted_cidrs:
        return peer_col
    head = F.col(headers) if isinstance(headers, str) else headers

    def header(name: str) -> Column:
        return F.element_at(head, F.lit(name))

    trusted = in_cidrs(peer_col, trusted_cidrs)
    hops = F.transform(F.split(header("x-forwarded-for"), ","), ws_trim)
    real = F.array(ws_trim(header("x-real-ip")))
    segments = F.filter(
        F.transform(F.split(header("forwarded"), ";"), ws_trim),
        lambda s: F.startswith(ascii_lower(s), F.lit("for=")),
    )
    fors = F.transform(
        segments,
        lambda s: F.substring_index(
            F.regexp_replace(
                F.regexp_replace(ws_trim(F.substring(s, 5, 2147483647)), r'\A"+|"+\z', ""),
                r"\A\[+|\]+\z",
                "",
            ),
            ":",
            1,
        ),
    )
    found = [
        _first_ip(F.when(trusted & c.isNotNull(), c), ipv6) for c in (hops, real)
    ]
    found.append(F.try_element_at(F.filter(fors, is_ipv4), F.lit(1)))
    return F.when(trusted, F.coalesce(*found, peer_col)).otherwise(peer_col)


__all__ = ["canonical_ip", "in_cidrs", "ipv4_number", "resolve_client_ip"]
