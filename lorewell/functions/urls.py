"""Addresses: a strict form that every parser reads alike, and private hosts."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOST = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*"
#: scheme, host, port, the rest; nothing that parsers could read differently.
STRICT = rf"(?i)^(https?)://({HOST})(?::(\d{{1,5}}))?((?:[/?#].*)?)$"
#: Fixed names of hosts inside a network, and fixed endings of such names.
INSIDE, BELOW = ("localhost", "lan", "internal", "home.arpa"), (".localhost", ".local", ".lan", ".home.arpa", ".internal")
#: Fixed networks that are not reached from outside: private, shared, local, test and reserved ones; of the later address
#: form all but the global ones and multicast, and what is set apart among the global ones.
NETWORKS = """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/29 192.0.0.170/31 192.0.2.0/24 192.168.0.0/16
198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 ::/3 4000::/2 8000::/2 c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 2001::/23 2001:db8::/32""".split()


def strict_url(url: Column) -> Column:
    """The address with scheme and host in lower case and a plain port, or null where parsers could disagree: white
    space or control characters, a backslash before the query, a user, a host that isn't plain labels or whose last
    label is a number, a port out of range, or a scheme other than http and https."""
    part = lambda n: F.regexp_extract(url, STRICT, n)
    host, port = F.lower(part(2)), part(3)
    number = F.when(port != "", port.cast("int"))
    bad = (
        url.rlike(r"[\x00-\x20\x7f]")
        | F.regexp_extract(url, r"^[^?#]*", 0).contains("\\")
        | (host == "")
        | F.element_at(F.split(host, r"\."), -1).rlike(r"^(?:\d+|0x[0-9a-f]*)$")
        | F.coalesce((number < 1) | (number > 65535), F.lit(False))
    )
    made = F.concat(F.lower(part(1)), F.lit("://"), host, F.when(number.isNotNull(), F.concat(F.lit(":"), number.cast("string"))).otherwise(F.lit("")), part(4))
    return F.when(url.isNotNull() & ~bad, made)


def _spans(version: int) -> list[tuple[int, int]]:
    """First and last number of each network of one form of addresses, in order."""
    own = [n for n in map(ipaddress.ip_network, NETWORKS) if n.version == version]
    return sorted((int(n.network_address), int(n.broadcast_address)) for n in own)


SPANS = {version: _spans(version) for version in (4, 6)}
#: One to four numbers between dots: decimal, octal after a zero, or hexadecimal.
NUMERIC = re.compile(r"(?:0x[0-9a-f]*|\d+)(?:\.(?:0x[0-9a-f]*|\d+)){0,3}", re.I)


def numeric(host: str) -> tuple[int, int] | None:
    """(form, number) of a host that is an address, in any way that browsers read it: the last of fewer than four numbers fills
    the bytes that are left."""
    if ":" in host:
        try:
            at = ipaddress.IPv6Address(host.strip("[]"))
        except ValueError:
            return None
        return (6, int(at)) if at.ipv4_mapped is None else (4, int(at.ipv4_mapped))
    if not NUMERIC.fullmatch(host):
        return None
    base = lambda x: (x[2:] or "0", 16) if x[:2].lower() == "0x" else (x, 8) if x[0] == "0" else (x, 10)
    try:
        *front, last = (int(*base(x)) for x in host.split("."))
    except ValueError:
        return None
    if max(front, default=0) > 255 or last >> 8 * (4 - len(front)):
        return None
    return 4, int.from_bytes(bytes(front), "big") << 8 * (4 - len(front)) | last


def private(host: str | None) -> bool:
    """Whether a host is inside a network, by its name or by its number's place among NETWORKS."""
    name = (host or "").lower().rstrip(".")
    if name in INSIDE or name.endswith(BELOW):
        return True
    if (at := numeric(name)) is None:
        return False
    spans = SPANS[at[0]]
    k = bisect_right(spans, (at[1], 1 << 129)) - 1
    return any(low <= at[1] <= high for low, high in spans[max(0, k - 2) : k + 1])


@F.pandas_udf(T.BooleanType())
def private_host(hosts: pd.Series) -> pd.Series:
    """Whether a host is inside a network: by name, or by its address in decimal, hexadecimal or octal form."""
    return hosts.map(private).astype(bool)


def any_prefix(url: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(url, p)) if prefixes else F.lit(False)
