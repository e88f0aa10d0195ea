"""Addresses of links, written as browsers write them (WHATWG URL).

An address is read into scheme, authority, path, query and fragment, each of them
normalised, and put together again. Departures: host names beyond ASCII follow IDNA 2003,
and drive letters of file addresses have no meaning.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Schemes whose addresses have a host, and their default ports.
PORTS = {"ftp": "21", "file": "", "http": "80", "https": "443", "ws": "80", "wss": "443"}
#: Characters that are percent-encoded besides controls and all beyond ASCII, as parts of a character class.
_FRAGMENT = r' "<>`'
_QUERY = r' "#<>'
_SPECIAL_QUERY = _QUERY + "'"
_PATH = _QUERY + r"?^`{}"
_USER = _PATH + r"/:;=@\[\\\]|"
#: Characters that no host may hold.
_NO_HOST = re.compile(r"[\0\t\n\r #/:<>?@\[\\\]^|]")
_NO_DOMAIN = re.compile(r"[\0-\x20#/:<>?@\[\\\]^|%\x7f]")

_ENDS = "".join(map(chr, range(33)))
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*(?=:)")
_PORT = re.compile(r":([0-9]*)\Z")
_NUMBER = re.compile(r"0x[0-9a-f]*|[0-9]+")
_DOT = re.compile(r"(?:\.|%2e)", re.IGNORECASE)


class Address(NamedTuple):
    scheme: str
    authority: str | None
    path: tuple[str, ...] | str  # segments; text where it has no structure
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        path = self.path if isinstance(self.path, str) else "".join("/" + p for p in self.path)
        lead = "/." if self.authority is None and path.startswith("//") else ""
        host = "" if self.authority is None else "//" + self.authority
        tail = "".join(mark + x for mark, x in (("?", self.query), ("#", self.fragment)) if x is not None)
        return f"{self.scheme}:{host}{lead}{path}{tail}"


def _encoded(text: str, also: str = "") -> str:
    return re.sub(rf"[\0-\x1f\x7f-\U0010ffff{also}]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text)


def _ipv4(host: str) -> str | None:
    """A host that ends in a number, as four numbers; ValueError if it isn't one, None for other hosts."""
    parts = host.removesuffix(".").split(".")
    if not _NUMBER.fullmatch(parts[-1]):
        return None
    if len(parts) > 4 or not all(_NUMBER.fullmatch(p) for p in parts):
        raise ValueError(host)
    *first, last = (int(p[2:] or "0", 16) if p[:2] == "0x" else int(p, 8 if p[0] == "0" else 10) for p in parts)
    if any(n > 255 for n in first) or last >= 256 ** (4 - len(first)):
        raise ValueError(host)
    return str(ipaddress.IPv4Address(last + sum(n << 8 * (3 - k) for k, n in enumerate(first))))


def _host(host: str, special: bool) -> str:
    if host.startswith("["):
        if not host.endswith("]") or "%" in host:
            raise ValueError(host)
        return f"[{_ipv6(ipaddress.IPv6Address(host[1:-1]))}]"
    if not special:
        if _NO_HOST.search(host):
            raise ValueError(host)
        return _encoded(host)
    name = unquote_to_bytes(host).decode("utf-8", "replace")
    name = name.lower() if name.isascii() else name.encode("idna").decode("ascii").lower()
    if _NO_DOMAIN.search(name) or not name:
        raise ValueError(host)
    return _ipv4(name) or name


def _ipv6(address: ipaddress.IPv6Address) -> str:
    """Pieces without leading zeros, the first longest run of two or more zero pieces left out; never with dotted numbers."""
    pieces = [f"{int(address) >> 16 * k & 0xFFFF:x}" for k in range(7, -1, -1)]
    runs = [(len(m[0]), -m.start()) for m in re.finditer("1+", "".join("1" if p == "0" else "0" for p in pieces))]
    n, at = max(runs, default=(0, 0))
    return ":".join(pieces) if n < 2 else ":".join(pieces[:-at]) + "::" + ":".join(pieces[n - at :])


def _authority(text: str, scheme: str) -> str:
    special = scheme in PORTS
    who, at, where = text.rpartition("@")
    name, _, secret = who.partition(":")
    who = _encoded(name, _USER) + (":" + _encoded(secret, _USER) if secret else "")
    found = None if where.endswith("]") else _PORT.search(where)
    host, port = (where[: found.start()], found[1]) if found else (where, "")
    if not host and (special and scheme != "file" or who or found):
        raise ValueError(text)
    if scheme == "file" and (at or found):
        raise ValueError(text)
    host = _host(host, special) if host else ""
    if port and int(port) > 65535:
        raise ValueError(text)
    port = str(int(port)) if port else ""
    if scheme == "file" and host == "localhost":
        host = ""
    return (who + "@" if who else "") + host + (":" + port if port and port != PORTS.get(scheme) else "")


def _path(text: str, special: bool, before: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Segments of a path that follows those of `before`, without dot segments."""
    out = list(before)
    segments = (text.replace("\\", "/") if special else text).split("/")
    for k, segment in enumerate(segments):
        dots, last = _DOT.sub(".", segment), k == len(segments) - 1
        if dots == "..":
            del out[-1:]
        elif dots != ".":
            out.append(_encoded(segment, _PATH))
        if last and dots in (".", ".."):
            out.append("")
    return tuple(out)


def _parsed(text: str, base: Address | None) -> Address:
    text = text.strip(_ENDS).translate({9: None, 10: None, 13: None})
    found = _SCHEME.match(text)
    scheme = found[0].lower() if found else base.scheme if base else ""
    rest, mark, fragment = (text[found.end() + 1 :] if found else text).partition("#")
    fragment = _encoded(fragment, _FRAGMENT) if mark else None
    if not scheme:
        raise ValueError(text)
    special = scheme in PORTS
    rest, mark, query = rest.partition("?")
    query = _encoded(query, _SPECIAL_QUERY if special else _QUERY) if mark else None
    slashed = rest.replace("\\", "/") if special else rest
    own = bool(found) and not (special and base is not None and base.scheme == scheme and (scheme == "file" or not slashed.startswith("//")))
    if special and scheme != "file" and (own or slashed.startswith("//")):
        slashed = "//" + slashed.lstrip("/")
    if slashed.startswith("//"):
        authority, slash, path = slashed[2:].partition("/")
        return Address(scheme, _authority(authority, scheme), _path(path, special) if slash or special else (), query, fragment)
    if own and not special:
        return Address(scheme, None, _path(rest[1:], False) if rest.startswith("/") else _encoded(rest), query, fragment)
    if own:
        return Address(scheme, "", _path(slashed.removeprefix("/"), True), query, fragment)
    if isinstance(base.path, str):  # nothing but a fragment can follow such an address
        if rest or query is not None or fragment is None:
            raise ValueError(text)
        return base._replace(fragment=fragment)
    if slashed.startswith("/"):
        return base._replace(path=_path(slashed[1:], special), query=query, fragment=fragment)
    if rest:
        return base._replace(path=_path(slashed, special, base.path[:-1]), query=query, fragment=fragment)
    return base._replace(query=base.query if query is None else query, fragment=fragment)


@lru_cache(1024)
def _base(text: str | None) -> Address | None:
    try:
        return _parsed(text or "", None)
    except ValueError:
        return None


def resolve(href: str | None, base: str | None = None) -> str | None:
    """The normalised address that href names on the page `base`; null if it names none, or href is null."""
    try:
        return None if href is None else str(_parsed(href, _base(base)))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _resolved(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for hrefs, bases in batches:
        yield pd.Series([resolve(h, b) for h, b in zip(hrefs, bases)], dtype=object)


def address(href: Column, base: Column | None = None) -> Column:
    """resolve() of columns; without `base`, of addresses that stand alone."""
    return _resolved(href, F.lit(None).cast("string") if base is None else base)
