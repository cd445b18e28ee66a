"""Addresses as single strings, read as ``urls`` reads columns, for the Python that walks page trees."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote, quote_plus, unquote, unquote_plus

from sitelens.functions import urls as U

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_ENDS, _BREAKS = re.compile(r"^[\x00-\x20]+|[\x00-\x20]+$"), re.compile(r"[\t\n\r]")
_LENIENT = re.compile(rf"(?i)(?:{U.SPECIAL}):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?")
_HOST = re.compile(r"(\[[^\[\]]*\]|[^:\[\]]*)(?::([0-9]*))?")
_REFUSED, _ENCODED = re.compile(U.HOST_REFUSED), re.compile(U.PATH_ENCODED)
_NUMBER = re.compile(r"(?:^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?$")
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FOUR, _SIX = re.compile(rf"{_BYTE}(?:\.{_BYTE}){{3}}"), re.compile(r"\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]")
_DOTS = re.compile(r"(?i)/(\.|%2e){1,2}(/|$)")
_HERE, _UP, _TRACKING = re.compile(r"(?i)(\.|%2e)"), re.compile(r"(?i)(\.|%2e){2}"), re.compile(U.TRACKING)
_PLACES = str.maketrans(U.COLLATED, "".join(chr(33 + i) for i in range(len(U.COLLATED))))


class Address(NamedTuple):
    scheme: str
    user: str
    host: str
    port: str
    path: str
    query: str

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.user}{self.host}" + (f":{self.port}" if self.port else "")


def _clean(raw: str) -> str:
    return _BREAKS.sub("", _ENDS.sub("", raw))


def _host(raw: str) -> str:
    if raw.startswith("["):
        return raw.lower() if _SIX.fullmatch(raw) else ""
    name = unquote(raw, errors="replace").translate({0x3002: ".", 0xFF0E: ".", 0xFF61: "."}).lower()
    if not name.isascii():
        name = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))
    if _REFUSED.search(name) or (_NUMBER.search(name) and not _FOUR.fullmatch(name)):
        return ""
    return name


def _path(tail: str) -> str:
    path = _ENCODED.sub(lambda m: quote(m.group(), safe=""), tail.replace("\\", "/"))
    if not _DOTS.search(path):
        return path or "/"
    parts, out = path.split("/")[1:], []
    for i, part in enumerate(parts):
        if _UP.fullmatch(part) or _HERE.fullmatch(part):
            out = out[:-1] if _UP.fullmatch(part) else out
            out += [""] * (i == len(parts) - 1)
        else:
            out.append(part)
    return "/" + "/".join(out)


@lru_cache(4096)
def read(raw: str) -> Address | None:
    """An absolute http address; None for what a browser refuses and for other schemes."""
    text = _clean(raw.encode("utf-8", "replace").decode())
    kind, cut = _SCHEME.match(text), _LENIENT.match(text)
    if kind is None or cut is None or kind.group(1).lower() not in ("http", "https"):
        return None
    user, _, behind = cut.group(1).rpartition("@")
    found = _HOST.fullmatch(behind)
    name = _host(found.group(1)) if found else ""
    port = (found.group(2) or "") if found else ""
    if not name or len(port) >= 18 or int(port or 0) > 65535:
        return None
    return Address(kind.group(1).lower(), user + "@" * bool(_), name, str(int(port)) if port else "", _path(cut.group(2)), cut.group(3) or "")


def form(query: str) -> str:
    pairs = [(unquote_plus(n, errors="replace"), unquote_plus(v, errors="replace")) for p in query.split("&") if p for n, _, v in [p.partition("=")]]
    kept = [p for p in pairs if not _TRACKING.match(p[0])]
    kept.sort(key=lambda p: (p[0].lower().translate(_PLACES), p[0].swapcase() if p[0].isascii() else "".join(c.swapcase() if c.isascii() else c for c in p[0])))
    return "&".join("=".join(quote_plus(x, safe="*").replace("~", "%7E") for x in p) for p in kept)


def resolved(raw: str, base: str | None) -> str:
    """A link against the address of its page."""
    text = _clean(raw)
    if _SCHEME.match(text) or base is None or (at := read(base)) is None:
        return text
    head = re.match(r"[^?#]*", text).group().replace("\\", "/")
    if head.startswith("//"):
        return f"{at.scheme}:{text}"
    if head.startswith("/"):
        return at.origin + text
    if head:
        return at.origin + at.path.rpartition("/")[0] + "/" + text
    return at.origin + at.path + (text if text.startswith("?") else f"?{at.query}" if at.query else "")


def canonical(raw: str, base: str | None = None) -> str | None:
    """A URL resolved, without fragment, tracking parameters, default port or closing slash, parameters by name."""
    at = read(resolved(raw, base))
    if at is None:
        return None
    usual = at.port in ("", "443" if at.scheme == "https" else "80")
    asked = form(at.query)
    return f"{at.scheme}://{at.user}{at.host}" + ("" if usual else f":{at.port}") + (at.path.rstrip("/") or "/") + (f"?{asked}" if asked else "")


def site(url: str) -> str:
    """The registrable domain; empty for what is no http address."""
    at = read(url)
    labels = re.sub(r"^www\.", "", at.host).split(".") if at else [""]
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in U.MULTI_PART else labels[-2:])
