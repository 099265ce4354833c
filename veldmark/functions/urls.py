"""References resolved as browsers do it: lower-case hosts, encoded paths, no dot segments."""

from __future__ import annotations

import re
from typing import NamedTuple

# Schemes whose URLs have hosts, with their default ports, and the characters that each part encodes.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
_FRAGMENT, _QUERY, _PATH, _OPAQUE = r"[\x00-\x20\"<>`\x7f-\U0010ffff]", r"[\x00-\x20\"#<>\x7f-\U0010ffff]", r"[\x00-\x20\"#<>?`{}\x7f-\U0010ffff]", r"[\x00-\x1f\x7f-\U0010ffff]"


class Url(NamedTuple):
    scheme: str
    host: str | None
    path: str
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        out = self.scheme + ":" + ("" if self.host is None else "//" + self.host) + self.path
        return out + ("" if self.query is None else "?" + self.query) + ("" if self.fragment is None else "#" + self.fragment)


def _encode(text: str, characters: str) -> str:
    return re.sub(characters, lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text)


def _host(text: str, scheme: str) -> str:
    user, at, host = text.rpartition("@")
    m = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::([0-9]*))?", host)
    if not m or (not m[1] and scheme != "file") or re.search(r"[\s#%/<>?@\\^|]", m[1]) or (m[2] and int(m[2]) > 65535):
        raise ValueError("no host")
    name = m[1].lower()
    if not name.isascii():
        try:
            name = name.encode("idna").decode()
        except UnicodeError as e:
            raise ValueError("no host") from e
    port = m[2].lstrip("0") or "0" if m[2] else ""
    return (_encode(user, _PATH) + "@" if at and user else "") + name + (f":{port}" if port and port != PORTS.get(scheme) else "")


def _segments(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        plain, last = re.sub("%2e", ".", p, flags=re.I), i == len(parts) - 1
        if plain == "..":
            out = out[:-1] + [""] * last
        elif plain == ".":
            out += [""] * last
        else:
            out.append(p)
    return "/" + "/".join(out)


def _path(path: str, scheme: str) -> str:
    return _segments(_encode(path, _PATH))


def join(base: str | Url | None, reference: str) -> Url:
    """The URL that ``reference`` names in a document at ``base``; ValueError if it names none."""
    text = re.sub(r"[\t\n\r]", "", reference.strip("".join(map(chr, range(33)))))
    rest, mark, fragment = text.partition("#")
    fragment = _encode(fragment, _FRAGMENT) if mark else None
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", rest)
    if isinstance(base, str):
        base = join(None, base)
    scheme = m[1].lower() if m else base.scheme if base else ""
    if not scheme:
        raise ValueError("a relative reference without a base")
    special = scheme in PORTS
    body = rest[m.end() :] if m else rest
    body, mark, query = body.partition("?")
    query = _encode(query, _QUERY + r"|'" if special else _QUERY) if mark else None
    if special:
        body = body.replace("\\", "/")
        if m and not body.startswith("/") and base and base.scheme == scheme:
            m = None  # a scheme that only repeats the base's
    if m and not special and not body.startswith("/"):
        return Url(scheme, None, _encode(body, _OPAQUE), query, fragment)
    if m and special and scheme != "file":
        body = "//" + body.lstrip("/")
    if body.startswith("//"):
        host, slash, path = body[2:].partition("/")
        return Url(scheme, _host(host, scheme), _path(slash + path if slash else "/", scheme), query, fragment)
    if m:
        return Url(scheme, "" if scheme == "file" else None, _path(body, scheme), query, fragment)
    if not base or not base.path.startswith("/"):
        if base and not body and query is None and fragment is not None:
            return base._replace(fragment=fragment)
        raise ValueError("a base that nothing is relative to")
    if not body:
        return base._replace(query=query if query is not None else base.query, fragment=fragment)
    path = body if body.startswith("/") else base.path.rpartition("/")[0] + "/" + body
    return Url(scheme, base.host, _path(path, scheme), query, fragment)
