"""Parsers of option strings, on the driver."""

from __future__ import annotations

import json
import os
import re
from urllib.parse import unquote, urlsplit


def comma_list(text: str) -> list[str]:
    """A JSON array of strings, or items between commas; blanks around them go."""
    text = text.strip()
    if text.startswith("["):
        found = json.loads(text)
        if not all(isinstance(x, str) for x in found):
            raise ValueError("not a list of strings")
        return found
    return [x.strip() for x in text.split(",") if x.strip()]


def extensions(text: str) -> list[str]:
    """Recursive extensions: lower case, no leading dot, each once, in order of the alphabet."""
    return sorted({x.lower().lstrip(".") for x in comma_list(text)} - {""})


def bind_address(text: str, port: int = 2049) -> tuple[str, int]:
    """``host``, ``:port``, ``host:port`` or ``[v6]:port``."""
    m = re.fullmatch(r"(?:\[([^\]]+)\]|([^:\[\]]*))(?::(\d{1,5}))?", text.strip())
    if not m or m[3] and int(m[3]) > 65535:
        raise ValueError(f"bad address {text}")
    return m[1] or m[2] or "127.0.0.1", int(m[3]) if m[3] else port


def index_candidates(archive: str, folders: list[str] | None = None, suffix: str = ".index.parquet") -> list[str]:
    """Places for an archive's index in order: beside it, then in each folder under its path with ``/`` as ``_``."""
    flat = os.path.abspath(archive).replace("/", "_")
    out = []
    for f in folders if folders is not None else ["", os.path.expanduser("~/.cairn")]:
        out.append(archive + suffix if f == "" else os.path.join(f, flat + suffix))
    return out


def index_place(archive: str, folders: list[str] | None = None, suffix: str = ".index.parquet") -> str | None:
    """The first candidate that exists, else the first whose folder can be written; None means in memory."""
    places = index_candidates(archive, folders, suffix)
    found = next((p for p in places if os.path.exists(p)), None)
    return found or next((p for p in places if os.access(os.path.dirname(p) or ".", os.W_OK)), None)


def remote(url: str) -> dict[str, str | int | None]:
    """Parts of a remote URL: scheme, user, password, host, port, and by scheme bucket and key, share and path, or path."""
    u = urlsplit(url)
    out: dict[str, str | int | None] = {"scheme": u.scheme.lower(), "user": unquote(u.username) if u.username else None, "password": unquote(u.password) if u.password else None, "host": u.hostname, "port": u.port, "path": unquote(u.path)}
    if not u.scheme or (not u.hostname and out["scheme"] not in ("file", "dropbox")):
        raise ValueError(f"no remote URL: {url}")
    if out["scheme"] in ("s3", "s3a"):
        out |= {"bucket": u.netloc, "key": unquote(u.path.lstrip("/"))}
    elif out["scheme"] == "smb":
        share, _, path = unquote(u.path.lstrip("/")).partition("/")
        out |= {"share": share, "path": path}
    elif out["scheme"] in ("ssh", "sftp", "scp") and unquote(u.path).startswith("/~/"):
        out["path"] = unquote(u.path)[3:]
    elif out["scheme"] == "dropbox":
        out |= {"path": "/" + "/".join(x for x in (u.netloc + unquote(u.path)).split("/") if x)}
    return out


def ssh_options(config: str, host: str, lists: tuple[str, ...] = ("identityfile", "certificatefile")) -> dict[str, str | list[str]]:
    """Options of an ``ssh_config`` text for a host.

    The first value of an option wins, list options gather all; a ``Host`` line
    matches by globs, and not if one of its ``!`` globs does.
    """
    out: dict[str, str | list[str]] = {}
    on = True
    for line in config.splitlines():
        m = re.match(r"\s*([A-Za-z][A-Za-z0-9]*)\s*(?:=|\s)\s*(.*?)\s*$", line.split("#", 1)[0])
        if not m or not m[2]:
            continue
        key, value = m[1].lower(), m[2].strip('"')
        if key == "host":
            globs = value.split()
            hit = lambda g: re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), host) is not None
            on = any(hit(g) for g in globs if g[0] != "!") and not any(hit(g[1:]) for g in globs if g[0] == "!")
        elif on and key in lists:
            out.setdefault(key, []).append(value)
        elif on:
            out.setdefault(key, value)
    return out
