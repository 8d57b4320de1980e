"""What a format parser yields, and how rows are made of it.

A parser is a generator over a seekable binary file: ``parse(f) -> Entry``.
``data`` rows can be read again by (offset, size); entries without an offset
carry their bytes.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

from cairn.functions.values import S_IFDIR, S_IFLNK, S_IFREG


@dataclass
class Entry:
    name: str
    header: int = 0
    offset: int | None = None
    size: int = 0
    mtime: float = 0.0
    mode: int = S_IFREG | 0o644
    type_flag: int = 0
    linkname: str = ""
    uid: int = 0
    gid: int = 0
    sparse: bool = False
    generated: bool = False
    tombstone: bool = False
    xattrs: dict[str, bytes] = field(default_factory=dict)
    segments: list[tuple[str, int, int]] = field(default_factory=list)
    data: bytes | None = None


class FormatError(ValueError):
    """The bytes are not of this format, or are cut."""


def clean(name: str) -> str:
    """A member's absolute path: as ``paths.normalize`` does it in a plan."""
    parts: list[str] = []
    for p in name.split("/"):
        if p == "..":
            if parts:
                parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/" + "/".join(parts)


def split(path: str) -> tuple[str, str]:
    """(directory, name); the root directory is ``''``."""
    head, tail = posixpath.split(path)
    return ("" if head == "/" else head), tail


def need(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise FormatError("cut short")
    return data


def decode(raw: bytes, label: str = "utf-8") -> str:
    """Text of a name; unknown labels and bad bytes fall back to replacement characters."""
    names = {"utf8": "utf-8", "latin1": "latin-1", "latin-1": "latin-1", "iso-8859-1": "latin-1", "cp1252": "cp1252", "windows-1252": "cp1252", "cp437": "cp437", "ibm437": "cp437"}
    return raw.decode(names.get(label.lower(), "utf-8"), "replace")


def octal(raw: bytes) -> int:
    """Number field of a header: octal text, or base 256 if the first bit is set."""
    if raw[:1] and raw[0] & 0x80:
        n = int.from_bytes(raw, "big") & ((1 << (8 * len(raw) - 1)) - 1)
        return n - (1 << (8 * len(raw) - 1)) if raw[0] & 0x40 else n
    text = raw.replace(b"\0", b" ").strip()
    if not text:
        return 0
    if text.strip(b"01234567"):
        raise FormatError("not octal")
    return int(text, 8)


def is_dir(e: Entry) -> bool:
    return e.mode & 0xF000 == S_IFDIR


def directory(name: str, **more) -> Entry:
    return Entry(name, mode=S_IFDIR | 0o755, **more)


def symlink(name: str, target: str, **more) -> Entry:
    return Entry(name, mode=S_IFLNK | 0o777, linkname=target, **more)


Entries = Iterator[Entry]
