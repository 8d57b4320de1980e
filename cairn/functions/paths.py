"""Path, name and URI functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of compressed and of archive files, fixed values; longest alternatives first.
COMPRESSION_SUFFIXES = ["bz2", "bzip2", "gz", "gzip", "lz4", "lzip", "lzma", "lz", "lrz", "lzo", "xz", "zlib", "zstd", "zst", "zz", "z"]
ARCHIVE_SUFFIXES = ["7z", "ar", "asar", "cab", "cpio", "iso", "rar", "sqlar", "squashfs", "tar", "tbz2", "tbz", "tgz", "txz", "tzst", "warc", "xar", "zip", "deb", "jar", "whl"]


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(path: str | Column) -> Column:
    """Absolute path: empty parts and ``.`` go, ``..`` removes the part before it, never the root.  Null stays null."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(_col(path).isNotNull(), F.concat(F.lit("/"), F.array_join(kept, "/")))


def relative(path: str | Column) -> Column:
    """The normalized path without its leading slash."""
    return F.ltrim(normalize(path), F.lit("/"))


def parent(path: str | Column) -> Column:
    """Directory of a normalized path; the root directory is ``''``."""
    return F.regexp_extract(_col(path), r"(?s)^(.*)/([^/]+)$", 1)


def basename(path: str | Column) -> Column:
    """Last part of a normalized path; ``''`` for the root."""
    return F.regexp_extract(_col(path), r"(?s)^(.*)/([^/]+)$", 2)


def join(directory: str | Column, name: str | Column) -> Column:
    """Directory and name with one slash between; the root is ``''`` or ``/``."""
    d, n = _col(directory), _col(name)
    return F.when(d.isin("", "/"), F.concat(F.lit("/"), n)).when(n == "", d).otherwise(F.concat(d, F.lit("/"), n))


def at_depth(path: str | Column, depth: int | Column) -> Column:
    """The path's first ``depth`` parts."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(depth) if isinstance(depth, int) else depth, F.lit(0))), "/"))


def ancestors(path: str | Column) -> Column:
    """All proper ancestors of a normalized path below the root, outermost first."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))


def link_target(path: str | Column, target: str | Column) -> Column:
    """Where a symbolic link at ``path`` points to: absolute, or relative to its directory."""
    t = _col(target)
    return normalize(F.when(t.startswith("/"), t).otherwise(F.concat(parent(path), F.lit("/"), t)))


def deletion_forms(path: str | Column) -> Column:
    """The three spellings under which archives store a member: ``p``, ``/p``, ``./p``."""
    p = relative(path)
    return F.array(p, F.concat(F.lit("/"), p), F.concat(F.lit("./"), p))


def strip_suffix(name: str | Column, suffixes: list[str]) -> Column:
    """Name without one trailing suffix of the list, letter case ignored; a bare suffix stays."""
    return F.regexp_replace(_col(name), "(?i)(?<=.)\\.(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$", "")


#: Suffixes that a nested archive's folder is shown without, and short forms of compressed TARs; fixed values.
SHOWN_SUFFIXES = ["tar.gz", "tar.bz2", "tar.xz", "tar.zst", "tar.zstd", "tar", "tgz", "tbz2", "tbz", "txz", "tzst", "zip", "jar", "7z", "rar", "iso", "cab", "ar", "a", "cpio", "sqlar", "squashfs", "sqfs", "snap", "gz", "bz2", "xz", "zst"]
SHORT_TARS = ["tgz", "taz", "tbz2", "tbz", "txz", "tzst", "tlz4"]
DECODED_SUFFIXES = ["gzip", "gz", "bz2", "xz", "zst", "zstd", "lz4", "lzip", "lzop", "lzo", "lzma", "zlib", "zz", "lrzip", "lrz", "lz", "z"]


def strip_archive(name: str | Column) -> Column:
    """Name without its archive suffix: ``a.tar.gz`` and ``a.tgz`` give ``a``, ``a.zip.gz`` gives ``a.zip``."""
    return F.regexp_replace(_col(name), "(?i)(?<=.)\\.(" + "|".join(re.escape(s) for s in SHOWN_SUFFIXES) + ")$", "")


def strip_compression(name: str | Column) -> Column:
    """Name of the decoded file: one compression suffix goes, and ``a.tgz`` gives ``a.tar``."""
    short = F.regexp_replace(_col(name), "(?i)\\.(" + "|".join(SHORT_TARS) + ")$", ".tar")
    return F.when(short != _col(name), short).otherwise(F.regexp_replace(_col(name), "(?i)\\.(" + "|".join(DECODED_SUFFIXES) + ")$", ""))


def is_archive(name: str | Column, suffixes: list[str] | None = None) -> Column:
    """Whether the name's suffix is an archive's or a compressed file's, or marks a first split part."""
    known = [*ARCHIVE_SUFFIXES, *COMPRESSION_SUFFIXES] if suffixes is None else suffixes
    return F.coalesce(_col(name).rlike("(?i)\\.(" + "|".join(known) + ")$") | _col(name).rlike(r"(?i)\.(0+[01]?|a+)$"), F.lit(False))


def archive_class(name: str | Column) -> Column:
    """``archive``, ``compressed``, ``split`` or ``plain`` by suffix."""
    n = _col(name)
    return F.when(n.rlike("(?i)\\.(" + "|".join(ARCHIVE_SUFFIXES) + ")(\\.(" + "|".join(COMPRESSION_SUFFIXES) + "))?$"), "archive").when(n.rlike("(?i)\\.(" + "|".join(COMPRESSION_SUFFIXES) + ")$"), "compressed").when(n.rlike(r"(?i)\.(0+[01]?|a+)$"), "split").otherwise("plain")


def uri_to_path(uri: str | Column) -> Column:
    """``/host/path?query`` of a URI; no fragment; an empty path is ``/`` and a trailing slash gets ``index.html``."""
    u = F.regexp_replace(_col(uri), r"(?s)#.*$", "")
    host = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(u, r"(?s)^[^?]*(\?.*)$", 1)
    full = F.when(path == "", "/").otherwise(path)
    return F.concat(F.lit("/"), host, F.when(full.endswith("/"), F.concat(full, F.lit("index.html"))).otherwise(full), query)


def glob_to_regex(pattern: str | Column) -> Column:
    """Anchored regular expression of a glob with ``*`` and ``?``."""
    quoted = F.regexp_replace(_col(pattern), r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def host_matches(host: str | Column, patterns: list[str]) -> Column:
    """Whether a host meets one of the globs and none of those with a leading ``!``."""
    yes = [F.rlike(_col(host), glob_to_regex(F.lit(p))) for p in patterns if not p.startswith("!")]
    no = [F.rlike(_col(host), glob_to_regex(F.lit(p[1:]))) for p in patterns if p.startswith("!")]
    return reduce(Column.__or__, yes, F.lit(False)) & ~reduce(Column.__or__, no, F.lit(False))


def ordered_backends(chosen: str | Column, defaults: list[str]) -> Column:
    """Chosen back ends, last named first, then the defaults; no repetition."""
    return F.array_distinct(F.concat(F.reverse(F.filter(F.split(_col(chosen), r"\s*,\s*"), lambda x: x != "")), F.array(*[F.lit(d) for d in defaults])))
