"""Data URIs, entities and links in HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities in the order in which they are replaced; fixed values.
ENTITIES = [("&#x2f;", "/"), ("&#X2F;", "/"), ("&sol;", "/"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
#: Extensions of media types; fixed values.
MEDIA_EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/svg+xml": "svg", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "text/css": "css", "text/html": "html", "text/plain": "txt", "application/json": "json", "application/pdf": "pdf", "font/ttf": "ttf", "application/x-font-ttf": "ttf", "font/woff": "woff", "font/woff2": "woff2"}
#: Where a data URI stands, each form with its own end.
DATA_URIS = [r'"(data:[^"]+)"', r"'(data:[^']+)'", r"url\(\s*(data:[^)]+)\)"]


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _placed(html: Column, pattern: str) -> Column:
    """(start, uri) of each match."""
    whole, uris, gaps = F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.split(html, pattern, -1)
    before = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda acc, p: acc + F.length(p))
    return F.transform(uris, lambda u, i: F.struct((before(gaps, i + 1) + before(whole, i + 1) - F.length(u) - 1).alias("start"), u.alias("uri")))


def data_uris(html: str | Column) -> Column:
    """Data URIs in double quotes, single quotes or ``url()``, in order of their start; each ends where its own form does."""
    h = _col(html)
    return F.transform(F.sort_array(F.concat(*[_placed(h, p) for p in DATA_URIS])), lambda x: x["uri"])


def find_data_uris(text: str) -> list[tuple[int, str]]:
    """The same for a parser: (start, uri)."""
    return sorted((m.start(1), m[1]) for p in DATA_URIS for m in re.finditer(p, text))


def links(html: str | Column) -> Column:
    """Targets of ``href`` attributes in double quotes, in order."""
    return F.regexp_extract_all(_col(html), F.lit(r'href="([^"]*)"'), F.lit(1))


def unescape(text: str | Column) -> Column:
    """Named entities, then decimal ones; numbers that are no character go."""
    out = _col(text)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    numbers = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#(\d+);"), F.lit(1)))

    def char_of(n: Column) -> Column:
        code = F.coalesce(F.when(F.length(F.ltrim(n, F.lit("0"))) <= 9, n.cast("long")), F.lit(1 << 40))
        real = ((code < 0xD800) | (code > 0xDFFF)) & (code <= 0x10FFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")

    return F.aggregate(numbers, out, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), char_of(n)))


def unescape_text(text: str) -> str:
    """The same for a parser."""
    for name, char in ENTITIES:
        text = text.replace(name, char)
    real = lambda n: n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF
    return re.sub(r"&#([0-9]+);", lambda m: chr(int(m[1])) if len(m[1].lstrip("0")) <= 9 and real(int(m[1])) else "", text)


def _bare(uri: str | Column) -> Column:
    return F.trim(unescape(uri))


def media_type(uri: str | Column) -> Column:
    """What stands before the first parameter if it is a type, else ``text/plain``."""
    kind = F.trim(F.regexp_extract(_bare(uri), r"^data:([^;,]*)", 1))
    return F.when(kind.contains("/"), kind).otherwise("text/plain")


def media_extension(kind: str | Column) -> Column:
    """Extension of a media type: from the table, else its subtype up to a ``+`` if under eight characters, else none."""
    k = F.lower(_col(kind))
    known = F.create_map(*[F.lit(x) for pair in MEDIA_EXTENSIONS.items() for x in pair])
    sub = F.regexp_extract(k, r"^[^/]*/([^+]*)", 1)
    return F.when(k.endswith("/javascript"), "js").otherwise(F.coalesce(F.try_element_at(known, k), F.when(F.octet_length(sub) < 8, sub), F.lit("")))


def extension_of(kind: str) -> str:
    """The same for a parser."""
    kind = kind.lower()
    sub = kind.partition("/")[2].split("+")[0]
    return "js" if kind.endswith("/javascript") else MEDIA_EXTENSIONS.get(kind, sub if len(sub.encode()) < 8 else "")


def data_bytes(uri: str | Column) -> Column:
    """Decoded body of a data URI; null if it is malformed or empty."""
    u = _bare(uri)
    body = F.regexp_extract(u, r"(?s)^data:[^,]*,(.*)$", 1)
    plain = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    packed = F.regexp_replace(plain, r"\s", "")
    return F.when(body == "", None).when(u.rlike(r"(?i)^data:[^,]*;\s*base64\s*[;,]"), F.try_to_binary(packed, F.lit("base64"))).otherwise(F.try_to_binary(plain, F.lit("utf-8")))
