"""Byte ranges of files behind HTTP and WebDAV, read on the executors."""

from __future__ import annotations

import base64
import re
import urllib.request
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import ranges
from cairn.sources.archives import join_pieces

WINDOW = 4 << 20


def headers(user: str | None = None, password: str | None = None, cookie: str | None = None) -> dict[str, str]:
    """Basic authorization and cookie headers."""
    out = {}
    if user is not None:
        out["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode()
    if cookie:
        out["Cookie"] = cookie
    return out


def content_range(text: str) -> tuple[int, int, int | None] | None:
    """(start, stop, total) of a ``Content-Range`` header; total null if it is ``*``."""
    m = re.fullmatch(r"\s*bytes\s+(\d+)-(\d+)/(\d+|\*)\s*", text or "")
    return (int(m[1]), int(m[2]), None if m[3] == "*" else int(m[3])) if m else None


def accepts_ranges(head) -> bool:
    return "bytes" in (head.get("Accept-Ranges") or "").lower() or content_range(head.get("Content-Range") or "") is not None


def probe(url: str, more: dict[str, str]) -> tuple[int | None, bool]:
    """(size, whether ranges work): by a HEAD request, else by asking for one byte."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=more, method="HEAD"), timeout=60) as r:
            if r.headers.get("Content-Length") and accepts_ranges(r.headers):
                return int(r.headers["Content-Length"]), True
    except OSError:
        pass
    with urllib.request.urlopen(urllib.request.Request(url, headers=more | {"Range": "bytes=0-0"}), timeout=60) as r:
        found = content_range(r.headers.get("Content-Range") or "")
        if r.status == 206 and found:
            return found[2], True
        return (int(r.headers["Content-Length"]) if r.headers.get("Content-Length") else None), False


def webdav_size(url: str, more: dict[str, str]) -> int | None:
    """Size from a PROPFIND answer."""
    request = urllib.request.Request(url, headers=more | {"Depth": "0"}, method="PROPFIND")
    with urllib.request.urlopen(request, timeout=60) as r:
        x = ElementTree.fromstring(r.read()).find(".//{DAV:}getcontentlength")
    return int(x.text) if x is not None and x.text else None


def fetch(url: str, start: int, stop: int, more: dict[str, str]) -> bytes:
    """Bytes from ``start`` to ``stop`` inclusive; a server that ignores ranges is cut here."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=more | {"Range": f"bytes={start}-{stop}"}), timeout=300) as r:
        raw = r.read()
        return raw if r.status == 206 else raw[start : stop + 1]


def windows(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """(url, start, stop): ranges that cover ``files(url, size)``, dealt out evenly."""
    return files.select("url", F.explode(ranges.windows(F.col("size"), window)).alias("w")).select("url", "w.start", "w.stop").repartition("url", "start")


def read_windows(asked: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """(url, start, content) of ``asked(url, start, stop)``: one request each, in parallel over tasks."""
    sent = more or {}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for url, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_pylist([{"url": url, "start": start, "content": fetch(url, start, stop, sent)}], schema=pa.schema([("url", pa.string()), ("start", pa.int64()), ("content", pa.binary())]))

    return asked.select("url", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).mapInArrow(run, "url string, start long, content binary")


def read_files(parts: DataFrame) -> DataFrame:
    """(archive_id, content) from windows, for files that fit a row; ``archives.scan`` takes these."""
    return parts.groupBy(F.col("url").alias("archive_id")).agg(F.sort_array(F.collect_list(F.struct("start", "content"))).alias("parts")).transform(join_pieces)
