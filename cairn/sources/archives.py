"""Archives as DataFrames.

Two readers give the same rows: ``scan`` goes through Spark's ``binaryFile``, so it
reads any store that Spark reads; the data source ``cairn`` opens files by path,
one partition each, for archives too large for one row.
"""

from __future__ import annotations

import glob
import hashlib
import io
import lzma
import os
import re
import sqlite3
import stat
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions.values import S_IFREG
from cairn.plans import schema as S
from cairn.sources import codecs, formats, images, tar
from cairn.sources.records import Entry, FormatError, clean, split

PARSERS = {"zip": formats.zip_archive, "asar": formats.asar, "ar": formats.ar, "cpio": formats.cpio, "iso": formats.iso9660, "warc": formats.warc, "xar": formats.xar, "cab": formats.cab, "sqlar": formats.sqlar, "fat": formats.fat, "ogg": formats.ogg, "html": formats.html, "7z": images.seven_zip, "squashfs": images.squashfs, "ext4": images.ext, "pdf": images.pdf}
_ROW = ["archive_id", "path", "name", "version_key", "header_offset", "data_offset", "size", "mtime", "mode", "type_flag", "linkname", "uid", "gid", "is_archive", "is_sparse", "is_generated", "is_tombstone", "recursion_depth", "backend"]
_SUFFIX = re.compile(r"(?i)(?<=.)\.(bz2|bzip2|gz|gzip|lz4|lzip|lzma|lz|lzo|xz|zlib|zstd|zst|zz|z)$")
#: What a broken archive or member raises.
DAMAGE = (FormatError, ValueError, EOFError, OSError, KeyError, IndexError, struct.error, zlib.error, lzma.LZMAError, zipfile.BadZipFile, sqlite3.Error, RuntimeError, NotImplementedError)


def open_body(f, name: str):
    """(seekable file of the decoded body, codec or None)."""
    head = f.read(64)
    f.seek(0)
    codec = codecs.detect(head, name)
    if codec is None:
        return f, None
    return formats.spool(codecs.decompress(f, codec)), codec


def entries(f, name: str, **options) -> Iterator[tuple[Entry, str]]:
    """(entry, back end) of a file of any known format; any other is one member.

    Where damage ends an archive behind its start, what was read before stays, and
    the reason is added to the list ``damage`` if one is given.
    """
    body, codec = open_body(f, name)
    yield from _entries(body, codec, name, **options)


def _entries(body, codec: str | None, name: str, **options) -> Iterator[tuple[Entry, str]]:
    head = body.read(65536)
    body.seek(0)
    kind = formats.detect(head)
    chosen = options.get("backends") or []
    if chosen and kind not in chosen:
        kind = next((k for k in chosen if k == "tar" and tar.looks_like(head)), None)
    try:
        if kind == "tar":
            for e in tar.parse(body, ignore_zeros=options.get("ignore_zeros", False), incremental=options.get("incremental"), encoding=options.get("encoding", "utf-8"), nested=options.get("recursive", False), most=options.get("depth", 64)):
                yield e, "tar"
            return
        if kind == "sqlar":
            raw = body.read()
            try:
                yield from ((e, "sqlar") for e in list(formats.sqlar(io.BytesIO(raw))))
            except FormatError:
                yield from ((e, "index") for e in formats.index_file(io.BytesIO(raw)))
            return
        if kind in PARSERS:
            more = {"password": options["password"].encode()} if kind == "zip" and options.get("password") else {}
            for e in PARSERS[kind](body, **more):
                yield e, kind
            return
    except FormatError as e:
        if body.tell() and kind in ("tar", "cpio", "ar", "warc", "ogg"):
            if options.get("damage") is not None:
                options["damage"].append(str(e))
            return  # what was read before the damage stays
        raise
    body.seek(0, io.SEEK_END)
    base = os.path.basename(name)
    yield Entry(_SUFFIX.sub("", base) if codec else base, offset=0, size=body.tell(), header=-1), "file"


def row(archive_id: str, e: Entry, backend: str) -> tuple:
    path, name = split(clean(e.name))
    depth = e.name.count(".tar/") if backend == "tar" else 0
    archive = bool(re.search(r"(?i)\.(7z|ar|asar|cab|cpio|iso|rar|sqlar|tar|tbz2?|tgz|txz|tzst|warc|xar|zip)(\.(gz|bz2|xz|zst|lz4|lz))?$", name))
    return (archive_id, path, name, e.header if e.header != -1 else None, e.header if e.header != -1 else None, e.offset, max(e.size, 0), e.mtime, e.mode, e.type_flag, e.linkname, e.uid, e.gid, archive, e.sparse, e.generated, e.tombstone, depth, backend)


def _arrow(spec) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spec)


#: Bytes of text and binary values after which a batch of rows goes to Spark.
BATCH_BYTES = 8 << 20


def in_batches(rows: Iterator[tuple], spec, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows; one ends with the row that brings its values to ``BATCH_BYTES``."""
    arrow, hold, held = _arrow(spec), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hold, strict=True), arrow, strict=True)], schema=arrow)

    for r in rows:
        hold.append(r)
        held += sum(len(x) for x in r if isinstance(x, bytes | str))
        if len(hold) >= size or held >= BATCH_BYTES:
            yield batch()
            hold, held = [], 0
    if hold:
        yield batch()


def binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive_id, content) of files in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive_id"), "content")


def _each(files: DataFrame, make, spec, load=None) -> DataFrame:
    """Rows of ``make(archive_id, file)`` for each file; a broken one gives what comes before the damage, ``scan_damage`` tells of it.

    ``load(cell)``: the bytes of a file whose content is an Arrow value of another kind.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    cell = batch.column(1)[i]
                    raw = load(cell) if load else cell.as_py()
                    try:
                        yield from make(batch.column(0)[i].as_py(), io.BytesIO(raw or b""))
                    except DAMAGE:
                        continue

        return in_batches(rows(), spec)

    return files.select("archive_id", "content").mapInArrow(run, spec)


def scan(files: DataFrame, load=None, **options) -> DataFrame:
    """The members of archives ``files(archive_id, content)``; ``load`` makes the bytes of other content in the same pass."""
    return _each(files, lambda a, f: (row(a, e, b) for e, b in entries(f, a, **options)), S.FILES, load)


def scan_damage(files: DataFrame, **options) -> DataFrame:
    """(archive_id, path, reason): archives that are broken or end early, with path null, and members whose bytes cannot be read."""

    def make(a, f):
        found: list[str] = []
        try:
            body, codec = open_body(f, a)
            source: dict = {}
            for e, b in list(_entries(body, codec, a, damage=found, **options)):
                if e.mode & 0xF000 == S_IFREG and not e.tombstone:
                    try:
                        if len(member_bytes(body, e, b, source, options.get("password"))) < e.size and not e.linkname and b != "index" and (e.offset is not None or e.data is not None):
                            raise EOFError("cut short")
                    except DAMAGE as x:
                        yield (a, clean(e.name), f"{type(x).__name__}: {x}")
        except DAMAGE as x:
            found.append(f"{type(x).__name__}: {x}")
        for reason in found:
            yield (a, None, reason)

    return _each(files, make, S._t("archive_id string, path string, reason string"))


def scan_attributes(files: DataFrame, **options) -> DataFrame:
    """Extended attributes stored in archives."""
    return _each(files, lambda a, f: ((a, e.header, k, v) for e, _ in entries(f, a, **options) for k, v in sorted(e.xattrs.items())), S.XATTRS)


def scan_segments(files: DataFrame, **options) -> DataFrame:
    """Data and hole segments of sparse and scattered members, with their logical offsets."""

    def make(a, f):
        for e, _ in entries(f, a, **options):
            at = 0
            for i, (kind, start, n) in enumerate(e.segments):
                yield (a, e.header, i, kind, start, n, at)
                at += n

    return _each(files, make, S.SEGMENTS)


def scan_blocks(files: DataFrame) -> DataFrame:
    """Block maps of compressed files."""

    def make(a, f):
        raw = f.getvalue()
        codec = codecs.detect(raw[:64], a)
        if codec in codecs.BLOCK_MAPS:
            build, unit = codecs.BLOCK_MAPS[codec]
            found = build(raw)
            for i, (comp, data) in enumerate(found):
                yield (a, codec, comp, unit, data, i == len(found) - 1)

    return _each(files, make, S.BLOCKS)


def member_bytes(body, e: Entry, backend: str, source: dict | None = None, password: str | None = None) -> bytes:
    """The whole content of a regular member; ``source`` keeps what is read once for an archive."""
    if e.data is not None:
        return e.data
    if e.segments:
        out = []
        for kind, at, n in e.segments:
            if kind == "hole":
                out.append(bytes(n))
            else:
                body.seek(at)
                out.append(body.read(n))
        return b"".join(out)
    if backend == "zip":
        source = {} if source is None else source
        if "zip" not in source:
            source["zip"] = formats.ZipBody(body, password.encode() if password else None)
        return source["zip"].read(e.header)
    if e.offset is None:
        return b""
    body.seek(e.offset)
    return body.read(e.size)


#: Content is a file's bytes.
FILE = S._t("archive_id string, content binary")
CONTENT = S._t("archive_id string, path string, name string, version_key long, content binary")


def _contents(f, a: str, options: dict, stored: bool = False) -> Iterator[tuple[Entry, bytes]]:
    """Regular members with their bytes, the archive decoded once; members that cannot be read are left out.

    ``stored``: the raw bytes of sparse TAR members.
    """
    body, codec = open_body(f, a)
    source: dict = {}
    found = _entries(body, codec, a, **options)
    head = body.read(65536)
    body.seek(0)
    for e, b in found if formats.detect(head) == "tar" else list(found):  # the TAR parser seeks before each read, so its members are not held
        if e.mode & 0xF000 != S_IFREG or e.tombstone:
            continue
        try:
            if stored and e.sparse and b == "tar":
                body.seek(e.offset)
                raw = body.read(sum(n for kind, _, n in e.segments if kind == "data"))
            else:
                raw = member_bytes(body, e, b, source, options.get("password"))
        except DAMAGE:
            continue
        yield e, raw


def _content_rows(a: str, f, options: dict) -> Iterator[tuple]:
    for e, raw in _contents(f, a, options):
        path, name = split(clean(e.name))
        yield (a, path, name, e.header, raw)


def scan_contents(files: DataFrame, load=None, **options) -> DataFrame:
    """Bytes of the regular members: holes of sparse ones are zeros; ``load`` as in ``scan``.

    Each archive is one cell; ``read_contents`` opens files by path and holds a member at a time.
    """
    return _each(files, lambda a, f: _content_rows(a, f, options), CONTENT, load)


#: Digests by name; fixed values.
DIGESTS = {"crc32": None, "md5": "md5", "sha1": "sha1", "sha256": "sha256"}


def digest_names(text: str) -> list[str]:
    """Names of a comma list, letter case, ``-`` and ``_`` ignored."""
    found = [x.strip().lower().replace("-", "").replace("_", "") for x in text.split(",") if x.strip()]
    for x in found:
        if x not in DIGESTS:
            raise ValueError(f"unknown digest {x}")
    return list(dict.fromkeys(found))


def scan_digests(files: DataFrame, algorithms: str = "sha256", **options) -> DataFrame:
    """Digests of the members with content as attributes ``user.<name>``, several in one pass.

    TAR members are hashed as stored: the raw bytes of a sparse one.
    """
    names = digest_names(algorithms)

    def make(a, f):
        for e, raw in _contents(f, a, options, stored=True):
            if e.size <= 0 or e.generated or e.linkname:
                continue
            for n in names:
                yield (a, e.header, f"user.{n}", (f"{zlib.crc32(raw):08x}" if n == "crc32" else hashlib.new(DIGESTS[n], raw).hexdigest()).encode())

    return _each(files, make, S.XATTRS)


def open_nested(contents: DataFrame):
    """For ``layers.automount``: opens archive members whose bytes are in ``contents(archive_id, path, name, version_key, content)``.

    The archive_id of a nested archive's rows is its owner's archive and path.
    """

    def run(members: DataFrame) -> DataFrame:
        own = members.select("archive_id", "path", "name", "version_key", F.col("_full").alias("_owner")).join(contents, ["archive_id", "path", "name", "version_key"])
        spec = S._t("archive_id string, path string, name string, version_key long, header_offset long, data_offset long, size long, mtime double, mode long, type_flag int, linkname string, uid long, gid long, is_archive boolean, is_sparse boolean, is_generated boolean, is_tombstone boolean, recursion_depth int, backend string, _owner string")

        def make(batches):
            def rows():
                for batch in batches:
                    for i in range(batch.num_rows):
                        owner, raw, within = (batch.column(k)[i].as_py() for k in range(3))
                        try:
                            yield from ((*row((within or "") + owner, e, b), owner) for e, b in list(entries(io.BytesIO(raw), owner)) if b != "file")
                        except DAMAGE:
                            continue  # it only looks like an archive

            return in_batches(rows(), spec)

        return own.select("_owner", "content", "archive_id").mapInArrow(make, spec)

    return run


# data source by path ----------------------------------------------------------


class _One(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, contents: bool = False):
        self.options, self.contents = dict(options), contents

    def partitions(self):
        path = self.options["path"]
        found = sorted(glob.glob(path, recursive=True)) if glob.has_magic(path) else [path]
        return [_One(p) for f in found for p in ([f] if os.path.isfile(f) else sorted(os.path.join(d, n) for d, _, names in os.walk(f) for n in names))]

    def read(self, partition):
        flag = lambda k: str(self.options.get(k, "false")).lower() == "true"
        more = {"ignore_zeros": flag("ignorezeros"), "recursive": flag("recursive"), "encoding": self.options.get("encoding", "utf-8"), "depth": int(self.options.get("depth", 64)), "backends": [x for x in self.options.get("backends", "").split(",") if x]}
        with open(partition.path, "rb") as f:
            if self.contents:
                yield from in_batches(self._members(f, partition.path, more), CONTENT)
            else:
                yield from (row(partition.path, e, b) for e, b in entries(f, partition.path, **more))

    def _members(self, f, path: str, more: dict) -> Iterator[tuple]:
        try:
            yield from _content_rows(path, f, more)
        except DAMAGE:
            return  # as in a scan of cells, what comes before the damage stays


class ArchiveSource(DataSource):
    """``spark.read.format("cairn").load(path)``: the members of archives, a partition for each file.

    With the option ``contents`` the bytes of the regular members, as ``scan_contents`` gives them.
    """

    @classmethod
    def name(cls):
        return "cairn"

    def _contents(self) -> bool:
        return str(self.options.get("contents", "false")).lower() == "true"

    def schema(self):
        return CONTENT if self._contents() else S.FILES

    def reader(self, schema):
        return _Reader(self.options, self._contents())


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self):
        return [_One(self.root), *[_One(p) for p in sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))]]

    def read(self, partition):
        deep = partition.path != self.root
        for where, dirs, names in os.walk(partition.path):
            for n in [*dirs, *names]:
                full = os.path.join(where, n)
                st = os.lstat(full)
                link = os.readlink(full) if stat.S_ISLNK(st.st_mode) else ""
                path, name = split(clean(os.path.relpath(full, self.root)))
                yield (self.root, path, name, None, None, 0, st.st_size if stat.S_ISREG(st.st_mode) else 0, st.st_mtime, st.st_mode, 0, link, st.st_uid, st.st_gid, False, False, False, False, 0, "folder")
            if not deep:
                break


class FolderSource(DataSource):
    """``spark.read.format("cairn-folder").load(path)``: a folder as a catalog, a partition for each top folder."""

    @classmethod
    def name(cls):
        return "cairn-folder"

    def schema(self):
        return S.FILES

    def reader(self, schema):
        return _FolderReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.ref = options["path"], options.get("ref", "HEAD")

    def read(self, partition):
        for e in images.git_tree(self.root, self.ref, contents=False):
            yield row(self.root, e, "git")


class GitSource(DataSource):
    """``spark.read.format("cairn-git").option("ref", "main").load(repository)``: a commit's tree as a catalog."""

    @classmethod
    def name(cls):
        return "cairn-git"

    def schema(self):
        return S.FILES

    def reader(self, schema):
        return _GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(GitSource)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """``scan_contents`` of files by path in a folder that all machines share: an archive is never held as a whole."""
    register(spark)
    return spark.read.format("cairn").option("contents", "true").load(path.removeprefix("file://"))


def split_sets(names: DataFrame) -> DataFrame:
    """Split volumes among ``names(name)``: stem, format, first, last, parts of each run of two or more that starts at 0 or 1.

    Of the readings decimal, letters and hexadecimal the one with most parts stays, the earlier one on a tie.
    """
    from cairn.functions import values
    from cairn.operators.ranges import volume_islands

    stem, suffix = F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1), F.lower(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2))
    parts = names.select(stem.alias("stem"), suffix.alias("suffix")).where("stem <> ''")
    reads = [("1-decimal", r"^\d+$", values.split_number("suffix")), ("0-letters", "^[a-z]+$", values.split_number("suffix")), ("2-hex", "^[0-9a-f]+$", F.conv("suffix", 16, 10).cast("long"))]
    rows = None
    for name, pattern, number in reads:
        one = parts.where(F.col("suffix").rlike(pattern)).select(F.concat_ws("|", "stem", F.length("suffix").cast("string"), F.lit(name)).alias("key"), number.alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    runs = volume_islands(rows, "key", "n").where("first in (0, 1) and parts >= 2")
    runs = runs.select(F.regexp_extract("key", r"^(.*)\|\d+\|\d-(\w+)$", 1).alias("stem"), F.regexp_extract("key", r"\|(\d-\w+)$", 1).alias("_format"), "first", "last", "parts")
    best = runs.groupBy("stem").agg(F.max_by(F.struct("_format", "first", "last", "parts"), F.struct(F.col("parts"), -F.substring("_format", 1, 1).cast("int"))).alias("r"))
    return best.select("stem", F.substring("r._format", 3, 20).alias("format"), "r.first", "r.last", "r.parts")


def joined_parts(files: DataFrame) -> DataFrame:
    """(archive_id, content): split volumes ``files(archive_id, part, content)`` put together in order."""
    return join_pieces(files.groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("parts")))


def join_pieces(rows: DataFrame) -> DataFrame:
    """(archive_id, content) of ``rows(archive_id, parts)``, each part's bytes copied once."""

    def run(batches):
        for batch in batches:
            whole = [b"".join(p["content"] or b"" for p in parts) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], names=["archive_id", "content"])

    return rows.select("archive_id", F.transform("parts", lambda p: F.struct(p["content"].alias("content"))).alias("parts")).mapInArrow(run, "archive_id string, content binary")
