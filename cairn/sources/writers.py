"""Sinks: catalogs as Parquet, archives as TAR or ZIP files."""

from __future__ import annotations

import io
import os
import re
import tarfile
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cairn.operators.versions import replace_on_key
from cairn.plans import schema as S
from cairn.sources.records import clean

MEMBERS = S._t("archive_id string, path string, name string, mode long, mtime double, uid long, gid long, linkname string, content binary")


def write_catalog(files: DataFrame, path: str, *, ordinal: str | None = None, minimum: int = 0, mode: str = "overwrite") -> bool:
    """Write a catalog clustered by archive and path; with ``ordinal`` the last inserted row of a key stays.

    A catalog of fewer than ``minimum`` rows is not written; the answer is whether it was.
    """
    rows = files if ordinal is None else replace_on_key(files, ordinal, ("archive_id", "path", "name", "version_key")).drop(ordinal)
    if minimum and rows.limit(minimum).count() < minimum:
        return False
    rows.repartitionByRange("archive_id", "path", "name").sortWithinPartitions("archive_id", "path", "name", "version_key").write.mode(mode).parquet(path)
    return True


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.FILES).parquet(path)


def upsert_metadata(stored: DataFrame, new: DataFrame, ordinal: str) -> DataFrame:
    """Key/value metadata after an upsert; of equal new keys the last by ``ordinal`` stays."""
    last = new.groupBy("key").agg(F.max_by("value", ordinal).alias("value"))
    return stored.join(last, "key", "left_anti").unionByName(last)


def version_triple(text: str) -> tuple[int, int, int]:
    parts = [int(p) if p.isdigit() else 0 for p in text.split("-")[0].split(".")]
    return tuple((parts + [0, 0, 0])[:3])


def nested_index(stored: DataFrame, new: DataFrame, key: str = "member_key", ordinal: str = "version") -> DataFrame:
    """Nested indexes after storing new ones: the latest by member key."""
    rows = stored.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_row")).select(key, "_row.*").select(*rows.columns)


class TarBuilder:
    """PAX archive of members in the order added."""

    def __init__(self, out: io.IOBase):
        self.tar = tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT)

    def add(self, path: str, name: str, mode: int, mtime: float, uid: int, gid: int, linkname: str, content: bytes) -> None:
        info = tarfile.TarInfo(f"{path}/{name}".lstrip("/"))
        kind = mode & 0xF000
        info.type = tarfile.DIRTYPE if kind == 0x4000 else tarfile.SYMTYPE if kind == 0xA000 else tarfile.REGTYPE
        info.mode, info.mtime, info.uid, info.gid, info.linkname = mode & 0o7777, mtime, uid, gid, linkname if kind == 0xA000 else ""
        info.size = len(content) if info.type == tarfile.REGTYPE else 0
        self.tar.addfile(info, io.BytesIO(content) if info.size else None)

    def close(self) -> None:
        self.tar.close()


class ZipBuilder:
    def __init__(self, out: io.IOBase):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)

    def add(self, path: str, name: str, mode: int, mtime: float, uid: int, gid: int, linkname: str, content: bytes) -> None:
        kind = mode & 0xF000
        info = zipfile.ZipInfo(f"{path}/{name}".lstrip("/") + ("/" if kind == 0x4000 else ""))
        info.external_attr = (mode & 0xFFFF) << 16 | (0x10 if kind == 0x4000 else 0)
        info.compress_type = zipfile.ZIP_DEFLATED
        self.zip.writestr(info, linkname.encode() if kind == 0xA000 else b"" if kind == 0x4000 else content)

    def close(self) -> None:
        self.zip.close()


def empty_archive(kind: str = "tar") -> bytes:
    """An archive without members: two zero blocks, the same in zstd, or an empty ZIP directory."""
    if kind == "zip":
        return b"PK\x05\x06" + bytes(18)
    if kind == "tar.zst":
        import zstandard

        return zstandard.ZstdCompressor().compress(bytes(1024))
    if kind != "tar":
        raise ValueError(f"no empty archive of kind {kind}")
    return bytes(1024)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "tar")

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        now, build, out, done = None, None, None, []

        def close():
            if build is not None:
                build.close()
                out.close()

        for r in rows:
            if build is None or r["archive_id"] != now:
                close()
                now = r["archive_id"]
                final = self.path + clean(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", now))  # with its folders: base names may be alike
                os.makedirs(os.path.dirname(final), exist_ok=True)
                temporary = f"{final}.{uuid.uuid4().hex}.part"
                done.append((temporary, final))
                out = open(temporary, "wb")
                build = ZipBuilder(out) if self.kind == "zip" else TarBuilder(out)
            build.add(r["path"] or "", r["name"], r["mode"] or 0x81A4, r["mtime"] or 0.0, r["uid"] or 0, r["gid"] or 0, r["linkname"] or "", bytes(r["content"] or b""))
        close()
        return _Written(done)

    def commit(self, messages):
        for m in messages:
            for temporary, final in m.files if m else ():
                os.replace(temporary, final)

    def abort(self, messages):
        for m in messages:
            for temporary, _ in m.files if m else ():
                if os.path.exists(temporary):
                    os.remove(temporary)


class ArchiveSink(DataSource):
    """``df.write.format("cairn-archive").option("kind", "tar" | "zip").save(folder)``: an archive for each archive_id."""

    @classmethod
    def name(cls):
        return "cairn-archive"

    def schema(self):
        return MEMBERS

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_archives(members: DataFrame, folder: str, kind: str = "tar") -> None:
    """Write members, all rows of an archive in one task and in path order, to a folder that all executors share."""
    members.sparkSession.dataSource.register(ArchiveSink)
    rows = members.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMBERS.fields])
    rows.repartition("archive_id").sortWithinPartitions("archive_id", "path", "name").write.format("cairn-archive").option("kind", kind).mode("append").save(folder)


def committed_members(base: DataFrame, plan: DataFrame, overlay: DataFrame) -> DataFrame:
    """Members of an archive after a commit: base contents without the plan's deletions, plus its appended overlay members."""
    gone = plan.where("action = 'delete'").select("path", "name")
    added = plan.where("action = 'append'").select("path", "name")
    return base.join(gone, ["path", "name"], "left_anti").unionByName(overlay.join(added, ["path", "name"], "left_semi"), allowMissingColumns=True)
