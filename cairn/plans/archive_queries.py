"""Registered queries over archives that are made of the driver's tables, with their SQL twins.

Forty documents make an archive; archives are a column of bytes, as ``binaryFile``
reads them, or are packed by the pass that reads them, so nothing is written to disk
unless a query is about files.
"""

from __future__ import annotations

import tarfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import html, paths, values
from cairn.operators import indexes, layers, overlays, ranges, unions, versions
from cairn.plans import builders as B
from cairn.plans import fixtures as fx
from cairn.plans.registry import _query
from cairn.plans.session import shared_dir
from cairn.sources import archives, writers
from cairn.streaming import idle

EACH = 40
_ID = f"'a' || (doc_id // {EACH})"
_TEXT = "coalesce(text, '')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _listed(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(archive_id, content): the documents of each archive, not yet packed."""
    return _documents(spark, sf_dir).where(where).groupBy(F.concat(F.lit("a"), F.floor(F.col("doc_id") / EACH).cast("string")).alias("archive_id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("content"))


def _packer(build, name=lambda i: f"{i}.txt"):
    """The bytes of an archive of listed documents: ``build([(name, bytes)])``."""
    return lambda files: build([(name(x["doc_id"].as_py()), x["text"].as_py().encode()) for x in files])


def _archives(spark: SparkSession, sf_dir: str, build, name=lambda i: f"{i}.txt", where: str = "true") -> DataFrame:
    """(archive_id, content): the bytes of each archive."""
    pack = _packer(build, name)

    def run(batches):
        made = ((a, pack(files)) for batch in batches for a, files in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        return archives.in_batches(made, archives.FILE)

    return _listed(spark, sf_dir, where).mapInArrow(run, "archive_id string, content binary")


def _files(spark: SparkSession, sf_dir: str, suffix: str, build, where: str = "true") -> DataFrame:
    """(archive_id, content): a file of its own for each document."""
    rows = _documents(spark, sf_dir).where(where).select(F.concat(F.col("doc_id").cast("string"), F.lit(f".txt.{suffix}")).alias("archive_id"), "text")

    def run(batches):
        made = ((a, build(t.as_py().encode())) for batch in batches for a, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        return archives.in_batches(made, archives.FILE)

    return rows.mapInArrow(run, "archive_id string, content binary")


def _digest(contents: DataFrame) -> DataFrame:
    return contents.select("archive_id", "path", "name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def _content_sql(path: str = "''", name: str = "doc_id || '.txt'", where: str = "true") -> str:
    return f"SELECT {_ID} AS archive_id, {path} AS path, {name} AS name, octet_length(encode({_TEXT}))::BIGINT AS size, sha256({_TEXT}) AS sha256 FROM documents WHERE {where}"


# formats: every member's bytes ---------------------------------------------------

_FORMATS = {
    "tar_pax": (B.tar, {}, {}),
    "tar_gnu": (lambda files: B.tar(files, tarfile.GNU_FORMAT), {}, {}),
    "tar_ustar": (lambda files: B.tar(files, tarfile.USTAR_FORMAT), {"name": lambda i: f"./d//{i}.txt"}, {"path": "'/d'"}),
    "zip_deflated": (B.zip_, {"name": lambda i: f"d/{i}.txt"}, {"path": "'/d'"}),
    "zip_stored": (lambda files: B.zip_(files, zipfile.ZIP_STORED), {}, {}),
    "zip_bzip2": (lambda files: B.zip_(files, zipfile.ZIP_BZIP2), {}, {}),
    "ar": (B.ar, {"name": lambda i: f"a_name_of_more_than_sixteen_bytes_{i}.txt"}, {"name": "'a_name_of_more_than_sixteen_bytes_' || doc_id || '.txt'"}),
    "cpio": (B.cpio, {}, {}),
    "iso9660": (B.iso, {"name": lambda i: f"{i}.TXT"}, {"name": "doc_id || '.TXT'"}),
    "warc": (B.warc, {"name": str}, {"path": "'/h'", "name": "doc_id::VARCHAR"}),
    "xar": (B.xar, {}, {}),
    "cab": (B.cab, {"where": "text <> ''"}, {"where": "text <> ''"}),
    "asar": (B.asar, {}, {}),
    "sqlar": (B.sqlar, {}, {}),
    "squashfs": (B.squashfs, {}, {}),
    "fat": (B.fat, {"name": lambda i: f"{i}.TXT"}, {"name": "doc_id || '.TXT'"}),
    "pdf": (B.pdf, {}, {"path": "'/attachments'"}),
    "seven_zip": (B.seven_zip, {"where": "text <> ''"}, {"where": "text <> ''"}),
}


def _add_format(name: str, build, made: dict, sql: dict) -> None:
    def query(spark, sf_dir):
        more = dict(made)
        return _digest(archives.scan_contents(_listed(spark, sf_dir, more.pop("where", "true")), load=_packer(build, **more)))

    query.__name__ = f"format_{name}"
    _query(_content_sql(**sql))(query)


for _name, (_build, _made, _sql) in _FORMATS.items():
    _add_format(_name, _build, _made, _sql)


# codecs: a compressed file is one member without the suffix ------------------------


def _add_codec(codec: str, suffix: str, build) -> None:
    def query(spark, sf_dir):
        return _digest(archives.scan_contents(_files(spark, sf_dir, suffix, build)))

    query.__name__ = f"codec_{codec}"
    _query(f"SELECT doc_id || '.txt.{suffix}' AS archive_id, '' AS path, doc_id || '.txt' AS name, octet_length(encode({_TEXT}))::BIGINT AS size, sha256({_TEXT}) AS sha256 FROM documents")(query)


for _codec, (_suffix, _pack) in B.CODECS.items():
    _add_codec(_codec, _suffix, _pack)


_BLOCKS_SQL = f"""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text <> '')
SELECT doc_id || '.txt.{{suffix}}' AS archive_id, unnest(generate_series(0, n - 1, 1000))::BIGINT AS data_offset, false AS is_sentinel FROM d UNION ALL SELECT doc_id || '.txt.{{suffix}}', n::BIGINT, true FROM d"""


def _add_blocks(name: str, suffix: str, build) -> None:
    def query(spark, sf_dir):
        return archives.scan_blocks(_files(spark, sf_dir, suffix, build, where="text <> ''")).select("archive_id", "data_offset", "is_sentinel")

    query.__name__ = f"blocks_{name}"
    _query(_BLOCKS_SQL.format(suffix=suffix))(query)


_add_blocks("zstd", "zst", lambda d: B.in_blocks(B.zstd, d))
_add_blocks("zstd_seek_table", "zst", B.seekable_zstd)
_add_blocks("lzip", "lz", lambda d: B.in_blocks(B.lzip, d))
_add_blocks("bzip2", "bz2", lambda d: B.in_blocks(B.CODECS["bzip2"][1], d))
_add_blocks("gzip", "gz", lambda d: B.in_blocks(B.CODECS["gzip"][1], d))
_add_blocks("lz4", "lz4", lambda d: B.lz4(d, 1000))
_add_blocks("xz", "xz", lambda d: B.in_blocks(B.CODECS["xz"][1], d))


@_query(f"SELECT {_ID} || '.tar.gz' AS archive_id, '/d' AS path, doc_id || '.txt' AS name, octet_length(encode({_TEXT}))::BIGINT AS size, sha256({_TEXT}) AS sha256 FROM documents")
def tar_in_codec(spark, sf_dir):
    """A TAR inside a compressed file is told from a compressed file."""
    made = _archives(spark, sf_dir, lambda files: B.CODECS["gzip"][1](B.tar(files)), name=lambda i: f"d/{i}.txt")
    return _digest(archives.scan_contents(made.withColumn("archive_id", F.concat("archive_id", F.lit(".tar.gz")))))


# TAR ---------------------------------------------------------------------------


@_query(f"SELECT {_ID} AS archive_id, '' AS path, doc_id || '.txt' AS name, octet_length(encode({_TEXT}))::BIGINT + 8 AS size, sha256(unhex('000000' || hex(encode({_TEXT})) || '0000000000')) AS sha256 FROM documents")
def tar_sparse(spark, sf_dir):
    return _digest(archives.scan_contents(_archives(spark, sf_dir, B.sparse_tar)))


@_query(f"""SELECT {_ID} AS archive_id, kind, sum(n)::BIGINT AS bytes, count(*) AS segments FROM (SELECT doc_id, unnest(['hole', 'data', 'hole']) AS kind, unnest([3, octet_length(encode({_TEXT})), 5]) AS n FROM documents) WHERE n > 0 GROUP BY ALL""")
def tar_sparse_segments(spark, sf_dir):
    return archives.scan_segments(_archives(spark, sf_dir, B.sparse_tar)).groupBy("archive_id", "kind").agg(F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("segments"))


@_query(f"SELECT {_ID} AS archive_id, '/d' AS path, doc_id || '.txt' AS name FROM documents WHERE doc_id % 3 = 0")
def tar_incremental(spark, sf_dir):
    """Names that the second dump of a directory no longer lists."""
    made = _archives(spark, sf_dir, lambda files: B.dump_tar([n for n, _ in files], [n for n, _ in files if int(n[:-4]) % 3]))
    return archives.scan(made).where("is_tombstone").select("archive_id", "path", "name")


@_query(f"SELECT {_ID} AS archive_id, '/in.tar/deep.tar/d' AS path, doc_id || '.txt' AS name, octet_length(encode({_TEXT}))::BIGINT AS size, sha256({_TEXT}) AS sha256 FROM documents")
def tar_nested(spark, sf_dir):
    """TARs in a TAR, read in place by their offsets."""
    made = _archives(spark, sf_dir, lambda files: B.tar([("in.tar", B.tar([("deep.tar", B.tar(files))]))]), name=lambda i: f"d/{i}.txt")
    return _digest(archives.scan_contents(made, recursive=True).where("name like '%.txt'"))


@_query(f"SELECT {_ID} AS archive_id, key, value FROM (SELECT doc_id, unnest(['user.id', 'user.len']) AS key, unnest([doc_id::VARCHAR, octet_length(encode({_TEXT}))::VARCHAR]) AS value FROM documents)")
def tar_attributes(spark, sf_dir):
    """Extended attributes in both spellings."""
    import base64

    def headers(name, data):
        return {"SCHILY.xattr.user.id": name[:-4], "LIBARCHIVE.xattr.user%2elen": base64.b64encode(str(len(data)).encode()).decode().rstrip("=")}

    rows = archives.scan_attributes(_archives(spark, sf_dir, lambda files: B.tar(files, headers=headers)))
    return rows.select("archive_id", "key", F.col("value").cast("string").alias("value"))


@_query(f"SELECT {_ID} AS archive_id, '/' || repeat('long', 60) AS path, doc_id || '.txt' AS name, (doc_id + 0.5)::DOUBLE AS mtime, 3000000::BIGINT AS uid FROM documents")
def tar_pax_records(spark, sf_dir):
    """Long names, broken seconds and great numbers, which only PAX records hold."""
    made = _archives(spark, sf_dir, lambda files: B.tar(files, headers=lambda n, d: {"mtime": f"{n.rpartition('/')[2][:-4]}.5", "uid": "3000000"}), name=lambda i: f"{'long' * 60}/{i}.txt")
    return archives.scan(made).select("archive_id", "path", "name", "mtime", "uid")


@_query(f"SELECT {_ID} AS archive_id, '' AS path, doc_id || '.txt' AS name, 3::BIGINT AS versions FROM documents")
def tar_versions(spark, sf_dir):
    """A member that is stored three times."""
    return versions.version_count(archives.scan(_archives(spark, sf_dir, lambda files: B.tar(files * 3))), keys=("archive_id", "path", "name"))


@_query(f"SELECT {_ID} AS archive_id, '/' AS prefix, doc_id || '.txt' AS name FROM documents")
def tar_ignore_zeros(spark, sf_dir):
    """Two TARs one after the other."""
    made = _archives(spark, sf_dir, lambda files: B.tar(files[: len(files) // 2]) + B.tar(files[len(files) // 2 :]))
    return archives.scan(made, ignore_zeros=True).select("archive_id", F.lit("/").alias("prefix"), "name")


@_query(f"SELECT {_ID} AS archive_id, doc_id || '.txt' AS name, 3000000 + doc_id AS uid, 2500000::BIGINT AS gid FROM documents")
def tar_base256(spark, sf_dir):
    """Numbers too great for octal fields, in base 256."""
    made = _archives(spark, sf_dir, lambda files: B.tar(files, tarfile.GNU_FORMAT, owner=lambda name: (3000000 + int(name[:-4]), 2500000)))
    return archives.scan(made).select("archive_id", "name", "uid", "gid")


@_query(f"SELECT {_ID} AS archive_id, 'é' || doc_id || '.txt' AS name FROM documents")
def tar_encoding(spark, sf_dir):
    """Names in another encoding."""
    made = _archives(spark, sf_dir, lambda files: B.tar(files, tarfile.USTAR_FORMAT, encoding="latin-1"), name=lambda i: f"é{i}.txt")
    return archives.scan(made, encoding="latin-1").select("archive_id", "name")


@_query(_content_sql())
def zip_password(spark, sf_dir):
    return _digest(archives.scan_contents(_archives(spark, sf_dir, lambda files: B.locked_zip(files, b"open")), password="open"))


# other containers ----------------------------------------------------------------


@_query(f"SELECT {_ID} AS archive_id, printf('stream-%08x.ogg', doc_id) AS name, octet_length(encode({_TEXT}))::BIGINT + 28 * greatest(1, ceil(octet_length(encode({_TEXT})) / 200))::BIGINT AS size FROM documents")
def format_ogg(spark, sf_dir):
    return archives.scan(_archives(spark, sf_dir, B.ogg, name=str)).select("archive_id", "name", "size")


@_query(f"SELECT {_ID} AS archive_id, 'txt' AS extension, sha256(text) AS sha256, count(*) AS times FROM documents WHERE text <> '' GROUP BY ALL")
def format_html(spark, sf_dir):
    rows = archives.scan_contents(_archives(spark, sf_dir, B.html))
    return rows.groupBy("archive_id", F.regexp_extract("name", r"\.(\w+)$", 1).alias("extension"), F.sha2("content", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("times"))


@_query(f"SELECT {_ID} AS archive_id, '/d' AS path, doc_id || '.txt' AS name, octet_length(encode({_TEXT}))::BIGINT AS size, 7.0::DOUBLE AS mtime, 1::BIGINT AS uid, 'index' AS backend FROM documents")
def format_index(spark, sf_dir):
    return archives.scan(_archives(spark, sf_dir, B.index_file)).select("archive_id", "path", "name", "size", "mtime", "uid", "backend")


_KINDS = [("7z", B.seven_zip), ("zip", B.zip_), ("asar", B.asar), ("ar", B.ar), ("cpio", B.cpio), ("iso", B.iso), ("warc", B.warc), ("xar", B.xar), ("cab", B.cab), ("sqlar", B.sqlar), ("squashfs", B.squashfs), ("fat", B.fat), ("pdf", B.pdf), ("html", B.html), ("tar", B.tar)]


@_query(f"WITH a AS (SELECT {_ID} AS archive_id, count(*) AS members, count(DISTINCT text) AS texts, [{', '.join(repr(k) for k, _ in _KINDS)}] AS kinds FROM documents WHERE text <> '' GROUP BY 1) SELECT archive_id, unnest(kinds) AS backend, members FROM a")
def format_detection(spark, sf_dir):
    """The back end by magic numbers, whatever the name."""
    out = None
    for kind, build in _KINDS:
        one = archives.scan(_listed(spark, sf_dir, "text <> ''"), load=_packer(build, lambda i: f"{i}.TXT")).groupBy("archive_id", "backend").agg(F.count(F.lit(1)).alias("members"))
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"SELECT DISTINCT {_ID} || '.tar.gz' AS archive_id FROM documents WHERE (doc_id // {EACH}) % 3 = 0")
def damaged_archives(spark, sf_dir):
    """Cut archives are told of and do not end the scan of the others."""
    made = _archives(spark, sf_dir, lambda files: B.CODECS["gzip"][1](B.tar(files)))
    cut = made.select(F.concat("archive_id", F.lit(".tar.gz")).alias("archive_id"), F.when(F.substring("archive_id", 2, 20).cast("long") % 3 == 0, F.substring("content", F.lit(1), (F.octet_length("content") / 2).cast("int"))).otherwise(F.col("content")).alias("content"))
    return archives.scan_damage(cut).where("path is null").select("archive_id").distinct()


@_query(f"SELECT {_ID} AS archive_id, '' AS path, doc_id || '.txt' AS name, octet_length(encode({_TEXT}))::BIGINT AS size, sha256({_TEXT}) AS sha256 FROM documents WHERE (doc_id // {EACH}) % 3 <> 0")
def undamaged_contents(spark, sf_dir):
    """What is left where every third ZIP has lost its directory."""
    made = _archives(spark, sf_dir, B.zip_)
    cut = made.withColumn("content", F.when(F.substring("archive_id", 2, 20).cast("long") % 3 == 0, F.substring("content", F.lit(1), (F.octet_length("content") - 30).cast("int"))).otherwise(F.col("content")))
    return _digest(archives.scan_contents(cut))


@_query(f"""SELECT {_ID} AS archive_id, name, key, value FROM (SELECT doc_id, doc_id || '.txt' AS name, unnest(['user.md5', 'user.sha1', 'user.sha256']) AS key, unnest([md5(text), sha1(text), sha256(text)]) AS value FROM documents WHERE text <> '')""")
def member_digests(spark, sf_dir):
    """Content hashes as attributes, several in one pass; names as users write them."""
    made = _archives(spark, sf_dir, B.zip_, where="text <> ''")
    keys = archives.scan(made).select("archive_id", "name", "version_key")
    return archives.scan_digests(made, "SHA-256, md5,sha_1,md5").join(keys, ["archive_id", "version_key"]).select("archive_id", "name", "key", F.col("value").cast("string").alias("value"))


@_query(f"SELECT {_ID} AS archive_id, '/in.zip/d' AS path, doc_id || '.txt' AS name FROM documents UNION ALL SELECT DISTINCT {_ID}, '', 'in.zip' FROM documents")
def automount_zip_in_tar(spark, sf_dir):
    """Nested archives of another format, expanded in place."""
    made = _archives(spark, sf_dir, lambda files: B.tar([("in.zip", B.zip_(files))]), name=lambda i: f"d/{i}.txt")
    whole = layers.automount(archives.scan(made), archives.open_nested(archives.scan_contents(made)))
    return whole.select(F.regexp_extract("archive_id", "^(a[0-9]+)", 1).alias("archive_id"), "path", "name")


@_query("SELECT doc_id || '.txt' AS archive_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def split_volumes_joined(spark, sf_dir):
    """Three volumes of each file put together in order."""
    text = F.encode("text", "UTF-8")
    third = F.ceil(F.octet_length(text) / 3).cast("int")
    rows = _documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("archive_id"), text.alias("raw"), third.alias("n"), F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("part"))
    parts = rows.select("archive_id", F.col("part").cast("long").alias("part"), F.substring("raw", F.col("part") * F.col("n") + 1, F.col("n")).alias("content"))
    return archives.joined_parts(parts).select("archive_id", F.sha2("content", 256).alias("sha256"))


@_query("SELECT 'v' || p_partkey AS stem, CASE WHEN p_partkey % 2 = 0 THEN 'decimal' ELSE 'letters' END AS format, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS first, CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 5 ELSE p_partkey % 5 END::BIGINT AS last, (1 + p_partkey % 5)::BIGINT AS parts FROM part WHERE p_partkey % 5 > 0")
def split_volume_sets(spark, sf_dir):
    """Volumes found by the numbers or letters of their suffixes."""
    k = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").select(k, F.explode(F.sequence(F.lit(0), (k % 5).cast("int"))).alias("i"))
    suffix = F.when(k % 2 == 0, F.lpad((F.col("i") + 1).cast("string"), 3, "0")).otherwise(values.number_letters("i", 2))
    return archives.split_sets(rows.select(F.concat(F.lit("v"), k.cast("string"), F.lit("."), suffix).alias("name")))


# sinks ---------------------------------------------------------------------------


def _written(spark, sf_dir, kind: str) -> DataFrame:
    """Archives of the same base name in several folders, written, read by path and compared."""
    members = _documents(spark, sf_dir).select(F.concat((F.col("doc_id") % 4).cast("string"), F.lit(f"/out.{kind}")).alias("archive_id"), F.lit("/d").alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit(fx.REG).alias("mode"), F.lit(1000.0).alias("mtime"), F.lit(1).alias("uid"), F.lit(2).alias("gid"), F.lit("").alias("linkname"), F.encode("text", "UTF-8").alias("content"))
    folder = f"{shared_dir(spark)}/cairn-out-{uuid.uuid4().hex}"
    writers.write_archives(members, folder.removeprefix("file://"), kind)
    return _digest(archives.read_contents(spark, folder)).withColumn("archive_id", F.regexp_extract("archive_id", r"/([^/]+/[^/]+)$", 1))


_WRITTEN_SQL = "SELECT doc_id % 4 || '/out.{}' AS archive_id, '/d' AS path, doc_id || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents"


@_query(_WRITTEN_SQL.format("tar"))
def write_tar(spark, sf_dir):
    return _written(spark, sf_dir, "tar")


@_query(_WRITTEN_SQL.format("zip"))
def write_zip(spark, sf_dir):
    return _written(spark, sf_dir, "zip")


@_query(f"SELECT {_ID} AS archive_id, doc_id || '.txt' AS name, octet_length(encode({_TEXT}))::BIGINT AS size FROM documents")
def write_catalog(spark, sf_dir):
    """A catalog written with replacement, where each row is there twice, and read again."""
    rows = archives.scan(_archives(spark, sf_dir, B.tar))
    twice = rows.withColumn("size", F.lit(-1).cast("long")).withColumn("at", F.lit(1)).unionByName(rows.withColumn("at", F.lit(2)))
    place = f"{shared_dir(spark)}/cairn-catalog-{uuid.uuid4().hex}"
    writers.write_catalog(twice, place, ordinal="at")
    return writers.read_catalog(spark, place).select("archive_id", "name", "size")


@_query("SELECT kind, 0::BIGINT AS members FROM (SELECT unnest(['tar', 'zip', 'tar.zst']) AS kind)")
def write_empty(spark, sf_dir):
    """Archives without members are read as such."""
    kinds = ["tar", "zip", "tar.zst"]
    made = spark.createDataFrame([(k, writers.empty_archive(k)) for k in kinds], "archive_id string, content binary")
    found = archives.scan(made).where("backend <> 'file'").groupBy("archive_id").agg(F.count(F.lit(1)).alias("n"))
    return made.join(found, "archive_id", "left").select(F.col("archive_id").alias("kind"), F.coalesce("n", F.lit(0).cast("long")).alias("members"))


@_query("SELECT 'k' || c_nationkey AS key, arg_max(c_name, c_custkey) AS value FROM customer GROUP BY c_nationkey")
def metadata_upsert(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_name").alias("value"), "c_custkey")
    stored = spark.createDataFrame([("k1", "old"), ("k2", "old")], "key string, value string")
    return writers.upsert_metadata(stored, rows, "c_custkey")


@_query("SELECT '/d/' || c_nationkey AS member_key, max(c_custkey) AS version, arg_max(c_name, c_custkey) AS body FROM customer GROUP BY c_nationkey")
def nested_index_store(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("/d/"), F.col("c_nationkey").cast("string")).alias("member_key"), F.col("c_custkey").alias("version"), F.col("c_name").alias("body"))
    return writers.nested_index(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"))


@_query("SELECT CASE WHEN k % 2 = 0 THEN '/out' || (k // 2) ELSE '' END AS path, CASE WHEN k % 2 = 0 THEN 'a.tar' ELSE 'out' || (k // 2) END AS name, 'folder' AS backend FROM (SELECT unnest(generate_series(0, 7)) AS k)")
def folder_source(spark, sf_dir):
    """A folder as a catalog."""
    archives.register(spark)
    return spark.read.format("cairn-folder").load(_folder(spark, sf_dir)).select("path", "name", "backend")


@_query("SELECT 'out' || (doc_id % 4) AS archive, doc_id || '.txt' AS name FROM documents")
def path_source(spark, sf_dir):
    """Archives opened by path, a partition for each."""
    archives.register(spark)
    return spark.read.format("cairn").load(_folder(spark, sf_dir)).select(F.regexp_extract("archive_id", "/(out[0-9])/", 1).alias("archive"), "name")


def _folder(spark, sf_dir) -> str:
    members = _documents(spark, sf_dir).select(F.concat(F.lit("out"), (F.col("doc_id") % 4).cast("string"), F.lit("/a.tar")).alias("archive_id"), F.lit("").alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit(fx.REG).alias("mode"), F.lit(1000.0).alias("mtime"), F.lit(1).alias("uid"), F.lit(2).alias("gid"), F.lit("").alias("linkname"), F.encode("text", "UTF-8").alias("content"))
    folder = f"{shared_dir(spark)}/cairn-out-{uuid.uuid4().hex}".removeprefix("file://")
    writers.write_archives(members, folder, "tar")
    return folder


@_query("SELECT 'a' || (user_id % 50) AS archive_id, 1::BIGINT AS map, event_id AS data_offset FROM events WHERE user_id % 50 % 2 = 1 UNION ALL SELECT 'a' || (user_id % 50), 2, event_id + 1 FROM events WHERE user_id % 50 % 2 = 0 AND event_type = 'view'")
def block_map_replace(spark, sf_dir):
    """Maps of the archives that have new ones are replaced as a whole."""
    e = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("a"), (F.col("user_id") % 50).cast("string")).alias("archive_id"), "event_id", "event_type", "user_id")
    stored = e.select("archive_id", F.lit(1).cast("long").alias("map"), F.col("event_id").alias("data_offset"))
    new = e.where("user_id % 50 % 2 = 0 and event_type = 'view'").select("archive_id", F.lit(2).cast("long").alias("map"), (F.col("event_id") + 1).alias("data_offset"))
    return indexes.replace_blocks(stored, new)


# catalogs and overlays -------------------------------------------------------------


@_query(f"WITH {fx.ORDERS_SQL} SELECT path, name, max(version_key) AS version_key, arg_max(size, version_key) AS size FROM files GROUP BY path, name")
def read_cookie(spark, sf_dir):
    files = fx.orders(spark, sf_dir).select("path", "name", "version_key", "size", F.lit("a").alias("archive_id"), F.col("version_key").alias("data_offset"), F.lit(False).alias("is_sparse"))
    return versions.open_cookie(files).select("path", "name", "cookie.version_key", "cookie.size")


@_query(f"WITH {fx.SOURCES_SQL} SELECT DISTINCT path, source_idx::BIGINT AS source_idx FROM sources")
def source_pruning(spark, sf_dir):
    rows = fx.sources(spark, sf_dir)
    asked = spark.createDataFrame([("/n",), ("/absent",)], "path string")
    return unions.prune_sources(asked, rows).select("path", F.col("source_idx").cast("long").alias("source_idx"))


_MOVES = "moves AS (SELECT DISTINCT '/c/' || c_custkey AS path, '1-URGENT' AS name, '/moved' AS new_path, 'c' || c_custkey AS new_name FROM customer WHERE c_custkey % 3 = 0)"


def _view(spark, sf_dir):
    files = versions.latest(fx.orders(spark, sf_dir).select("path", "name", "version_key", "size", "mode"))
    overlay = files.where("false").withColumn("deleted", F.lit(False))
    return files, overlay


@_query(f"""WITH {fx.ORDERS_SQL}, base AS (SELECT path, name, max(version_key) AS version_key, arg_max(size, version_key) AS size, arg_max(mode, version_key) AS mode FROM files GROUP BY path, name), {_MOVES},
hit AS (SELECT b.*, m.new_path, m.new_name FROM base b JOIN moves m USING (path, name) WHERE (b.mode & 61440) <> 16384)
SELECT path, name, size FROM base b WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.path = b.path AND h.name = b.name) UNION ALL SELECT new_path, new_name, size FROM hit""")
def overlay_rename(spark, sf_dir):
    base, overlay = _view(spark, sf_dir)
    moves = fx.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("path"), F.lit("1-URGENT").alias("name"), F.lit("/moved").alias("new_path"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("new_name"))
    return overlays.apply_overlay(base, overlays.rename(overlay, base, moves)).select("path", "name", "size")


@_query(f"""WITH {fx.ORDERS_SQL}, base AS (SELECT path, name, arg_max(size, version_key) AS size FROM files GROUP BY path, name)
SELECT path, name, CASE WHEN name = '1-URGENT' THEN 7 ELSE size END::BIGINT AS size FROM base""")
def overlay_mark_present(spark, sf_dir):
    base, overlay = _view(spark, sf_dir)
    changed = base.where("name = '1-URGENT'").withColumn("size", F.lit(7).cast("long"))
    return overlays.apply_overlay(base, overlays.mark_present(overlay, changed)).select("path", "name", "size")


@_query("SELECT DISTINCT '' AS path, 'c' AS name FROM orders UNION SELECT DISTINCT '/c', c_custkey::VARCHAR FROM customer JOIN orders ON o_custkey = c_custkey")
def directories_not_empty(spark, sf_dir):
    """Directories that may not be removed."""
    base, _ = _view(spark, sf_dir)
    view = base.select("path", "name").unionByName(base.select(F.lit("/c").alias("path"), F.substring("path", 4, 20).alias("name")))
    asked = fx.table(spark, sf_dir, "customer").select(F.lit("/c").alias("path"), F.col("c_custkey").cast("string").alias("name")).unionByName(spark.createDataFrame([("", "c"), ("", "x")], "path string, name string"))
    return overlays.non_empty_directories(view, asked)


@_query(f"""WITH {fx.ORDERS_SQL}, base AS (SELECT path, name, arg_max(size, version_key) AS size, arg_max(mode, version_key) AS mode FROM files GROUP BY path, name)
SELECT path, name, CASE WHEN name = '2-HIGH' AND (mode & 61440) = 32768 THEN 3 ELSE size END::BIGINT AS size FROM base""")
def overlay_truncate(spark, sf_dir):
    base, overlay = _view(spark, sf_dir)
    return overlays.apply_overlay(base, overlays.truncate(overlay, base, base.where("name = '2-HIGH'").select("path", "name", F.lit(3).cast("long").alias("size")))).select("path", "name", "size")


@_query("SELECT '' AS path, r_name AS name FROM region WHERE r_regionkey > 0 UNION ALL SELECT '/' || r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '', r_name FROM region WHERE r_regionkey = 0")
def overlay_make_members(spark, sf_dir):
    """New directories and files; what exists or has no directory above it is refused."""
    region, nation = fx.table(spark, sf_dir, "region"), fx.table(spark, sf_dir, "nation")
    base = region.where("r_regionkey = 0").select(F.lit("").alias("path"), F.col("r_name").alias("name"), F.lit(fx.DIR).cast("long").alias("mode"), F.lit(0).cast("long").alias("size"))
    overlay = base.where("false").withColumn("deleted", F.lit(False))
    folders = region.select(F.lit("").alias("path"), F.col("r_name").alias("name"), F.lit(fx.DIR).cast("long").alias("mode"), F.lit(0).cast("long").alias("size"))
    files = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat(F.lit("/"), "r_name").alias("path"), F.col("n_name").alias("name"), F.lit(fx.REG).cast("long").alias("mode"), F.lit(1).cast("long").alias("size"))
    lost = nation.select(F.lit("/nowhere").alias("path"), F.col("n_name").alias("name"), F.lit(fx.REG).cast("long").alias("mode"), F.lit(1).cast("long").alias("size"))
    return overlays.apply_overlay(base, overlays.make_members(overlay, base, folders.unionByName(files).unionByName(lost))).select("path", "name")


@_query("""WITH o AS (SELECT '/u/' || user_id AS path, 'f' || event_id AS name, (event_id % 100)::DOUBLE AS mtime FROM events)
SELECT 'append' AS action, path, name FROM o WHERE mtime <= 90 UNION ALL
SELECT DISTINCT 'delete', '/u', user_id::VARCHAR FROM events e WHERE NOT EXISTS (SELECT 1 FROM events h WHERE h.user_id = e.user_id AND h.event_id % 100 > 90)""")
def overlay_commit_idle(spark, sf_dir):
    """Files that changed a moment ago, and deletions above them, wait."""
    e = fx.table(spark, sf_dir, "events")
    live = e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"), (F.col("event_id") % 100).cast("double").alias("mtime"), F.lit(fx.REG).cast("long").alias("mode"), F.lit(False).alias("deleted"))
    gone = e.select(F.lit("/u").alias("path"), F.col("user_id").cast("string").alias("name"), F.lit(0.0).alias("mtime"), F.lit(fx.DIR).cast("long").alias("mode"), F.lit(True).alias("deleted")).distinct()
    return overlays.commit_plan(live.where("false").drop("deleted"), live.unionByName(gone), now=100.0, idle=10.0)


@_query("SELECT DISTINCT '/u' AS path, user_id::VARCHAR AS name FROM events WHERE user_id % 2 = 1")
def hot_parents_kept(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    deletions = e.select(F.lit("/u").alias("path"), F.col("user_id").cast("string").alias("name")).distinct()
    return idle.keep_hot_parents(deletions, e.where("user_id % 2 = 0").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.lit("f").alias("name")))


@_query("SELECT event_id, event_id // 300 AS generation FROM events WHERE event_id // 300 = (SELECT max(event_id // 300) FROM events)")
def newest_generation(spark, sf_dir):
    return idle.current_generation(fx.table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 300).cast("long").alias("generation")))


# functions -------------------------------------------------------------------------


@_query("""SELECT doc_id, '<a> & "' || lang || '" A€' || chr(65 + (doc_id % 26)::INT) || ' &#xd;' AS text FROM documents""")
def html_entities(spark, sf_dir):
    raw = F.concat(F.lit("&lt;a&gt; &amp; &quot;"), "lang", F.lit("&#34; &amp;#65;&#8364;&#0"), (65 + F.col("doc_id") % 26).cast("string"), F.lit(";&#55296; &#xd;"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", html.unescape(raw).alias("text"))


@_query("""SELECT page_id, i::BIGINT AS place, uri FROM (SELECT page_id, unnest([0, 1, 2, 3]) AS i, unnest(['data:image/svg+xml;utf8,<svg w=''1'' x="(', 'data:text/css,a(b) c', 'data:,' || page_id || ' ', 'data:image/x-icon;base64,AAAA']) AS uri FROM pages) WHERE i > 0
UNION ALL SELECT page_id, 0, 'data:image/svg+xml;utf8,<svg w=(' || page_id || ')>' FROM pages""")
def data_uri_places(spark, sf_dir):
    """Each URI ends where its own form does; a bracket before ``data:`` alone is no form."""
    k = F.col("page_id").cast("string")
    page = F.concat(F.lit('(data:no) <img src="data:image/svg+xml;utf8,<svg w=('), k, F.lit(""")>"><a x='data:text/css,a(b) c'><p style="x:url( data:,"""), k, F.lit(""" )"><i src="data:image/x-icon;base64,AAAA">"""))
    rows = fx.table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.data_uris(page)).alias("place", "uri"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "uri")


_TYPES = [("image/x-icon", "ico"), ("application/xhtml+xml", "xhtml"), ("application/octet-stream", ""), ("text/JavaScript", "js"), ("image/jpg", "jpg"), ("image/webp", "webp"), ("font/ttf", "ttf"), ("plain", "")]


@_query(f"SELECT page_id, ([{', '.join(repr(k) for k, _ in _TYPES)}])[page_id % 8 + 1] AS kind, ([{', '.join(repr(e) for _, e in _TYPES)}])[page_id % 8 + 1] AS extension FROM pages")
def media_extensions(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in _TYPES]), (F.col("page_id") % 8 + 1).cast("int"))
    return fx.table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), html.media_extension(kind).alias("extension"))


_STEMS = [("a.zip.gz", "a.zip", "a.zip"), ("a.tar.zstd", "a", "a.tar"), ("a.TGZ", "a", "a.tar"), ("a.snap", "a", "a.snap"), ("a.taz", "a.taz", "a.tar"), ("a.a", "a", "a.a"), ("a.lzop", "a.lzop", "a"), (".tar", ".tar", ".tar"), ("a.sqfs", "a", "a.sqfs"), ("a.txt.Z", "a.txt.Z", "a.txt")]


@_query(f"SELECT p_partkey, unnest([{', '.join(repr(a) for a, _, _ in _STEMS)}]) AS name, unnest([{', '.join(repr(b) for _, b, _ in _STEMS)}]) AS shown, unnest([{', '.join(repr(c) for _, _, c in _STEMS)}]) AS decoded FROM part WHERE p_partkey <= 20")
def suffix_forms(spark, sf_dir):
    """Names without their archive suffix, and of the decoded file."""
    rows = fx.table(spark, sf_dir, "part").where("p_partkey <= 20").select("p_partkey", F.explode(F.array(*[F.lit(a) for a, _, _ in _STEMS])).alias("name"))
    return rows.select("p_partkey", "name", paths.strip_archive("name").alias("shown"), paths.strip_compression("name").alias("decoded"))


@_query("SELECT o_orderkey, '/' || o_orderpriority || '/' || o_custkey AS at_two, '/' || o_orderpriority AS at_one, '/' AS at_zero FROM orders")
def path_depths(spark, sf_dir):
    path = F.concat(F.lit("/"), "o_orderpriority", F.lit("/"), F.col("o_custkey").cast("string"), F.lit("/x/y"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", paths.at_depth(path, 2).alias("at_two"), paths.at_depth(path, 1).alias("at_one"), paths.at_depth(path, 0).alias("at_zero"))


@_query("SELECT o_orderkey, '/a/' || o_custkey AS inside, '/' || o_custkey AS above, '/abs/' || o_custkey AS absolute FROM orders")
def link_targets(spark, sf_dir):
    k = F.col("o_custkey").cast("string")
    at = lambda prefix: paths.link_target(F.lit("/a/l"), F.concat(F.lit(prefix), k))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", at("./").alias("inside"), at("../").alias("above"), at("/abs/").alias("absolute"))


@_query("SELECT p_partkey, p_partkey AS number, p_partkey::BIGINT AS decimal FROM part WHERE p_partkey < 17576")
def volume_letters(spark, sf_dir):
    """Numbers as letters and back."""
    k = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").where("p_partkey < 17576").select("p_partkey", values.split_number(values.number_letters("p_partkey", 3)).alias("number"), values.split_number(F.lpad(k.cast("string"), 6, "0")).alias("decimal"))


@_query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, 10.0::DOUBLE AS mtime, sha256(coalesce(text, '')) AS full_sha256 FROM documents")
def fingerprint_round_trip(spark, sf_dir):
    """A fingerprint to JSON and back, broken seconds cut."""
    text = F.encode("text", "UTF-8")
    made = _documents(spark, sf_dir).select("doc_id", F.struct(F.octet_length(text).cast("long").alias("size"), F.lit(10.75).alias("mtime"), F.sha2(text, 256).alias("full_sha256")).alias("f"))
    back = made.select("doc_id", indexes.parse_fingerprint(indexes.fingerprint_json("f")).alias("f"))
    return back.select("doc_id", "f.size", "f.mtime", "f.full_sha256")


@_query("""SELECT doc_id, doc_id % 4 NOT IN (1, 2) AS same FROM documents""")
def fingerprint_matches(spark, sf_dir):
    """The middle digest counts only where both sides have one."""
    k = F.col("doc_id") % 4

    def side(size, mid):
        return F.struct(size.alias("size"), F.lit("p").alias("prefix_sha256"), F.lit("s").alias("suffix_sha256"), mid.alias("mid_sha256"))

    rows = fx.table(spark, sf_dir, "documents").select("doc_id", side(F.lit(5), F.lit("m")).alias("x"), side(F.when(k == 1, 6).otherwise(5), F.when(k == 2, "other").when(k == 3, None).otherwise("m")).alias("y"))
    return rows.select("doc_id", values.fingerprints_match("x", "y").alias("same"))


def fnv1a_sql() -> str:
    """Recursion over bytes, in 128-bit numbers."""
    return """WITH RECURSIVE k AS (SELECT DISTINCT p_brand AS name FROM part), w AS (
  SELECT name, 0 AS i, 14695981039346656037::HUGEINT AS h FROM k
  UNION ALL SELECT name, i + 1, (xor(h::BIGNUM_T, ascii(name[i + 1])) * 1099511628211) % 18446744073709551616 FROM w WHERE i < length(name))
SELECT name, lower(hex(h)) AS fnv1a FROM w WHERE i = length(name)""".replace("h::BIGNUM_T", "h").replace("xor(h, ascii(name[i + 1]))", "xor(h, ascii(name[i + 1])::HUGEINT)")


@_query(fnv1a_sql())
def fnv1a_hash(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().select("name", values.fnv1a("name").alias("fnv1a"))


@_query("SELECT p_partkey, 'a,b,c' AS shown FROM part")
def backend_order(spark, sf_dir):
    """Chosen back ends, the last named first, before the defaults."""
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.array_join(paths.ordered_backends(F.lit("b , a"), ["b", "c"]), ",").alias("shown"))


@_query("SELECT p_partkey, p_partkey AS gzip, 7::BIGINT AS other FROM part WHERE p_partkey > 0")
def parallelization(spark, sf_dir):
    spec = values.parallelization(F.concat(F.lit("7:7,gzip:").substr(F.lit(2), F.lit(20)), F.col("p_partkey").cast("string")))
    return fx.table(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey", spec["gzip"].cast("long").alias("gzip"), spec[""].cast("long").alias("other"))


@_query("SELECT doc_id, sha256(encode(text)[1:0]) AS nothing, sha256(unhex(substring(hex(encode(coalesce(text, ''))), 7, 20))) AS part FROM documents".replace("sha256(encode(text)[1:0])", "sha256('')"))
def read_ranges(spark, sf_dir):
    """Bytes by offset and size, short at the end."""
    text = F.encode("text", "UTF-8")
    return _documents(spark, sf_dir).select("doc_id", F.sha2(ranges.read_bytes(text, F.lit(0), F.lit(0)), 256).alias("nothing"), F.sha2(ranges.read_bytes(text, F.lit(3), F.lit(10)), 256).alias("part"))
