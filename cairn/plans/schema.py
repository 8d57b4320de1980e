"""Fixed schemas of the catalog tables; nothing is inferred."""

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def _t(spec: str) -> T.StructType:
    """A flat schema from ``name kind`` pairs, without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in spec.split(", "))])


FILES = _t("archive_id string, path string, name string, version_key long, header_offset long, data_offset long, size long, mtime double, mode long, type_flag int, linkname string, uid long, gid long, is_archive boolean, is_sparse boolean, is_generated boolean, is_tombstone boolean, recursion_depth int, backend string")
XATTRS = _t("archive_id string, version_key long, key string, value binary")
ARCHIVES = _t("archive_id string, uri string, backend string, st_size long, st_mtime long, st_mtime_ns long, prefix_sha256 string, suffix_sha256 string, full_sha256 string, immutable boolean, source_idx int")
BLOCKS = _t("archive_id string, codec string, comp_offset long, comp_unit string, data_offset long, is_sentinel boolean")
SEGMENTS = _t("archive_id string, version_key long, ord int, kind string, file_offset long, len long, logical_offset long")
OVERLAY = _t("path string, name string, mtime double, mode long, size long, deleted boolean")
