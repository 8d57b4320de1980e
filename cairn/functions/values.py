"""Mode bits, number fields, digests, dates, sizes and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File type bits of a mode; fixed values.
S_IFMT, S_IFREG, S_IFDIR, S_IFLNK = 0xF000, 0x8000, 0x4000, 0xA000
EDGE = 512
FULL_LIMIT = 256 * 1024


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_type(mode: str | Column) -> Column:
    return _col(mode).cast("long").bitwiseAND(F.lit(S_IFMT).cast("long"))


def is_regular(mode: str | Column) -> Column:
    return file_type(mode) == S_IFREG


def is_directory(mode: str | Column) -> Column:
    return file_type(mode) == S_IFDIR


def is_symlink(mode: str | Column) -> Column:
    return file_type(mode) == S_IFLNK


def octal(text: str | Column) -> Column:
    """Octal field: blanks and NULs around it are ignored, empty is 0, anything else null."""
    t = F.trim(F.translate(_col(text), "\x00", " "))
    return F.when(t == "", F.lit(0).cast("long")).when(t.rlike("^[0-7]+$"), F.conv(t, 8, 10).cast("long"))


def hexadecimal(text: str | Column) -> Column:
    t = F.trim(_col(text))
    return F.when(t.rlike("^[0-9A-Fa-f]+$"), F.conv(t, 16, 10).cast("long"))


def decimal(text: str | Column) -> Column:
    t = F.trim(_col(text))
    return F.when(t == "", F.lit(0).cast("long")).when(t.rlike("^[0-9]+$"), F.try_to_number(t, F.lit("9999999999999999999")).cast("long"))


def crc32_hex(data: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(_col(data)))), 8, "0")


def fnv1a(text: str | Column) -> Column:
    """64-bit FNV-1a of a text's bytes in hex without leading zeros.

    The product modulo 2^64 is taken in halves of 32 bits, as a long would overflow.
    """
    codes = F.regexp_extract_all(F.hex(F.encode(_col(text), "UTF-8")), F.lit("(..)"), F.lit(1))
    mask, start = F.lit(0xFFFFFFFF).cast("long"), 0xCBF29CE484222325

    def step(acc: Column, code: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.conv(code, 16, 10).cast("long"))
        product = low * 0x1B3
        high = acc["high"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    zero = F.struct(F.lit(start >> 32).cast("long").alias("high"), F.lit(start & 0xFFFFFFFF).cast("long").alias("low"))
    done = F.aggregate(codes, zero, step)
    return F.when(done["high"] == 0, F.lower(F.hex(done["low"]))).otherwise(F.lower(F.concat(F.hex(done["high"]), F.lpad(F.hex(done["low"]), 8, "0"))))


def digests(data: str | Column) -> list[Column]:
    """crc32, md5, sha1 and sha256 in lower-case hex."""
    d = _col(data)
    return [crc32_hex(d).alias("crc32"), F.md5(d).alias("md5"), F.sha1(d).alias("sha1"), F.sha2(d, 256).alias("sha256")]


def edge_fingerprint(data: str | Column) -> list[Column]:
    """Digests of the first and last 512 bytes, and of all up to 256 KiB (else null)."""
    d = _col(data)
    n = F.octet_length(d)
    return [
        F.sha2(F.substring(d, 1, EDGE), 256).alias("prefix_sha256"),
        F.sha2(F.when(n <= EDGE, d).otherwise(F.substring(d, n - EDGE + 1, F.lit(EDGE))), 256).alias("suffix_sha256"),
        F.when(n <= FULL_LIMIT, F.sha2(d, 256)).alias("full_sha256"),
    ]


def fingerprints_match(a: str, b: str) -> Column:
    """Two fingerprint structs: size, prefix and suffix equal; the middle only where both have one."""
    same = lambda f: F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    both = F.coalesce(F.col(f"{a}.mid_sha256"), F.lit("")) != ""
    other = F.coalesce(F.col(f"{b}.mid_sha256"), F.lit("")) != ""
    return same("size") & same("prefix_sha256") & same("suffix_sha256") & (~(both & other) | same("mid_sha256"))


def staleness(stored: str, now: str) -> Column:
    """Why a stored fingerprint no longer fits: ``size``, ``mtime``, ``content``, or ``fresh``; nothing stored or no file is fresh."""
    s, n = (lambda f: F.col(f"{stored}.{f}")), (lambda f: F.col(f"{now}.{f}"))
    edges = s("prefix_sha256").eqNullSafe(n("prefix_sha256")) & s("suffix_sha256").eqNullSafe(n("suffix_sha256"))
    content = F.when(s("full_sha256").isNotNull() & n("full_sha256").isNotNull(), s("full_sha256") == n("full_sha256")).otherwise(edges)
    return (
        F.when(F.col(stored).isNull() | F.col(now).isNull(), "fresh")
        .when(~s("size").eqNullSafe(n("size")), "size")
        .when(F.floor(s("mtime")) != F.floor(n("mtime")), "mtime")
        .when(~content, "content")
        .otherwise("fresh")
    )


def byte_size(text: str | Column) -> Column:
    """``512``, ``4K``, ``16MiB``, ``1GB`` in bytes, all units by 1024; null if malformed or too large."""
    t = F.upper(F.trim(_col(text)))
    n = F.regexp_extract(t, r"^(\d{1,18})\s*([KMGT]?)(I?B)?$", 1)
    unit = F.regexp_extract(t, r"^(\d{1,18})\s*([KMGT]?)(I?B)?$", 2)
    factor = F.when(unit == "K", F.lit(1 << 10)).when(unit == "M", F.lit(1 << 20)).when(unit == "G", F.lit(1 << 30)).when(unit == "T", F.lit(1 << 40)).otherwise(F.lit(1))
    return F.when(n != "", F.try_multiply(F.when(n != "", n).cast("long"), factor.cast("long")))


def duration_seconds(text: str | Column) -> Column:
    """``90``, ``90s``, ``5m``, ``2h`` in seconds; 0 turns a feature off; null if malformed."""
    t = F.lower(F.trim(_col(text)))
    n, unit = F.regexp_extract(t, r"^(\d{1,9})([smh]?)$", 1), F.regexp_extract(t, r"^(\d{1,9})([smh]?)$", 2)
    return F.when(n != "", F.when(n != "", n).cast("long") * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1).cast("long"))


def parallelization(spec: str | Column) -> Column:
    """``N`` or ``codec:N,...`` as a map; the empty codec is the default."""
    s = _col(spec)
    return F.str_to_map(F.when(s.contains(":"), s).otherwise(F.concat(F.lit(":"), s)), F.lit(","), F.lit(":"))


def dos_timestamp(date: str | Column, time: str | Column) -> Column:
    """Seconds since the epoch of a DOS date and time taken as UTC; null if they are no date."""
    d, t = _col(date).cast("int"), _col(time).cast("int")
    made = F.try_make_timestamp(F.shiftright(d, 9) + 1980, F.shiftright(d, 5).bitwiseAND(F.lit(15)), d.bitwiseAND(F.lit(31)), F.shiftright(t, 11), F.shiftright(t, 5).bitwiseAND(F.lit(63)), t.bitwiseAND(F.lit(31)) * 2, F.lit("UTC"))
    return F.unix_timestamp(made)


def filetime_seconds(ticks: str | Column) -> Column:
    """Seconds since the epoch of 100 ns ticks since 1601; 0 stays 0."""
    x = _col(ticks).cast("long")
    return F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double") / 1e7 - 11644473600.0)


def split_number(suffix: str | Column) -> Column:
    """Number of a split volume's suffix: decimal, or letters counted from ``a`` = 0 in base 26."""
    s = F.lower(_col(suffix))
    letters = F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 97))
    return F.when(s.rlike(r"^\d+$"), F.conv(s, 10, 10).cast("long")).when(s.rlike("^[a-z]+$"), letters)


def number_letters(n: str | Column, width: int) -> Column:
    """The suffix of ``width`` letters that ``split_number`` reads back."""
    x = _col(n).cast("long")
    return F.concat(*[F.char(F.lit(97) + F.pmod(F.floor(x / F.lit(26**i)), F.lit(26))) for i in range(width - 1, -1, -1)])
