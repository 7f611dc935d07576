"""Scalar rules about files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modification times this close (inclusive) count as equal.
TOLERANCE_NS = 2_000_000_000
#: Files up to this size (inclusive) are verified whenever small-file verification is on.
SMALL_FILE = 1 << 20
#: Longest file name in bytes, and how much of a longer one is kept before its digest.
NAME_BYTES, NAME_KEPT = 150, 141


def mtime_close(a: Column, b: Column) -> Column:
    """|a - b| <= 2 s; null if either is null."""
    return F.abs(a - b) <= F.lit(TOLERANCE_NS)


def unchanged(size_a: Column, mtime_a: Column, size_b: Column, mtime_b: Column) -> Column:
    """Equal size and close mtime; the hash plays no part."""
    return (size_a == size_b) & mtime_close(mtime_a, mtime_b)


def should_verify(size: Column, verify: Column | bool, small: Column | bool) -> Column:
    v = verify if isinstance(verify, Column) else F.lit(verify)
    s = small if isinstance(small, Column) else F.lit(small)
    return v | (s & (size <= SMALL_FILE))


def key_hex(key: Column, prefix: str) -> Column:
    """The digits after the prefix; a key without the prefix counts as bare digits."""
    return F.when(key.startswith(prefix), F.substr(key, F.lit(len(prefix) + 1))).otherwise(key)


def valid_key(key: Column, prefix: str) -> Column:
    """Prefix, then at least four hexadecimal digits of either case."""
    return key.rlike(f"^{prefix}[0-9A-Fa-f]{{4,}}$")


def object_bucket(key: Column, prefix: str, digits: int) -> Column:
    """The first ``digits`` of the key, case kept; '' unless there are at least four, all hexadecimal."""
    h = key_hex(key, prefix)
    return F.when(h.rlike("^[0-9A-Fa-f]{4,}$"), F.substr(h, F.lit(1), F.lit(digits))).otherwise(F.lit(""))


def object_path(root: str, key: Column, prefix: str) -> Column:
    """root/hh/hhhh/hex; '' for an invalid key."""
    h = key_hex(key, prefix)
    b2, b4 = object_bucket(key, prefix, 2), object_bucket(key, prefix, 4)
    return F.when(b2 == "", F.lit("")).otherwise(F.concat_ws("/", F.lit(root), b2, b4, h))


def sanitized(name: Column) -> Column:
    """A usable file name: ``/`` and NUL become ``_``; above 150 bytes the head plus eight digits of the SHA-1.

    The cut is by bytes; a character cut in two becomes U+FFFD. Null stays null.
    """
    plain = F.translate(name, "/\x00", "__")
    head = F.make_valid_utf8(F.substring(plain.cast("binary"), 1, NAME_KEPT).cast("string"))
    short = F.concat(head, F.lit("_"), F.substring(F.sha1(name), 1, 8))
    return F.when(F.octet_length(plain) > NAME_BYTES, short).otherwise(plain)


def human_bytes(n: Column) -> Column:
    """``1.5 KiB`` and the like; below 1 KiB whole bytes. One decimal, halves to even."""
    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1 << power)), 1))

    return (
        F.when(n >= 1 << 30, scaled(30, "GiB")).when(n >= 1 << 20, scaled(20, "MiB")).when(n >= 1 << 10, scaled(10, "KiB"))
        .otherwise(F.format_string("%d B", n))
    )


def escapes_root(rel_path: Column) -> Column:
    """True if the relative path, read segment by segment, climbs above its root at any point, or is absolute."""
    def step(low: Column, part: Column) -> Column:
        d = low["depth"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(d.cast("int").alias("depth"), F.least(low["least"], d).cast("int").alias("least"))

    folded = F.aggregate(F.split(rel_path, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), step)
    return rel_path.startswith("/") | (folded["least"] < 0)


def starts_dated(at: Column) -> Column:
    """Time stamp of a quarantine folder."""
    return F.date_format(at, "yyyyMMdd-HHmmss")
