"""Content keys: XXH3-128 of files and of binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "h3:"
BUFFER = 1 << 20


def file_key(path: str) -> str:
    """``h3:`` and 32 hexadecimal digits, the high half first; the file is read in pieces, never as a whole."""
    import xxhash

    h = xxhash.xxh3_128()
    with open(path, "rb") as f:
        while piece := f.read(BUFFER):
            h.update(piece)
    return PREFIX + h.hexdigest()


@F.pandas_udf(T.StringType())
def content_key(data: pd.Series) -> pd.Series:
    """Key of a binary column; null stays null."""
    import xxhash

    return data.map(lambda b: None if b is None else PREFIX + xxhash.xxh3_128_hexdigest(bytes(b)))


_HASHED = T.StructType([T.StructField("key", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_HASHED)
def path_key(paths: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """(key, error) of the files at the paths: an unreadable file has an error instead of a key and stops nothing."""
    def one(p: str | None) -> tuple[str | None, str | None]:
        try:
            return (file_key(p), None) if p is not None else (None, "no path")
        except OSError as e:
            return None, f"{type(e).__name__}: {e.strerror}"

    for s in paths:
        yield pd.DataFrame([one(p) for p in s], columns=["key", "error"])


def hashed(files: DataFrame, path: str = "abs_path", to: str = "object_key") -> DataFrame:
    """``files`` with the key of the content at ``path`` and, where it cannot be read, ``hash_error``."""
    return files.withColumn("_hashed", path_key(F.col(path))).select("*", F.col("_hashed.key").alias(to), F.col("_hashed.error").alias("hash_error")).drop("_hashed")


def text_key(text: Column, prefix: str = "md5:") -> Column:
    """JVM-side key of a text column."""
    return F.concat(F.lit(prefix), F.md5(text))
