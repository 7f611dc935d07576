"""Canonical spellings of paths and object keys, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_PREFIX = "h3:"
#: White space that may surround a delivered key.
BLANKS = " \t\n\r\f\v   ﻿​"

_NEEDS_RESOLVING = r"(^|/)\.{1,2}(/|$)|//|/$"


def clean_key(key: Column) -> Column:
    """Object key without outer white space, lower case, with a prefix; null when there is none.

    A value without any prefix gets ``h3:``; another prefix stays. Null, empty and blank give null.
    """
    k = F.lower(F.trim(key, F.lit(BLANKS)))
    return F.when(F.contains(k, F.lit(":")), k).when(F.length(k) > 0, F.concat(F.lit(KEY_PREFIX), k))


def _resolved(path: Column) -> Column:
    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def with_clean_path(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``df`` with the clean path of ``column`` in ``to`` (default: in place).

    Forward slashes, NFC, no empty, ``.`` or ``..`` segments; a leading slash stays, ``..`` above the top is dropped.
    Null stays null, and a path without any segment gives ''. Composition runs in the JVM through the ICU library that
    Spark ships; Spark counts that call as non-deterministic, so it sits in its own projection, evaluated once a row.
    """
    to = to or column
    slashed = F.translate(F.col(column), "\\", "/")
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), slashed, F.lit(False))
    df = df.withColumn(to, F.when(F.octet_length(slashed) > F.char_length(slashed), composed).otherwise(slashed))
    p = F.col(to)
    return df.withColumn(to, F.when(p.rlike(_NEEDS_RESOLVING), _resolved(p)).otherwise(p))


def latest(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """The row that holds of each key: the one with the latest ``by`` (nulls count as earliest).

    Equal times are decided by the values themselves, so the result is the same in every run. The aggregate combines
    map-side, so a key delivered any number of times leaves one row per input partition.
    """
    held = F.max(F.struct(by, *values)).alias("_held")
    return df.groupBy(*keys).agg(held).select(*keys, f"_held.{by}", *[f"_held.{v}" for v in values])
