"""Manifests and earlier states made from a table of documents, one file per document.

The files' states follow from the last digit of doc_id, so that every branch of the planners has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_S = 1_000_000_000


def base(docs: DataFrame) -> DataFrame:
    """rel_path, doc_id, size, mtime_ns, hash, object_key, text of every document; a null text is an empty file."""
    text = F.coalesce("text", F.lit(""))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    hash_ = F.md5(text)
    return docs.select(
        path.alias("rel_path"), "doc_id", F.octet_length(text).cast("bigint").alias("size"), (F.col("doc_id") * _S).alias("mtime_ns"),
        hash_.alias("hash"), F.concat(F.lit("md5:"), hash_).alias("object_key"), text.alias("text"), (F.col("doc_id") % 10).cast("int").alias("d"),
    )


def _key(salt: str) -> Column:
    return F.concat(F.lit("md5:"), F.md5(F.concat("text", F.lit(salt))))


def _gone(f: DataFrame) -> DataFrame:
    return f.where("doc_id % 20 = 8").withColumn("rel_path", F.concat(F.lit("gone/"), F.col("doc_id").cast("string"), F.lit(".txt")))


def files_index(f: DataFrame) -> DataFrame:
    d = F.col("d")
    mtime = F.col("mtime_ns") + F.when(d.isin(2, 3), 3 * _S).when(d == 4, 2 * _S).when(d == 5, 2 * _S + 1).otherwise(0)
    key = F.when(d.isin(1, 2, 7), _key("#old")).when(d == 6, F.lit("")).otherwise(F.col("object_key"))
    rows = f.where("d <> 0").select("rel_path", "doc_id", (F.col("size") + F.when(d == 1, 1).otherwise(0)).cast("bigint").alias("size"), mtime.cast("bigint").alias("mtime_ns"), key.alias("object_key"))
    return rows.unionByName(_gone(f).select("rel_path", "doc_id", "size", "mtime_ns", "object_key"))


def objects_index(f: DataFrame) -> DataFrame:
    held = files_index(f).where("object_key <> ''").groupBy("object_key").agg(F.max("size").alias("size"), F.count(F.lit(1)).cast("int").alias("ref_count"))
    orphan = F.concat(F.lit("md5:"), F.md5(F.concat(F.lit("orphan"), F.col("doc_id").cast("string"))))
    rows = held.unionByName(f.where("doc_id % 50 = 0").select(orphan.alias("object_key"), "size", F.lit(0).alias("ref_count")))
    return rows.select("*", F.lit(None).cast("timestamp_ntz").alias("stored_at"), (F.col("ref_count") == 0).alias("orphaned"))


def physical_objects(f: DataFrame) -> DataFrame:
    stray = F.concat(F.lit("md5:"), F.md5(F.concat(F.lit("stray"), F.col("doc_id").cast("string"))))
    return objects_index(f).where("not startswith(object_key, 'md5:f')").select("object_key").unionByName(f.where("doc_id % 100 = 0").select(stray.alias("object_key")))


def file_states(f: DataFrame) -> DataFrame:
    d = F.col("d")
    rows = f.where("d <> 0").select(
        "rel_path", (F.col("size") + F.when(d == 1, 1).otherwise(0)).cast("bigint").alias("size"),
        (F.col("mtime_ns") + F.when(d == 3, 3 * _S).when(d == 4, 2 * _S).otherwise(0)).cast("bigint").alias("mtime_ns"), F.when(d != 2, F.col("hash")).alias("hash"),
    )
    return rows.unionByName(_gone(f).select("rel_path", "size", "mtime_ns", "hash"))


def verify_index(f: DataFrame) -> DataFrame:
    out = f.where("doc_id % 100 = 1").select(F.concat(F.lit("../"), F.col("doc_id").cast("string")).alias("rel_path"), "object_key")
    return files_index(f).select("rel_path", "object_key").unionByName(out)


def verify_target(f: DataFrame) -> DataFrame:
    """Contents found at the target; files with no recorded key could not be read."""
    key = F.when((F.col("doc_id") % 10 == 8) & ~F.col("rel_path").startswith("gone/"), F.lit("md5:corrupt")).otherwise(F.nullif(F.col("object_key"), F.lit("")))
    return files_index(f).where("doc_id % 10 <> 9").select("rel_path", key.alias("object_key"))


def reindex_target(f: DataFrame) -> DataFrame:
    return f.select("rel_path", "size", "mtime_ns", F.when(F.col("doc_id") % 2 == 1, F.col("object_key")).alias("object_key"), F.lit(1).cast("bigint").alias("dev"), F.col("doc_id").alias("ino"))


def reindex_inodes(f: DataFrame) -> DataFrame:
    return f.where("doc_id % 2 = 0").select("object_key", F.lit(1).cast("bigint").alias("dev"), F.col("doc_id").alias("ino"))


def bisync_sides(f: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """left, right, left_was, right_was."""
    d = F.col("d")
    cols = ("rel_path", "size", "mtime_ns")
    left = f.where("d <> 2").select(
        "rel_path", (F.col("size") + F.when(d == 1, 7).otherwise(0)).cast("bigint").alias("size"),
        (F.col("mtime_ns") + F.when(d.isin(1, 4), 3 * _S).when(d == 5, 2 * _S).when(d == 6, 2 * _S + 1).otherwise(0)).cast("bigint").alias("mtime_ns"),
    )
    right = f.where("d <> 7").select(
        "rel_path", (F.col("size") + F.when(d.isin(3, 4), 9).otherwise(0)).cast("bigint").alias("size"),
        (F.col("mtime_ns") + F.when(d.isin(3, 4), 5 * _S).otherwise(0)).cast("bigint").alias("mtime_ns"),
    )
    was = f.where("d <> 8").select(*cols)
    return left, right, was, was
