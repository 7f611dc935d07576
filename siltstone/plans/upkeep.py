"""Checking, rebuilding, pruning and summing up the index of an object store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.files import escapes_root
from siltstone.functions.rows import beside
from siltstone.operators.skew import hot_keys, salted_join


def status(files: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: n_files, n_objects, file_bytes, ref_bytes (size times references), object_bytes, saved_bytes."""
    f = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("file_bytes"))
    o = objects.agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.coalesce(F.sum(F.when(F.col("ref_count") > 0, F.col("size") * F.col("ref_count"))), F.lit(0)).alias("ref_bytes"),
        F.coalesce(F.sum(F.when(F.col("ref_count") > 0, F.col("size"))), F.lit(0)).alias("object_bytes"),
    )
    return beside(f, o).select("n_files", "n_objects", "file_bytes", "ref_bytes", "object_bytes", (F.col("file_bytes") - F.col("object_bytes")).alias("saved_bytes"))


def verify_report(index: DataFrame, target: DataFrame) -> DataFrame:
    """rel_path, verdict of every indexed file: ok, missing, mismatch, read_error (no hash), escape (leaves the root)."""
    t = target.select("rel_path", F.col("object_key").alias("found_key"), F.lit(True).alias("there"))
    j = index.select("rel_path", "object_key").join(t, "rel_path", "left")
    verdict = (
        F.when(escapes_root(F.col("rel_path")), "escape").when(F.col("there").isNull(), "missing").when(F.col("found_key").isNull(), "read_error")
        .when(F.col("found_key").eqNullSafe(F.col("object_key")), "ok").otherwise("mismatch")
    )
    return j.select("rel_path", verdict.alias("verdict"))


def verify_stats(report: DataFrame) -> DataFrame:
    """One row: checked, missing, failed (mismatch, read_error, escape)."""
    v = F.col("verdict")
    return report.agg(F.count(F.lit(1)).alias("checked"), F.count_if(v == "missing").alias("missing"), F.count_if(v.isin("mismatch", "read_error", "escape")).alias("failed"))


def unindexed(index: DataFrame, target: DataFrame) -> DataFrame:
    return target.select("rel_path").join(index.select("rel_path"), "rel_path", "left_anti")


def reindex_files(target: DataFrame, objects: DataFrame, metadata_dir: str = ".siltstone") -> DataFrame:
    """rel_path, size, mtime_ns, object_key, linked of the files on a target.

    A file on an object's inode (dev, ino) has its key without being read; any other has the key of its hash. The
    engine's own folder at the top is left out. If several objects share an inode the smallest key counts; an object with very many links meets them in salted parts.
    """
    own = (F.col("rel_path") == metadata_dir) | F.col("rel_path").startswith(f"{metadata_dir}/")
    o = objects.where("ino is not null").groupBy("dev", "ino").agg(F.min("object_key").alias("inode_key"))
    files = target.where(~own)
    links = files.where("ino is not null").groupBy("dev", "ino").agg(F.count(F.lit(1)).alias("n"))
    j = salted_join(files, o, ["dev", "ino"], [F.col("rel_path")], hot_keys(links, ["dev", "ino"], "n"), "left")
    key = F.coalesce("inode_key", "object_key")
    return j.select("rel_path", "size", "mtime_ns", key.alias("object_key"), F.col("inode_key").isNotNull().alias("linked"))


def reindex_objects(files: DataFrame) -> DataFrame:
    """object_key, size, ref_count, stored_at (unknown), orphaned of the files' keys."""
    g = files.where("object_key is not null").groupBy("object_key").agg(F.max("size").alias("size"), F.count(F.lit(1)).cast("int").alias("ref_count"))
    return g.select("object_key", "size", "ref_count", F.lit(None).cast("timestamp_ntz").alias("stored_at"), F.lit(False).alias("orphaned"))


def prune_plan(objects: DataFrame, physical: DataFrame) -> DataFrame:
    """object_key, reason of everything to delete: ``orphan`` (no references) or ``unindexed`` (stored, not recorded)."""
    orphans = objects.where("ref_count = 0").select("object_key", F.lit("orphan").alias("reason"))
    strays = physical.select("object_key").distinct().join(objects.select("object_key"), "object_key", "left_anti")
    return orphans.unionByName(strays.select("object_key", F.lit("unindexed").alias("reason")))


def prune_stats(objects: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: scanned, deleted."""
    return beside(objects.agg(F.count(F.lit(1)).alias("scanned")), plan.agg(F.count(F.lit(1)).alias("deleted")))
