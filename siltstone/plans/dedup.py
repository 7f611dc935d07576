"""Exact duplicate files, all at once or against the state of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.files import unchanged
from siltstone.functions.rows import beside
from siltstone.operators.skew import hot_keys, salted_join


def size_candidates(files: DataFrame) -> DataFrame:
    """Files that share their size with another; only these need hashing."""
    shared = files.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return salted_join(files, shared.select("size"), "size", [F.col("rel_path")], hot_keys(shared, "size", "n")).select(*files.columns)


def duplicate_groups(files: DataFrame) -> DataFrame:
    """size, hash, n_files, representative (first path in byte order) of content held more than once; null hashes never match."""
    groups = files.where("hash is not null").groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n_files"), F.min("rel_path").alias("representative"))
    return groups.where("n_files > 1")


def dedup_stats(groups: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: scanned, groups, duplicate_files, bytes_saved."""
    n = scanned.agg(F.count(F.lit(1)).alias("scanned"))
    g = groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum((F.col("n_files") - 1) * F.col("size")), F.lit(0)).alias("bytes_saved"),
    )
    return beside(n, g)


def link_plan(files: DataFrame, groups: DataFrame) -> DataFrame:
    """rel_path, representative, size of every file to link, and mtime_ns and head_mtime_ns where ``files`` has mtime_ns.

    Files on the representative's inode (dev, ino) need none. One row per file: the group's files are never gathered, and
    those of a large group meet it in salted parts. What is known of a representative comes with the group's minimum.
    """
    known = [c for c in ("mtime_ns", "dev", "ino") if c in files.columns]
    g = groups.select("size", "hash", "n_files", "representative")
    if known:
        head = F.min(F.struct(F.col("rel_path").alias("representative"), *[F.col(c).alias(f"head_{c}") for c in known])).alias("head")
        g = files.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n_files"), head).join(groups.select("size", "hash"), ["size", "hash"], "left_semi").select("size", "hash", "n_files", "head.*")
    hot = hot_keys(g, ["size", "hash"], "n_files")
    j = salted_join(files, g.drop("n_files"), ["size", "hash"], [F.col("rel_path")], hot).where(F.col("rel_path") != F.col("representative"))
    if {"dev", "ino"} <= set(known):
        j = j.where("not (dev <=> head_dev and ino <=> head_ino) or ino is null")
    return j.select("rel_path", "representative", "size", *(["mtime_ns", "head_mtime_ns"] if "mtime_ns" in known else []))


def to_hash(files: DataFrame, states: DataFrame) -> DataFrame:
    """Scanned files without a usable hash from earlier runs: changed (P2), new, or never hashed."""
    return with_cached_hash(files, states).where("cached_hash is null").drop("cached_hash")


def with_cached_hash(files: DataFrame, states: DataFrame) -> DataFrame:
    old = states.select("rel_path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime_ns"), F.nullif(F.col("hash"), F.lit("")).alias("old_hash"))
    j = files.join(old, "rel_path", "left")
    same = unchanged(F.col("size"), F.col("mtime_ns"), F.col("old_size"), F.col("old_mtime_ns"))
    return j.select(*files.columns, F.when(same, F.col("old_hash")).alias("cached_hash"))


def deleted_paths(files: DataFrame, states: DataFrame) -> DataFrame:
    return states.select("rel_path").join(files.select("rel_path"), "rel_path", "left_anti")


def next_states(files: DataFrame, states: DataFrame) -> DataFrame:
    """State rows after the run: every scanned file with its hash, remembered or fresh (``hash`` of ``files``)."""
    j = with_cached_hash(files, states)
    return j.select("rel_path", "size", "mtime_ns", F.coalesce("cached_hash", "hash").alias("hash"))
