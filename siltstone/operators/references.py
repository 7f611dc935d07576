"""References to records that do not exist.

Every change of a referring or referred table becomes signed counts per key; the sum of all counts so far says which keys
are referred to without existing. The counts are the state kept between deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.keys import clean_key, latest
from siltstone.operators.skew import HOT_SHARE, hot_keys, salted_join

COUNTS = ["object_key", "n_refs", "n_exists", "n_present", "first_ref_at", "stored_at"]


def file_references(files: DataFrame) -> DataFrame:
    """Reference rows of ``files_index``: the latest synced_at of a rel_path holds (null is earliest)."""
    rows = files.select("rel_path", "synced_at", clean_key(F.col("object_key")).alias("object_key"))
    held = latest(rows.where("rel_path is not null"), ["rel_path"], "synced_at", ["object_key"])
    return _referring(held, "files_index", F.col("rel_path"), "object_key", F.col("object_key"), F.col("synced_at"))


def task_references(tasks: DataFrame) -> DataFrame:
    """Reference rows of ``copy_tasks``: each task once, its key and its old key."""
    rows = tasks.where("task_id is not null").select("task_id", "queued_at", clean_key(F.col("object_key")).alias("new"), clean_key(F.col("old_object_key")).alias("old"))
    once = rows.groupBy("task_id").agg(F.max(F.struct("queued_at", "new", "old")).alias("t")).select("task_id", "t.*")
    both = F.inline(F.array(
        F.struct(F.lit("object_key").alias("ref_column"), F.col("new").alias("object_key")),
        F.struct(F.lit("old_object_key").alias("ref_column"), F.col("old").alias("object_key")),
    ))
    flat = once.select("task_id", "queued_at", both)
    return _referring(flat, "copy_tasks", F.col("task_id").cast("string"), None, F.col("object_key"), F.col("queued_at"))


def _referring(rows: DataFrame, table: str, key: Column, column: str | None, to: Column, at: Column) -> DataFrame:
    named = F.lit(column) if column else F.col("ref_column")
    return rows.where("object_key is not null").select(
        F.lit(table).alias("source_table"), key.alias("record_key"), named.alias("ref_column"), to.alias("object_key"), at.alias("at")
    )


def held_objects(objects: DataFrame) -> DataFrame:
    """Objects that hold: object_key (clean), released, stored_at. Released: ref_count is 0 or orphaned is true."""
    rows = objects.select(clean_key(F.col("object_key")).alias("object_key"), "recorded_at", "ref_count", "orphaned", "stored_at")
    held = latest(rows.where("object_key is not null"), ["object_key"], "recorded_at", ["ref_count", "orphaned", "stored_at"])
    released = F.coalesce(F.col("ref_count") == 0, F.lit(False)) | F.coalesce("orphaned", F.lit(False))
    return held.select("object_key", released.alias("released"), "stored_at")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Counts to add for references that appeared (+1) or went away (-1), combined per key."""
    g = refs.groupBy("object_key").agg((F.count(F.lit(1)) * sign).alias("n_refs"), F.min("at").alias("first_ref_at"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("timestamp_ntz")
    first = F.col("first_ref_at").cast("timestamp_ntz") if sign > 0 else none
    return g.select("object_key", "n_refs", zero.alias("n_exists"), zero.alias("n_present"), first.alias("first_ref_at"), none.alias("stored_at"))


def object_deltas(held: DataFrame, sign: int = 1) -> DataFrame:
    """Counts to add for objects that appeared (+1) or went away (-1). A released object is present but does not exist."""
    none = F.lit(None).cast("timestamp_ntz")
    exists = F.when(F.col("released"), 0).otherwise(sign).cast("bigint")
    stored = F.col("stored_at").cast("timestamp_ntz") if sign > 0 else none
    return held.select("object_key", F.lit(0).cast("bigint").alias("n_refs"), exists.alias("n_exists"), F.lit(sign).cast("bigint").alias("n_present"), none.alias("first_ref_at"), stored.alias("stored_at"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum of counts per key: the state so far and any deltas, in any order.

    ``first_ref_at`` and ``stored_at`` are bounds: the earliest reference and the latest store ever added.
    """
    both = parts[0].select(*COUNTS)
    for more in parts[1:]:
        both = both.unionByName(more.select(*COUNTS))
    return both.groupBy("object_key").agg(
        F.sum("n_refs").alias("n_refs"), F.sum("n_exists").alias("n_exists"), F.sum("n_present").alias("n_present"),
        F.min("first_ref_at").alias("first_ref_at"), F.max("stored_at").alias("stored_at"),
    )


def orphan_keys(counts: DataFrame) -> DataFrame:
    """object_key, n_refs, reason of keys referred to without existing: ``missing`` (no such object) or ``deleted``."""
    reason = F.when(F.col("n_present") > 0, "deleted").otherwise("missing")
    return counts.where("n_refs > 0 and n_exists <= 0").select("object_key", "n_refs", reason.alias("reason"))


def orphan_references(files: DataFrame, tasks: DataFrame, objects: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """Every reference to an absent, released or later stored object.

    Result: source_table, record_key, ref_column, reason (``missing``, ``deleted``, ``late``, the first that fits), period
    (``YYYY-MM`` of the referring record, ``unknown`` without a time). References without a clean key are none. Only keys
    whose counts show a case meet the reference rows again, hot keys spread over salts.
    """
    refs = file_references(files).unionByName(task_references(tasks))
    held = held_objects(objects)
    ref_counts = reference_deltas(refs)
    counts = merge_counts(ref_counts, object_deltas(held))
    orphan = F.col("n_exists") <= 0
    suspects = counts.where((F.col("n_refs") > 0) & (orphan | (F.col("stored_at") > F.col("first_ref_at"))))
    state = suspects.select("object_key", F.when(orphan, F.when(F.col("n_present") > 0, "deleted").otherwise("missing")).alias("state"), "stored_at")
    joined = salted_join(refs, state, "object_key", [F.col("record_key")], hot_keys(ref_counts, "object_key", "n_refs", share))
    reason = F.coalesce("state", F.when(F.col("stored_at") > F.col("at"), "late"))
    period = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return joined.select("source_table", "record_key", "ref_column", reason.alias("reason"), period.alias("period")).where("reason is not null")


def orphans_by_month(references: DataFrame) -> DataFrame:
    """source_table, ref_column, reason, period, n_references."""
    return references.groupBy("source_table", "ref_column", "reason", "period").agg(F.count(F.lit(1)).alias("n_references"))
