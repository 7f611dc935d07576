"""Planning an incremental copy: what to skip, touch or copy, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.files import mtime_close
from siltstone.functions.rows import beside
from siltstone.operators.skew import hot_keys, salted_join


def sync_plan(manifest: DataFrame, index: DataFrame, fast_skip: bool = True) -> DataFrame:
    """rel_path, size, mtime_ns, object_key, old_object_key, action of every scanned file.

    ``manifest``: rel_path, size, mtime_ns, object_key (null: the content could not be read); ``index``: the same columns as
    recorded by earlier runs. Actions: ``skip`` (metadata agrees; only with ``fast_skip``), ``skip_error`` (unreadable),
    ``touch`` (same content, other mtime), ``copy``. Without ``fast_skip`` identical files are copied again. Two rows of the
    manifest with one path count as they come; remove them with ``union_sources`` first. One left join on rel_path.
    """
    old = index.select("rel_path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime_ns"), F.nullif(F.col("object_key"), F.lit("")).alias("old_object_key"), F.lit(True).alias("found"))
    j = manifest.select("rel_path", "size", "mtime_ns", "object_key").join(old, "rel_path", "left")
    same_size = F.col("found") & (F.col("size") == F.col("old_size"))
    close = mtime_close(F.col("mtime_ns"), F.col("old_mtime_ns"))
    action = F.when(F.lit(fast_skip) & same_size & F.col("old_object_key").isNotNull() & close, "skip")
    action = action.when(F.col("object_key").isNull(), "skip_error")
    action = action.when(same_size & (F.col("object_key") == F.col("old_object_key")) & ~close, "touch").otherwise("copy")
    return j.select("rel_path", "size", "mtime_ns", "object_key", "old_object_key", action.alias("action"))


def union_sources(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """One manifest of several sources, each below its destination folder; of two files with one path the later source wins."""
    parts = []
    for n, (manifest, dest) in enumerate(sources):
        path = F.concat_ws("/", F.lit(dest.replace("\\", "/").strip("/")), F.col("rel_path")) if dest else F.col("rel_path")
        parts.append(manifest.withColumn("rel_path", path).withColumn("source_no", F.lit(n)))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    rest = [c for c in all_.columns if c not in ("rel_path", "source_no")]
    return all_.groupBy("rel_path").agg(F.max_by(F.struct(*rest), "source_no").alias("r")).select("rel_path", "r.*")


def seen_before(plan: DataFrame, objects: DataFrame) -> DataFrame:
    """Copies of the plan with ``known``: whether their object exists already or an earlier copy (by rel_path) brings it.

    The first copy of a key is a map-side combined minimum, and the copies of a key that holds many meet it in salted
    parts, so there is no hot window or partition.
    """
    copies = plan.where("action = 'copy' and object_key is not null")
    first = copies.groupBy("object_key").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("first_path"))
    there = first.join(objects.select("object_key").distinct().withColumn("there", F.lit(True)), "object_key", "left")
    j = salted_join(copies, there.drop("n"), "object_key", [F.col("rel_path")], hot_keys(first, "object_key", "n"))
    return j.select(*copies.columns, (F.coalesce("there", F.lit(False)) | (F.col("rel_path") != F.col("first_path"))).alias("known"))


def sync_report(plan: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: copied, skipped, failed, bytes, dedup_saved of carrying the plan out (failed is 0 in a plan)."""
    known = seen_before(plan, objects)
    copied = known.agg(
        F.count(F.lit(1)).alias("copied"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("size"))), F.lit(0)).alias("dedup_saved"),
    )
    skipped = plan.agg(F.count_if(F.col("action") != "copy").alias("skipped"))
    return beside(copied, skipped).select("copied", "skipped", F.lit(0).cast("bigint").alias("failed"), "bytes", "dedup_saved")


def source_deleted(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Indexed paths that are no longer scanned; for information, they stay in place."""
    return index.select("rel_path").join(manifest.select("rel_path"), "rel_path", "left_anti")


def space_hardlink(copies: DataFrame, objects: DataFrame) -> DataFrame:
    """bytes_needed where content is stored once: each absent key counts once, with its largest size."""
    each = copies.where("object_key is not null").groupBy("object_key").agg(F.max("size").alias("size"))
    return each.join(objects.select("object_key"), "object_key", "left_anti").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_needed"))


def space_copy(copies: DataFrame, workers: int = 8) -> DataFrame:
    """bytes_needed for temporary copies: the largest size times the workers."""
    return copies.agg((F.coalesce(F.max("size"), F.lit(0)) * max(workers, 1)).alias("bytes_needed"))


def reference_ops(plan: DataFrame) -> DataFrame:
    """rel_path, old_object_key (null: new file), object_key for every file whose record changes."""
    return plan.where("action in ('copy', 'touch')").select("rel_path", F.nullif(F.col("old_object_key"), F.lit("")).alias("old_object_key"), "object_key", "size")


def merge_refcounts(objects: DataFrame, ops: DataFrame, now: Column | None = None) -> DataFrame:
    """objects after the ops: object_key, size, ref_count, stored_at, orphaned.

    Each op takes one reference from its old key and gives one to its new key, unless they are equal. Counts never fall
    below 0; 0 after a loss marks the object as orphaned, a gain clears the mark. A lost reference to an unknown object
    makes an orphaned row. Size and stored_at are filled in only where there are none yet.
    """
    moved = ops.where("old_object_key is null or old_object_key <> object_key")
    sides = F.inline(F.array(
        F.struct(F.col("object_key").alias("key"), F.lit(1).alias("d"), F.col("size").alias("s")),
        F.struct(F.col("old_object_key").alias("key"), F.lit(-1).alias("d"), F.lit(None).cast("bigint").alias("s")),
    ))
    delta = moved.select(sides).where("key is not null").groupBy("key").agg(
        F.sum("d").alias("delta"), F.count_if(F.col("d") > 0).alias("gains"), F.max("s").alias("new_size")
    )
    j = objects.join(delta, objects["object_key"] == delta["key"], "full")
    count = F.greatest(F.coalesce("ref_count", F.lit(0)) + F.coalesce("delta", F.lit(0)), F.lit(0)).cast("int")
    gained = F.coalesce("gains", F.lit(0)) > 0
    lost_all = F.col("delta").isNotNull() & (count == 0)
    stored = F.coalesce("stored_at", F.when(gained, now if now is not None else F.current_timestamp().cast("timestamp_ntz")))
    return j.select(
        F.coalesce("object_key", "key").alias("object_key"),
        F.when(gained & (F.coalesce("size", F.lit(0)) == 0), F.col("new_size")).otherwise(F.coalesce("size", F.lit(0))).alias("size"),
        count.alias("ref_count"), stored.alias("stored_at"),
        F.when(lost_all, True).when(gained, False).otherwise(F.coalesce("orphaned", F.lit(False))).alias("orphaned"),
    )


def conflicts(plan: DataFrame, target: DataFrame, literal: bool = False) -> DataFrame:
    """Copies whose destination holds other content than planned: rel_path, dest_hash, quarantine (bool).

    A destination that still holds the recorded old content is an ordinary update, not a conflict; ``literal`` counts it
    as one.
    """
    j = plan.where("action = 'copy'").join(target.select("rel_path", F.col("object_key").alias("dest_hash")), "rel_path")
    known = F.coalesce(F.col("dest_hash") == F.col("old_object_key"), F.lit(False)) & F.lit(not literal)
    return j.where(F.col("dest_hash") != F.col("object_key")).select("rel_path", "dest_hash", (~known).alias("quarantine"))


def last_of_key(tasks: DataFrame) -> DataFrame:
    """Tasks with ``is_last``: whether seq is the highest of the object key, after which a temporary object can go."""
    last = tasks.where("object_key is not null").groupBy("object_key").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
    j = salted_join(tasks, last.drop("n"), "object_key", [F.col("seq")], hot_keys(last, "object_key", "n"), "left")
    return j.select(*tasks.columns, F.coalesce(F.col("seq") == F.col("last_seq"), F.lit(False)).alias("is_last"))
