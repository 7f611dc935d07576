"""Totals of copy tasks per object key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.keys import clean_key
from siltstone.operators.skew import eager_join, key_states

#: A key is reported as heavy when it holds at least this part (1/n) of the tasks with a key.
HEAVY_PART = 100


def distinct_tasks(tasks: DataFrame) -> DataFrame:
    """One row per task that has a clean key: object_key, task_id, size, queued_at.

    Repeated deliveries of a task are one task (a value known in any of them is kept). Null and empty keys and tasks
    without an id are left out.
    """
    rows = tasks.select(clean_key(F.col("object_key")).alias("object_key"), "task_id", "size", "queued_at")
    rows = rows.where("object_key is not null and task_id is not null")
    return rows.groupBy("object_key", "task_id").agg(F.max("size").alias("size"), F.max("queued_at").alias("queued_at"))


def task_totals(tasks: DataFrame) -> DataFrame:
    """object_key, n_tasks, total_size (of known sizes; null if none), last_queued_at (null if none known)."""
    states = key_states(distinct_tasks(tasks), "object_key", {"total_size": F.col("size")}, {"last_queued_at": F.col("queued_at")})
    return states.withColumnRenamed("n", "n_tasks")


def task_object_totals(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """Totals over tasks joined with the rows of ``objects`` of the same clean key, without joining the rows.

    Per key of a task: n_tasks, n_objects (rows delivered for the object, null if none), n_pairs (rows of the left
    join), total_size, last_queued_at (of the tasks), pairs_size (total_size over the joined rows).
    """
    left = key_states(distinct_tasks(tasks), "object_key", {"total_size": F.col("size"), "pairs_size": F.col("size")}, {"last_queued_at": F.col("queued_at")})
    right = key_states(objects.select(clean_key(F.col("object_key")).alias("object_key")), "object_key")
    j = eager_join(left, right, "object_key", ["pairs_size"], [], "left")
    return j.select("object_key", F.col("n_left").alias("n_tasks"), F.col("n_right").alias("n_objects"), "n_pairs", "total_size", "last_queued_at", "pairs_size")


def heavy_keys(totals: DataFrame, part: int = HEAVY_PART) -> DataFrame:
    """Keys of ``totals`` (n_tasks per key) holding at least 1/part of all its tasks; at most ``part`` rows."""
    total = totals.groupBy().agg(F.sum("n_tasks")).scalar()
    return totals.where(F.col("n_tasks") * part >= total).select("object_key")


def heavy_joined_keys(joined: DataFrame, part: int = HEAVY_PART) -> DataFrame:
    """Keys of the joined states of ``task_object_totals`` holding at least 1/part of all tasks.

    A key's tasks are its joined rows divided by how often each of them was joined, rolled up after the join.
    """
    return heavy_keys(joined.select("object_key", F.expr("n_pairs div greatest(coalesce(n_objects, 0), 1)").alias("n_tasks")), part)
