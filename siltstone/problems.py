"""Queries of the data-comparison problems over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import compare, references, snapshots, tasks


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_changes(_t(spark, sf, "file_states"))


def p1_two_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """The same cases from two deliveries: the later half of the snapshots is compared with what the first delivery kept."""
    states, listings = _t(spark, sf, "file_states"), snapshots.Listings(spark)
    cut = states.agg(F.floor((F.min("snapshot_no") + F.max("snapshot_no")) / 2)).first()[0]
    if cut is None:
        return listings.deliver(states)
    return listings.deliver(states.where(F.col("snapshot_no") <= cut)).unionByName(listings.deliver(states.where(F.col("snapshot_no") > cut)))


def p1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return p1_found(spark, sf).groupBy("root", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_paths"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return compare.pair_differences(*(_t(spark, sf, n) for n in ("left_states", "right_states", "changes")))


def p2_summary(spark: SparkSession, sf: str) -> DataFrame:
    return p2_found(spark, sf).groupBy("field").agg(F.count(F.lit(1)).alias("n_paths"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_references(*(_t(spark, sf, n) for n in ("files_index", "copy_tasks", "objects_index")))


def p3_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphans_by_month(p3_found(spark, sf))


def p3_orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    files, copies, objects = (_t(spark, sf, n) for n in ("files_index", "copy_tasks", "objects_index"))
    refs = references.file_references(files).unionByName(references.task_references(copies))
    counts = references.merge_counts(references.reference_deltas(refs), references.object_deltas(references.held_objects(objects)))
    return references.orphan_keys(counts)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.heavy_joined_keys(tasks.task_object_totals(_t(spark, sf, "copy_tasks"), _t(spark, sf, "objects_index")))


def p4_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.task_totals(_t(spark, sf, "copy_tasks"))


def p4_join_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.task_object_totals(_t(spark, sf, "copy_tasks"), _t(spark, sf, "objects_index"))


QUERIES = {f.__name__: f for f in (p1_found, p1_two_deliveries, p1_summary, p2_found, p2_summary, p3_found, p3_by_month, p3_orphan_keys, p4_found, p4_totals, p4_join_totals)}


def _key(c: str) -> str:
    k = f"lower(trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    return f"CASE WHEN {k} = '' THEN NULL WHEN contains({k}, ':') THEN {k} ELSE 'h3:' || {k} END"


def _path(c: str) -> str:
    """Up to three nested parent segments, which is more than the tables have."""
    p = f"regexp_replace(regexp_replace('/' || nfc_normalize(replace({c}, chr(92), '/')) || '/', '/+', '/', 'g'), '/(\\./)+', '/', 'g')"
    for _ in range(3):
        p = f"regexp_replace({p}, '/[^/]+/\\.\\./', '/')"
    return f"CASE WHEN {c} LIKE '/%' OR {c} LIKE chr(92) || '%' THEN rtrim({p}, '/') ELSE trim({p}, '/') END"


def _held(table: str, keys: str, by: str, columns: str, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {by} DESC NULLS LAST) AS rn FROM (SELECT {columns} FROM {table} WHERE {where})) WHERE rn = 1"


_P1 = f"""
WITH l AS ({_held('file_states', 'root, snapshot_no, path', 'recorded_at', f"root, snapshot_no, {_path('path')} AS path, size, mtime_ns, {_key('hash')} AS hash, recorded_at", "path <> ''")}),
s AS (SELECT root, snapshot_no, lag(snapshot_no) OVER (PARTITION BY root ORDER BY snapshot_no) AS earlier FROM (SELECT DISTINCT root, snapshot_no FROM l)),
a AS (SELECT l.*, s.earlier FROM l JOIN s USING (root, snapshot_no) WHERE s.earlier IS NOT NULL),
b AS (SELECT l.*, s.snapshot_no AS later FROM l JOIN s ON l.root = s.root AND l.snapshot_no = s.earlier)
SELECT coalesce(a.root, b.root) AS root, CAST(coalesce(a.snapshot_no, b.later) AS INTEGER) AS snapshot_no, coalesce(a.path, b.path) AS path,
  CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind
FROM a FULL JOIN b ON a.root = b.root AND a.snapshot_no = b.later AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR abs(a.mtime_ns - b.mtime_ns) > 2000000000 OR a.hash <> b.hash"""


def _side(table: str) -> str:
    return _held(table, "path", "recorded_at", f"{_path('path')} AS path, size, mtime_ns, {_key('hash')} AS hash, recorded_at", "path <> ''")


_P2 = f"""
WITH l AS ({_side('left_states')}), r AS ({_side('right_states')}),
c AS (SELECT DISTINCT {_path('path')} AS path, left_size, right_size FROM changes WHERE path <> '')
SELECT DISTINCT path, field FROM (
  SELECT path, 'missing_right' AS field FROM l WHERE path NOT IN (SELECT path FROM r)
  UNION ALL SELECT path, 'missing_left' FROM r WHERE path NOT IN (SELECT path FROM l)
  UNION ALL SELECT l.path, 'size' FROM l JOIN r USING (path) WHERE l.size <> r.size
  UNION ALL SELECT l.path, 'mtime' FROM l JOIN r USING (path) WHERE abs(l.mtime_ns - r.mtime_ns) > 2000000000
  UNION ALL SELECT l.path, 'hash' FROM l JOIN r USING (path) WHERE l.hash <> r.hash
  UNION ALL SELECT c.path, 'left_size' FROM c JOIN l USING (path) WHERE c.left_size <> l.size
  UNION ALL SELECT c.path, 'right_size' FROM c JOIN r USING (path) WHERE c.right_size <> r.size)"""

_REFS = f"""
f AS ({_held('files_index', 'rel_path', 'synced_at', f"rel_path, synced_at, {_key('object_key')} AS k")}),
t AS ({_held('copy_tasks', 'task_id', 'queued_at', f"task_id, queued_at, {_key('object_key')} AS k, {_key('old_object_key')} AS old")}),
o AS ({_held('objects_index', 'object_key', 'recorded_at', f"{_key('object_key')} AS object_key, recorded_at, ref_count, orphaned, stored_at")}),
refs AS (
  SELECT 'files_index' AS source_table, rel_path AS record_key, 'object_key' AS ref_column, k, synced_at AS seen FROM f
  UNION ALL SELECT 'copy_tasks', CAST(task_id AS VARCHAR), 'object_key', k, queued_at FROM t
  UNION ALL SELECT 'copy_tasks', CAST(task_id AS VARCHAR), 'old_object_key', old, queued_at FROM t)"""
_P3 = f"""
WITH {_REFS}
SELECT source_table, record_key, ref_column, reason, coalesce(strftime(seen, '%Y-%m'), 'unknown') AS period FROM (
  SELECT r.*, CASE WHEN o.object_key IS NULL THEN 'missing' WHEN coalesce(o.ref_count = 0, false) OR coalesce(o.orphaned, false) THEN 'deleted'
    WHEN o.stored_at > r.seen THEN 'late' END AS reason
  FROM refs r LEFT JOIN o ON o.object_key = r.k WHERE r.k IS NOT NULL) WHERE reason IS NOT NULL"""

_TASKS = f"SELECT k AS object_key, count(*) AS n_tasks, CAST(sum(size) AS BIGINT) AS total_size, max(queued_at) AS last_queued_at FROM (SELECT task_id, {_key('object_key')} AS k, max(size) AS size, max(queued_at) AS queued_at FROM copy_tasks GROUP BY 1, 2) WHERE k IS NOT NULL GROUP BY 1"

ORACLE = {
    "p1_found": _P1,
    "p1_two_deliveries": _P1,
    "p1_summary": f"SELECT root, snapshot_no, change_kind, count(*) AS n_paths FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2,
    "p2_summary": f"SELECT field, count(*) AS n_paths FROM ({_P2}) GROUP BY ALL",
    "p3_found": _P3,
    "p3_by_month": f"SELECT source_table, ref_column, reason, period, count(*) AS n_references FROM ({_P3}) GROUP BY ALL",
    "p3_orphan_keys": f"WITH {_REFS} SELECT r.k AS object_key, count(*) AS n_refs, CASE WHEN any_value(o.object_key) IS NULL THEN 'missing' ELSE 'deleted' END AS reason FROM refs r LEFT JOIN o ON o.object_key = r.k WHERE r.k IS NOT NULL AND (o.object_key IS NULL OR coalesce(o.ref_count = 0, false) OR coalesce(o.orphaned, false)) GROUP BY 1",
    "p4_found": f"SELECT object_key FROM ({_TASKS}) WHERE n_tasks * 100 >= (SELECT sum(n_tasks) FROM ({_TASKS}))",
    "p4_totals": _TASKS,
    "p4_join_totals": f"SELECT t.object_key, n_tasks, n_objects, n_tasks * coalesce(n_objects, 1) AS n_pairs, total_size, last_queued_at, CAST(total_size * coalesce(n_objects, 1) AS BIGINT) AS pairs_size FROM ({_TASKS}) t LEFT JOIN (SELECT {_key('object_key')} AS object_key, count(*) AS n_objects FROM objects_index GROUP BY 1) o ON o.object_key = t.object_key",
}
