"""Queries of the planners and scalar rules over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import files, glob, hashing
from siltstone.functions.keys import clean_key, latest, with_clean_path
from siltstone.operators.references import held_objects
from siltstone.plans import bisync, dedup, sync, upkeep
from siltstone.problems import _held, _key, _path
from siltstone.sources import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _f(spark: SparkSession, sf: str) -> DataFrame:
    return derived.base(_t(spark, sf, "documents"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of files_index that hold."""
    rows = _t(spark, sf, "files_index").select("rel_path", "size", "mtime_ns", "synced_at", clean_key(F.col("object_key")).alias("object_key"))
    return latest(rows, ["rel_path"], "synced_at", ["size", "mtime_ns", "object_key"])


# SQL of the derived states (the twin of siltstone.sources.derived)
_F = """f AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS rel_path, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
  doc_id * 1000000000 AS mtime_ns, md5(coalesce(text, '')) AS hash, 'md5:' || md5(coalesce(text, '')) AS object_key, coalesce(text, '') AS text, doc_id % 10 AS d FROM documents)"""
_GONE = "SELECT 'gone/' || doc_id || '.txt' AS rel_path, doc_id, size, mtime_ns, {key} FROM f WHERE doc_id % 20 = 8"
_FI = f"""{_F}, fi AS (SELECT rel_path, doc_id, size + CASE WHEN d = 1 THEN 1 ELSE 0 END AS size,
  mtime_ns + CASE WHEN d IN (2, 3) THEN 3000000000 WHEN d = 4 THEN 2000000000 WHEN d = 5 THEN 2000000001 ELSE 0 END AS mtime_ns,
  CASE WHEN d IN (1, 2, 7) THEN 'md5:' || md5(text || '#old') WHEN d = 6 THEN '' ELSE object_key END AS object_key FROM f WHERE d <> 0
  UNION ALL {_GONE.format(key='object_key')})"""
_OI = f"""{_FI}, oi AS (SELECT object_key, max(size) AS size, CAST(count(*) AS INTEGER) AS ref_count FROM fi WHERE object_key <> '' GROUP BY 1
  UNION ALL SELECT 'md5:' || md5('orphan' || doc_id), size, 0 FROM f WHERE doc_id % 50 = 0)"""


def _plan_sql(fast: bool) -> str:
    skip = "WHEN i.rel_path IS NOT NULL AND f.size = i.size AND i.object_key <> '' AND abs(f.mtime_ns - i.mtime_ns) <= 2000000000 THEN 'skip'" if fast else ""
    return f"""SELECT f.rel_path, f.size, f.mtime_ns, f.object_key, nullif(i.object_key, '') AS old_object_key, CASE {skip}
      WHEN f.size = i.size AND f.object_key = i.object_key AND abs(f.mtime_ns - i.mtime_ns) > 2000000000 THEN 'touch' ELSE 'copy' END AS action
      FROM f LEFT JOIN fi i ON i.rel_path = f.rel_path"""


_P = f"WITH {_OI}, p AS ({_plan_sql(True)})"


@_query(f"WITH {_F} SELECT rel_path, size, mtime_ns, object_key FROM f")
def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _f(spark, sf).select("rel_path", "size", "mtime_ns", "object_key")


_GLOBS = ["**/EN/**", "list_*/**/*1.txt", "board_{mill,quay}/f?/**"]


@_query(f"WITH {_F} SELECT rel_path, size FROM f WHERE NOT regexp_matches(lower(rel_path), '^(.*/)?en/.*|^list_[^/]*/(.*/)?[^/]*1\\.txt$|^board_(mill|quay)/f[^/]/.*')")
def manifest_exclude_glob(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return f.where(~glob.excluded(F.col("rel_path"), _GLOBS)).select("rel_path", "size")


@_query(f"""WITH {_F} SELECT rel_path, max_by(size, n) AS size, max_by(src, n) AS src FROM (
  SELECT 'all/' || rel_path AS rel_path, size, 'docs' AS src, 0 AS n FROM f UNION ALL SELECT 'all/' || rel_path, size + 1, 'late', 1 FROM f WHERE size > 1000 UNION ALL SELECT 'events/' || event_id, CAST(user_id AS BIGINT), 'events', 2 FROM events) GROUP BY 1""")
def manifest_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf).select("rel_path", "size", F.lit("docs").alias("src"))
    late = f.where("size > 1000").select("rel_path", (F.col("size") + 1).alias("size"), F.lit("late").alias("src"))
    ev = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("rel_path"), F.col("user_id").cast("bigint").alias("size"), F.lit("events").alias("src"))
    return sync.union_sources([(f, "all"), (late, "\\all\\"), (ev, "events")])


@_query(f"SELECT rel_path, max(doc_id) AS doc_id, max(scanned_at) AS scanned_at FROM (SELECT {_path('rel_path')} AS rel_path, doc_id, scanned_at FROM manifest) GROUP BY 1")
def manifest_held(spark: SparkSession, sf: str) -> DataFrame:
    m = with_clean_path(_t(spark, sf, "manifest").select("rel_path", "doc_id", "scanned_at"), "rel_path")
    return m.groupBy("rel_path").agg(F.max("doc_id").alias("doc_id"), F.max("scanned_at").alias("scanned_at"))


@_query(f"WITH {_F} SELECT rel_path, size FROM f WHERE size IN (SELECT size FROM f GROUP BY 1 HAVING count(*) > 1)")
def size_collision_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.size_candidates(_f(spark, sf).select("rel_path", "size"))


_GROUPS = "g AS (SELECT size, hash, count(*) AS n_files, min(rel_path) AS representative FROM f GROUP BY 1, 2 HAVING count(*) > 1)"


@_query(f"WITH {_F}, {_GROUPS} SELECT * FROM g")
def dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_groups(dedup.size_candidates(_f(spark, sf).select("rel_path", "size", "hash")))


@_query("")  # DuckDB has no XXH3-128; a test holds the groups against those of dedup_groups
def dedup_groups_xxh3(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf).select("rel_path", "size", hashing.content_key(F.encode("text", "UTF-8")).alias("hash"))
    return dedup.duplicate_groups(f)


@_query(f"WITH {_F}, {_GROUPS} SELECT (SELECT count(*) FROM f) AS scanned, count(*) AS n_groups, CAST(coalesce(sum(n_files - 1), 0) AS BIGINT) AS duplicate_files, CAST(coalesce(sum((n_files - 1) * size), 0) AS BIGINT) AS bytes_saved FROM g")
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf).select("rel_path", "size", "hash")
    return dedup.dedup_stats(dedup.duplicate_groups(f), f)


@_query(f"WITH {_F}, {_GROUPS} SELECT f.rel_path, g.representative, f.size FROM f JOIN g USING (size, hash) WHERE f.rel_path <> g.representative")
def dedup_link_plan(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf).select("rel_path", "size", "hash")
    return dedup.link_plan(f, dedup.duplicate_groups(f))


_ST = f"""{_F}, st AS (SELECT rel_path, size + CASE WHEN d = 1 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN d = 3 THEN 3000000000 WHEN d = 4 THEN 2000000000 ELSE 0 END AS mtime_ns,
  CASE WHEN d <> 2 THEN hash END AS hash FROM f WHERE d <> 0 UNION ALL SELECT 'gone/' || doc_id || '.txt', size, mtime_ns, hash FROM f WHERE doc_id % 20 = 8)"""
_REUSED = "st.size = f.size AND abs(st.mtime_ns - f.mtime_ns) <= 2000000000 AND st.hash IS NOT NULL"


@_query(f"WITH {_ST} SELECT f.rel_path, f.size FROM f LEFT JOIN st ON st.rel_path = f.rel_path WHERE NOT coalesce({_REUSED}, false)")
def dedup_incremental_to_hash(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return dedup.to_hash(f.select("rel_path", "size", "mtime_ns"), derived.file_states(f)).select("rel_path", "size")


@_query(f"WITH {_ST} SELECT rel_path FROM st WHERE rel_path NOT IN (SELECT rel_path FROM f)")
def dedup_incremental_deleted(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return dedup.deleted_paths(f, derived.file_states(f))


@_query(f"WITH {_ST}, n AS (SELECT f.rel_path, f.size, f.mtime_ns, CASE WHEN {_REUSED} THEN st.hash ELSE f.hash END AS hash FROM f LEFT JOIN st ON st.rel_path = f.rel_path) SELECT size, hash, count(*) AS n_files, min(rel_path) AS representative FROM n GROUP BY 1, 2 HAVING count(*) > 1")
def dedup_incremental_groups(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return dedup.duplicate_groups(dedup.next_states(f.select("rel_path", "size", "mtime_ns", "hash"), derived.file_states(f)))


_BOTH = " UNION ALL ".join(f"SELECT '{t[0]}/' || path AS rel_path, size, hash FROM ({_held(t, 'path', 'recorded_at', _path('path') + ' AS path, size, ' + _key('hash') + ' AS hash, recorded_at', "path <> ''")}) WHERE path <> ''" for t in ("left_states", "right_states"))


@_query(f"SELECT size, hash, count(*) AS n_files, min(rel_path) AS representative FROM ({_BOTH}) WHERE hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def dedup_groups_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Equal content across both sides of the pair, by the rows that hold."""
    sides = [_side(spark, sf, t).select(F.concat(F.lit(f"{t[0]}/"), "rel_path").alias("rel_path"), "size", F.col("object_key").alias("hash")) for t in ("left_states", "right_states")]
    return dedup.duplicate_groups(sides[0].unionByName(sides[1]))


_HELD_FILES = _held("files_index", "rel_path", "synced_at", f"rel_path, size, mtime_ns, synced_at, {_key('object_key')} AS object_key")


@_query(f"SELECT size, object_key AS hash, count(*) AS n_files, min(rel_path) AS representative FROM ({_HELD_FILES}) WHERE object_key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def dedup_groups_files(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_groups(_files(spark, sf).withColumnRenamed("object_key", "hash"))


_INODE = "CASE WHEN d < 5 THEN 7 ELSE doc_id END"


@_query(f"WITH {_F}, i AS (SELECT f.*, {_INODE} AS ino FROM f), {_GROUPS} SELECT i.rel_path, g.representative, i.size FROM i JOIN g USING (size, hash) JOIN i r ON r.rel_path = g.representative WHERE i.rel_path <> g.representative AND i.ino <> r.ino")
def dedup_link_plan_inodes(spark: SparkSession, sf: str) -> DataFrame:
    """Files that share the representative's inode already need no link."""
    ino = F.when(F.col("d") < 5, 7).otherwise(F.col("doc_id"))
    f = _f(spark, sf).select("rel_path", "size", "hash", F.lit(1).alias("dev"), ino.alias("ino"))
    return dedup.link_plan(f, dedup.duplicate_groups(f))


def _plan(spark: SparkSession, sf: str, fast: bool = True) -> DataFrame:
    f = _f(spark, sf)
    return sync.sync_plan(f, derived.files_index(f), fast)


@_query(f"WITH {_FI} {_plan_sql(True)}")
def sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


@_query(f"WITH {_FI} {_plan_sql(False)}")
def sync_plan_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf, False)


@_query(f"""WITH {_FI}, u AS (SELECT rel_path, size, mtime_ns, CASE WHEN d <> 9 THEN object_key END AS object_key FROM f)
  SELECT u.rel_path, u.size, u.mtime_ns, u.object_key, nullif(i.object_key, '') AS old_object_key, CASE WHEN u.object_key IS NULL THEN 'skip_error'
  WHEN u.size = i.size AND u.object_key = i.object_key AND abs(u.mtime_ns - i.mtime_ns) > 2000000000 THEN 'touch' ELSE 'copy' END AS action FROM u LEFT JOIN fi i ON i.rel_path = u.rel_path""")
def sync_plan_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose content could not be read are passed over."""
    f = _f(spark, sf)
    return sync.sync_plan(f.withColumn("object_key", F.when(F.col("d") != 9, F.col("object_key"))), derived.files_index(f), False)


@_query(f"SELECT task_id, object_key, object_key IS NOT NULL AND task_id = max(task_id) OVER (PARTITION BY object_key) AS is_last FROM (SELECT task_id, max({_key('object_key')}) AS object_key FROM copy_tasks GROUP BY 1)")
def sync_last_of_key(spark: SparkSession, sf: str) -> DataFrame:
    """After which task of its key a temporary object can go; one key holds about a tenth of the tasks."""
    tasks = _t(spark, sf, "copy_tasks").groupBy("task_id").agg(F.max(clean_key(F.col("object_key"))).alias("object_key"))
    return sync.last_of_key(tasks.withColumn("seq", F.col("task_id"))).select("task_id", "object_key", "is_last")


_KNOWN = f"""{_P}, k AS (SELECT p.*, row_number() OVER (PARTITION BY object_key ORDER BY rel_path) > 1 OR object_key IN (SELECT object_key FROM oi) AS known FROM p WHERE action = 'copy')"""


@_query(f"{_KNOWN} SELECT count(*) AS copied, (SELECT count(*) FROM p WHERE action <> 'copy') AS skipped, CAST(0 AS BIGINT) AS failed, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (known), 0) AS BIGINT) AS dedup_saved FROM k")
def sync_report(spark: SparkSession, sf: str) -> DataFrame:
    return sync.sync_report(_plan(spark, sf), derived.objects_index(_f(spark, sf)))


@_query(f"{_KNOWN} SELECT rel_path, object_key, known FROM k")
def sync_seen_before(spark: SparkSession, sf: str) -> DataFrame:
    return sync.seen_before(_plan(spark, sf), derived.objects_index(_f(spark, sf))).select("rel_path", "object_key", "known")


@_query(f"WITH {_FI} SELECT rel_path FROM fi WHERE rel_path NOT IN (SELECT rel_path FROM f)")
def sync_source_deleted(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return sync.source_deleted(f, derived.files_index(f))


@_query(f"{_P} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_needed FROM (SELECT object_key, max(size) AS size FROM p WHERE action = 'copy' AND object_key NOT IN (SELECT object_key FROM oi) GROUP BY 1)")
def sync_space_hardlink(spark: SparkSession, sf: str) -> DataFrame:
    return sync.space_hardlink(_plan(spark, sf).where("action = 'copy'"), derived.objects_index(_f(spark, sf)))


@_query(f"{_P} SELECT CAST(coalesce(max(size), 0) * 8 AS BIGINT) AS bytes_needed FROM p WHERE action = 'copy'")
def sync_space_copy(spark: SparkSession, sf: str) -> DataFrame:
    return sync.space_copy(_plan(spark, sf).where("action = 'copy'"))


_TASK = f"(SELECT task_id, max({_key('object_key')}) AS object_key, max(size) AS size FROM copy_tasks GROUP BY 1)"


@_query(f"SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_needed FROM (SELECT object_key, max(size) AS size FROM {_TASK} WHERE object_key IS NOT NULL GROUP BY 1) WHERE object_key NOT IN (SELECT {_key('object_key')} FROM objects_index)")
def tasks_space_hardlink(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _t(spark, sf, "copy_tasks").select(clean_key(F.col("object_key")).alias("object_key"), "size")
    return sync.space_hardlink(tasks, _t(spark, sf, "objects_index").select(clean_key(F.col("object_key")).alias("object_key")))


@_query(f"SELECT CAST(coalesce(max(size), 0) * 8 AS BIGINT) AS bytes_needed FROM copy_tasks")
def tasks_space_copy(spark: SparkSession, sf: str) -> DataFrame:
    return sync.space_copy(_t(spark, sf, "copy_tasks"))


@_query(f"{_P} SELECT p.rel_path, t.object_key AS dest_hash, NOT coalesce(t.object_key = p.old_object_key, false) AS quarantine FROM p JOIN fi t ON t.rel_path = p.rel_path WHERE action = 'copy' AND t.object_key <> p.object_key")
def sync_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return sync.conflicts(_plan(spark, sf), derived.files_index(_f(spark, sf)))


_OPS = "o AS (SELECT rel_path, old_object_key, object_key, size FROM p WHERE action IN ('copy', 'touch') AND (old_object_key IS NULL OR old_object_key <> object_key))"
_MERGE = """dl AS (SELECT k, sum(d) AS delta, count(*) FILTER (d > 0) AS gains, max(s) AS new_size FROM (SELECT object_key AS k, 1 AS d, size AS s FROM o UNION ALL SELECT old_object_key, -1, NULL FROM o WHERE old_object_key IS NOT NULL) GROUP BY 1)
  SELECT coalesce(oi.object_key, k) AS object_key, CASE WHEN coalesce(gains, 0) > 0 AND coalesce(oi.size, 0) = 0 THEN new_size ELSE coalesce(oi.size, 0) END AS size,
  CAST(greatest(coalesce(ref_count, 0) + coalesce(delta, 0), 0) AS INTEGER) AS ref_count,
  CASE WHEN k IS NOT NULL AND coalesce(ref_count, 0) + delta <= 0 THEN true WHEN coalesce(gains, 0) > 0 THEN false ELSE coalesce({orphaned}, false) END AS orphaned
  FROM {oi} oi FULL JOIN dl ON dl.k = oi.object_key"""


@_query(f"{_P}, {_OPS}, {_MERGE.format(oi='oi', orphaned='oi.ref_count = 0')}")
def refcount_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = sync.merge_refcounts(derived.objects_index(_f(spark, sf)), sync.reference_ops(_plan(spark, sf)))
    return merged.select("object_key", "size", "ref_count", "orphaned")


_HELD_OBJECTS = _held("objects_index", "object_key", "recorded_at", f"{_key('object_key')} AS object_key, recorded_at, size, ref_count, orphaned")


@_query(f"""WITH t AS (SELECT task_id, max({_key('object_key')}) AS object_key, max({_key('old_object_key')}) AS old_object_key, max(size) AS size FROM copy_tasks GROUP BY 1),
  o AS (SELECT * FROM t WHERE object_key IS NOT NULL AND (old_object_key IS NULL OR old_object_key <> object_key)), {_MERGE.format(oi=f'({_HELD_OBJECTS})', orphaned='oi.orphaned')}""")
def refcount_merge_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The tables' own tasks carried out against the tables' own objects."""
    t = _t(spark, sf, "copy_tasks").select("task_id", clean_key(F.col("object_key")).alias("object_key"), clean_key(F.col("old_object_key")).alias("old_object_key"), "size")
    ops = t.groupBy("task_id").agg(F.max("object_key").alias("object_key"), F.max("old_object_key").alias("old_object_key"), F.max("size").alias("size")).where("object_key is not null")
    rows = _t(spark, sf, "objects_index").select(clean_key(F.col("object_key")).alias("object_key"), "recorded_at", "size", "ref_count", "orphaned", "stored_at")
    held = latest(rows.where("object_key is not null"), ["object_key"], "recorded_at", ["size", "ref_count", "orphaned", "stored_at"])
    return sync.merge_refcounts(held, ops).select("object_key", "size", "ref_count", "orphaned")


@_query(f"""WITH fi AS ({_held('files_index', 'rel_path', 'synced_at', 'rel_path, size, synced_at')}), oi AS ({_HELD_OBJECTS})
  SELECT n_files, n_objects, file_bytes, ref_bytes, object_bytes, file_bytes - object_bytes AS saved_bytes FROM (SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS file_bytes FROM fi),
  (SELECT count(*) AS n_objects, CAST(coalesce(sum(size * ref_count) FILTER (ref_count > 0), 0) AS BIGINT) AS ref_bytes, CAST(coalesce(sum(size) FILTER (ref_count > 0), 0) AS BIGINT) AS object_bytes FROM oi)""")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    held = latest(_t(spark, sf, "files_index").select("rel_path", "size", "synced_at"), ["rel_path"], "synced_at", ["size"])
    rows = _t(spark, sf, "objects_index").select(clean_key(F.col("object_key")).alias("object_key"), "recorded_at", "size", "ref_count")
    objects = latest(rows.where("object_key is not null"), ["object_key"], "recorded_at", ["size", "ref_count"])
    return upkeep.status(held, objects)


_BI = f"""{_F}, l AS (SELECT rel_path, size + CASE WHEN d = 1 THEN 7 ELSE 0 END AS size, mtime_ns + CASE WHEN d IN (1, 4) THEN 3000000000 WHEN d = 5 THEN 2000000000 WHEN d = 6 THEN 2000000001 ELSE 0 END AS mtime_ns FROM f WHERE d <> 2),
  r AS (SELECT rel_path, size + CASE WHEN d IN (3, 4) THEN 9 ELSE 0 END AS size, mtime_ns + CASE WHEN d IN (3, 4) THEN 5000000000 ELSE 0 END AS mtime_ns FROM f WHERE d <> 7),
  w AS (SELECT rel_path, size, mtime_ns FROM f WHERE d <> 8),
  c AS (SELECT rel_path, CASE WHEN l.rel_path IS NULL AND w.rel_path IS NOT NULL THEN 'deleted' WHEN l.rel_path IS NULL THEN 'none' WHEN w.rel_path IS NULL THEN 'new' WHEN l.size = w.size AND abs(l.mtime_ns - w.mtime_ns) <= 2000000000 THEN 'none' ELSE 'modified' END AS left_change,
    CASE WHEN r.rel_path IS NULL AND w.rel_path IS NOT NULL THEN 'deleted' WHEN r.rel_path IS NULL THEN 'none' WHEN w.rel_path IS NULL THEN 'new' WHEN r.size = w.size AND abs(r.mtime_ns - w.mtime_ns) <= 2000000000 THEN 'none' ELSE 'modified' END AS right_change,
    l.size AS l_size, r.size AS r_size, l.mtime_ns AS l_mtime, r.mtime_ns AS r_mtime, l.rel_path IS NOT NULL AS on_left, r.rel_path IS NOT NULL AS on_right
    FROM l FULL JOIN r USING (rel_path) FULL JOIN w USING (rel_path)),
  k AS (SELECT *, CASE WHEN left_change <> 'none' AND right_change <> 'none' THEN 'conflict' WHEN left_change <> 'none' THEN 'left' WHEN right_change <> 'none' THEN 'right' ELSE 'unchanged' END AS kind FROM c)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return bisync.bisync_changes(*derived.bisync_sides(_f(spark, sf)))


@_query(f"WITH {_BI} SELECT rel_path, left_change, right_change, l_size, r_size FROM c")
def bisync_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("rel_path", "left_change", "right_change", "l_size", "r_size")


@_query(f"""WITH {_BI} SELECT count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind = 'left' AND on_left) AS left_to_right, count(*) FILTER (kind = 'right' AND on_right) AS right_to_left,
  count(*) FILTER (kind = 'conflict') AS conflicts, count(*) FILTER (kind = 'right' AND NOT on_right) AS deleted_left, count(*) FILTER (kind = 'left' AND NOT on_left) AS deleted_right,
  CAST(coalesce(sum(CASE WHEN kind = 'left' AND on_left THEN l_size WHEN kind = 'right' AND on_right THEN r_size END), 0) AS BIGINT) AS bytes_copied FROM k""")
def bisync_stats(spark: SparkSession, sf: str) -> DataFrame:
    return bisync.bisync_stats(_changes(spark, sf))


def _copy(side: str, suffix: str = "") -> str:
    other = "right" if side == "left" else "left"
    return f"SELECT 'copy' AS op, '{side}' AS from_side, '{other}' AS to_side, rel_path, rel_path || '{suffix}' AS to_path, {side[0]}_size AS size, kind FROM k"


def _delete(side: str) -> str:
    return f"SELECT 'delete' AS op, NULL AS from_side, '{side}' AS to_side, rel_path, rel_path AS to_path, NULL AS size, kind FROM k"


_SETTLED = {
    "keep-both": [f"{_copy('left', '.conflict-left')} WHERE kind = 'conflict' AND on_left", f"{_copy('right', '.conflict-right')} WHERE kind = 'conflict' AND on_right"],
    "left-wins": [f"{_copy('left')} WHERE kind = 'conflict' AND on_left", f"{_delete('right')} WHERE kind = 'conflict' AND NOT on_left AND on_right"],
    "right-wins": [f"{_copy('right')} WHERE kind = 'conflict' AND on_right", f"{_delete('left')} WHERE kind = 'conflict' AND NOT on_right AND on_left"],
    "newer-wins": [f"{_copy('left')} WHERE kind = 'conflict' AND on_left AND on_right AND l_mtime > r_mtime", f"{_copy('right')} WHERE kind = 'conflict' AND on_left AND on_right AND l_mtime <= r_mtime"],
}


def _actions_sql(strategy: str) -> str:
    parts = _SETTLED[strategy] + [
        f"{_copy('left')} WHERE kind = 'left' AND on_left", f"{_delete('right')} WHERE kind = 'left' AND NOT on_left",
        f"{_copy('right')} WHERE kind = 'right' AND on_right", f"{_delete('left')} WHERE kind = 'right' AND NOT on_right",
    ]
    return f"SELECT CASE WHEN kind = 'conflict' THEN 0 WHEN op = 'copy' THEN 1 ELSE 2 END AS phase, op, from_side, to_side, rel_path, to_path, CAST(size AS BIGINT) AS size FROM ({' UNION ALL '.join(parts)})"


def _add_bisync(strategy: str) -> None:
    name = strategy.replace("-", "_")

    def actions(spark: SparkSession, sf: str) -> DataFrame:
        return bisync.bisync_actions(_changes(spark, sf), strategy)

    QUERIES[f"bisync_actions_{name}"] = actions
    ORACLE[f"bisync_actions_{name}"] = f"WITH {_BI} {_actions_sql(strategy)}"


for _s in bisync.STRATEGIES:
    _add_bisync(_s)


@_query(f"WITH {_BI} SELECT rel_path, left_change, right_change FROM c")
def bisync_own_index(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's own state file on the sides is no file of theirs."""
    left, right, *was = derived.bisync_sides(_f(spark, sf))
    own = spark.createDataFrame([(bisync.OWN_INDEX, 1, 2)], "rel_path string, size bigint, mtime_ns bigint")
    return bisync.bisync_changes(left.unionByName(own), right.unionByName(own), *was).select("rel_path", "left_change", "right_change")


def _final_sql(side: str, strategy: str = "newer-wins") -> str:
    s, o = side[0], "r" if side == "left" else "l"
    return f"""WITH {_BI}, a AS ({_actions_sql(strategy)}), came AS (SELECT a.to_path AS rel_path, k.{o}_size AS size, k.{o}_mtime AS mtime_ns FROM a JOIN k USING (rel_path) WHERE op = 'copy' AND to_side = '{side}')
      SELECT rel_path, {s}_size AS size, {s}_mtime AS mtime_ns FROM k WHERE on_{side} AND rel_path NOT IN (SELECT rel_path FROM came) AND rel_path NOT IN (SELECT rel_path FROM a WHERE op = 'delete' AND to_side = '{side}') UNION ALL SELECT * FROM came"""


@_query(_final_sql("left"))
def bisync_final_left(spark: SparkSession, sf: str) -> DataFrame:
    c = _changes(spark, sf)
    return bisync.final_state("left", c, bisync.bisync_actions(c, "newer-wins"))


@_query(_final_sql("right"))
def bisync_final_right(spark: SparkSession, sf: str) -> DataFrame:
    c = _changes(spark, sf)
    return bisync.final_state("right", c, bisync.bisync_actions(c, "newer-wins"))


@_query(_final_sql("left", "keep-both"))
def bisync_final_left_keep_both(spark: SparkSession, sf: str) -> DataFrame:
    c = _changes(spark, sf)
    return bisync.final_state("left", c, bisync.bisync_actions(c, "keep-both"))


@_query(_final_sql("right", "keep-both"))
def bisync_final_right_keep_both(spark: SparkSession, sf: str) -> DataFrame:
    c = _changes(spark, sf)
    return bisync.final_state("right", c, bisync.bisync_actions(c, "keep-both"))


_VE = f"""{_FI}, ix AS (SELECT rel_path, object_key FROM fi UNION ALL SELECT '../' || doc_id, object_key FROM f WHERE doc_id % 100 = 1),
  tg AS (SELECT rel_path, CASE WHEN doc_id % 10 = 8 AND rel_path NOT LIKE 'gone/%' THEN 'md5:corrupt' ELSE nullif(object_key, '') END AS object_key FROM fi WHERE doc_id % 10 <> 9),
  v AS (SELECT ix.rel_path, CASE WHEN ix.rel_path LIKE '../%' THEN 'escape' WHEN tg.rel_path IS NULL THEN 'missing' WHEN tg.object_key IS NULL THEN 'read_error' WHEN tg.object_key = ix.object_key THEN 'ok' ELSE 'mismatch' END AS verdict FROM ix LEFT JOIN tg ON tg.rel_path = ix.rel_path)"""


@_query(f"WITH {_VE} SELECT * FROM v")
def verify_report(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return upkeep.verify_report(derived.verify_index(f), derived.verify_target(f))


@_query(f"WITH {_VE} SELECT count(*) AS checked, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict IN ('mismatch', 'read_error', 'escape')) AS failed FROM v")
def verify_stats(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.verify_stats(verify_report(spark, sf))


@_query(f"WITH {_FI} SELECT rel_path FROM f WHERE rel_path NOT IN (SELECT rel_path FROM fi)")
def verify_unindexed(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return upkeep.unindexed(derived.files_index(f), f)


_RX = f"{_F}, rx AS (SELECT rel_path, size, mtime_ns, object_key, doc_id % 2 = 0 AS linked FROM f)"


@_query(f"WITH {_RX} SELECT * FROM rx")
def reindex_files(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return upkeep.reindex_files(derived.reindex_target(f), derived.reindex_inodes(f))


@_query(f"WITH {_RX} SELECT * FROM rx")
def reindex_metadata_dir(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's own folder on the target is left out."""
    f = _f(spark, sf)
    target = derived.reindex_target(f)
    own = target.withColumn("rel_path", F.concat(F.lit(".siltstone/objects/"), "rel_path"))
    return upkeep.reindex_files(target.unionByName(own), derived.reindex_inodes(f))


@_query(f"WITH {_RX} SELECT object_key, max(size) AS size, CAST(count(*) AS INTEGER) AS ref_count, false AS orphaned FROM rx GROUP BY 1")
def reindex_objects(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.reindex_objects(reindex_files(spark, sf)).select("object_key", "size", "ref_count", "orphaned")


_PR = f"""{_OI}, ph AS (SELECT object_key FROM oi WHERE object_key NOT LIKE 'md5:f%' UNION ALL SELECT 'md5:' || md5('stray' || doc_id) FROM f WHERE doc_id % 100 = 0),
  pr AS (SELECT object_key, 'orphan' AS reason FROM oi WHERE ref_count = 0 UNION ALL SELECT DISTINCT object_key, 'unindexed' FROM ph WHERE object_key NOT IN (SELECT object_key FROM oi))"""


@_query(f"WITH {_PR} SELECT * FROM pr")
def prune_plan(spark: SparkSession, sf: str) -> DataFrame:
    f = _f(spark, sf)
    return upkeep.prune_plan(derived.objects_index(f), derived.physical_objects(f))


@_query(f"WITH {_PR} SELECT (SELECT count(*) FROM oi) AS scanned, count(*) AS deleted FROM pr")
def prune_stats(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.prune_stats(derived.objects_index(_f(spark, sf)), prune_plan(spark, sf))


@_query(f"SELECT object_key, 'orphan' AS reason FROM ({_HELD_OBJECTS}) WHERE coalesce(ref_count = 0, false) OR coalesce(orphaned, false)")
def prune_released(spark: SparkSession, sf: str) -> DataFrame:
    """Released objects of the tables' own index."""
    return held_objects(_t(spark, sf, "objects_index")).where("released").select("object_key", F.lit("orphan").alias("reason"))


# The planners over the rows that hold of the delivered tables: other spellings, superseded rows, nulls, heavy keys
def _side(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = with_clean_path(_t(spark, sf, name).where("path <> ''").select("path", "size", "mtime_ns", clean_key(F.col("hash")).alias("object_key"), "recorded_at"), "path").where("path <> ''")
    return latest(rows, ["path"], "recorded_at", ["size", "mtime_ns", "object_key"]).withColumnRenamed("path", "rel_path")


def _side_sql(name: str) -> str:
    return f"SELECT path AS rel_path, size, mtime_ns, object_key FROM ({_held(name, 'path', 'recorded_at', _path('path') + ' AS path, size, mtime_ns, ' + _key('hash') + ' AS object_key, recorded_at', "path <> ''")}) WHERE path <> ''"


_SIDES = f"f AS ({_side_sql('left_states')}), fi AS ({_side_sql('right_states')})"
_SIDES_PLAN = """SELECT f.rel_path, f.size, f.mtime_ns, f.object_key, i.object_key AS old_object_key, CASE
  WHEN f.size = i.size AND i.object_key IS NOT NULL AND abs(f.mtime_ns - i.mtime_ns) <= 2000000000 THEN 'skip' WHEN f.object_key IS NULL THEN 'skip_error'
  WHEN f.size = i.size AND f.object_key = i.object_key AND abs(f.mtime_ns - i.mtime_ns) > 2000000000 THEN 'touch' ELSE 'copy' END AS action
  FROM f LEFT JOIN fi i ON i.rel_path = f.rel_path"""


@_query(f"WITH {_SIDES} {_SIDES_PLAN}")
def sync_plan_held(spark: SparkSession, sf: str) -> DataFrame:
    """The left side copied onto the right one."""
    return sync.sync_plan(_side(spark, sf, "left_states"), _side(spark, sf, "right_states"))


@_query(f"WITH {_SIDES} SELECT rel_path FROM fi WHERE rel_path NOT IN (SELECT rel_path FROM f)")
def sync_source_deleted_held(spark: SparkSession, sf: str) -> DataFrame:
    return sync.source_deleted(_side(spark, sf, "left_states"), _side(spark, sf, "right_states"))


_SCANNED = _held("manifest", "rel_path", "scanned_at", f"{_path('rel_path')} AS rel_path, size, mtime_ns, scanned_at", "rel_path <> ''")


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of manifest that hold."""
    rows = with_clean_path(_t(spark, sf, "manifest").where("rel_path <> ''").select("rel_path", "size", "mtime_ns", "scanned_at"), "rel_path")
    return latest(rows, ["rel_path"], "scanned_at", ["size", "mtime_ns"])


@_query(f"""WITH m AS ({_SCANNED}), fi AS ({_HELD_FILES}) SELECT m.rel_path, CASE WHEN m.size = fi.size AND fi.object_key IS NOT NULL AND abs(m.mtime_ns - fi.mtime_ns) <= 2000000000 THEN 'skip' ELSE 'skip_error' END AS action
  FROM m LEFT JOIN fi ON fi.rel_path = m.rel_path""")
def sync_plan_scanned(spark: SparkSession, sf: str) -> DataFrame:
    """The scan of the posts' files against the index, before anything is read: what is not skipped has to be."""
    return sync.sync_plan(_scanned(spark, sf).withColumn("object_key", F.lit(None).cast("string")), _files(spark, sf)).select("rel_path", "action")


@_query(f"SELECT rel_path FROM ({_HELD_FILES}) WHERE rel_path NOT IN (SELECT rel_path FROM ({_SCANNED}))")
def sync_source_deleted_scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed files that the scan of the posts' files has not."""
    return sync.source_deleted(_scanned(spark, sf), _files(spark, sf))


def _turn(now: str, was: str) -> str:
    same = f"{now}.size = {was}.size AND abs({now}.mtime_ns - {was}.mtime_ns) <= 2000000000"
    return f"CASE WHEN {now}.rel_path IS NULL THEN 'deleted' WHEN {was}.rel_path IS NULL THEN 'new' WHEN {same} THEN 'none' ELSE 'modified' END"


@_query(f"WITH {_SIDES} SELECT rel_path, {_turn('f', 'fi')} AS left_change, {_turn('fi', 'f')} AS right_change FROM f FULL JOIN fi USING (rel_path)")
def bisync_changes_held(spark: SparkSession, sf: str) -> DataFrame:
    """Each side against what the other one holds as its earlier state."""
    left, right = _side(spark, sf, "left_states"), _side(spark, sf, "right_states")
    return bisync.bisync_changes(left, right, right, left).select("rel_path", "left_change", "right_change")


@_query(f"""SELECT f.rel_path, CASE WHEN fi.rel_path IS NULL THEN 'missing' WHEN fi.object_key IS NULL THEN 'read_error' WHEN fi.object_key = f.object_key THEN 'ok' ELSE 'mismatch' END AS verdict
  FROM ({_side_sql('left_states')}) f LEFT JOIN ({_side_sql('right_states')}) fi ON fi.rel_path = f.rel_path""")
def verify_report_held(spark: SparkSession, sf: str) -> DataFrame:
    """The left side's record checked against what the right side holds."""
    return upkeep.verify_report(_side(spark, sf, "left_states"), _side(spark, sf, "right_states"))


@_query(f"""WITH k AS (SELECT size, rel_path > min(rel_path) OVER (PARTITION BY object_key) OR object_key IN (SELECT object_key FROM ({_HELD_OBJECTS})) AS known
  FROM (SELECT CAST(task_id AS VARCHAR) AS rel_path, * FROM {_TASK}) WHERE object_key IS NOT NULL)
  SELECT count(*) AS copied, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (known), 0) AS BIGINT) AS dedup_saved FROM k""")
def sync_report_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Each task with a key carried out once; one key holds about a tenth of them."""
    tasks = _t(spark, sf, "copy_tasks").groupBy("task_id").agg(F.max(clean_key(F.col("object_key"))).alias("object_key"), F.max("size").alias("size"))
    plan = tasks.where("object_key is not null").select(F.col("task_id").cast("string").alias("rel_path"), "object_key", "size", F.lit("copy").alias("action"))
    return sync.sync_report(plan, held_objects(_t(spark, sf, "objects_index")))


@_query(f"""WITH o AS ({_HELD_OBJECTS}) SELECT object_key, 'orphan' AS reason FROM o WHERE ref_count = 0
  UNION ALL SELECT DISTINCT {_key('object_key')}, 'unindexed' FROM copy_tasks WHERE {_key('object_key')} IS NOT NULL AND {_key('object_key')} NOT IN (SELECT object_key FROM o)""")
def prune_plan_held(spark: SparkSession, sf: str) -> DataFrame:
    """The objects that the tasks stored against the tables' own index."""
    raw = _t(spark, sf, "objects_index").select(clean_key(F.col("object_key")).alias("object_key"), "recorded_at", "ref_count")
    stored = _t(spark, sf, "copy_tasks").select(clean_key(F.col("object_key")).alias("object_key")).where("object_key is not null")
    return upkeep.prune_plan(latest(raw, ["object_key"], "recorded_at", ["ref_count"]), stored)


_HEX = "CASE WHEN starts_with(object_key, 'h3:') THEN substr(object_key, 4) ELSE object_key END"
_OK = f"regexp_full_match({_HEX}, '[0-9A-Fa-f]{{4,}}')"


@_query(f"SELECT object_key, CASE WHEN {_OK} THEN 'objects/' || substr({_HEX}, 1, 2) || '/' || substr({_HEX}, 1, 4) || '/' || {_HEX} ELSE '' END AS object_path, regexp_full_match(object_key, 'h3:[0-9A-Fa-f]{{4,}}') AS is_valid FROM objects_index")
def object_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("object_key")
    return _t(spark, sf, "objects_index").select(k, files.object_path("objects", k, "h3:").alias("object_path"), files.valid_key(k, "h3:").alias("is_valid"))


@_query(f"SELECT bucket, count(*) AS n_objects FROM (SELECT CASE WHEN {_OK} THEN substr({_HEX}, 1, 2) ELSE '' END AS bucket FROM objects_index) GROUP BY 1")
def object_buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = files.object_bucket(F.col("object_key"), "h3:", 2).alias("bucket")
    return _t(spark, sf, "objects_index").groupBy(b).agg(F.count(F.lit(1)).alias("n_objects"))


def _scaled(unit: str, power: int) -> str:
    return f"printf('%.1f {unit}', round_even(size / {float(1 << power)}, 1))"


@_query(f"SELECT DISTINCT size, CASE WHEN size >= 1073741824 THEN {_scaled('GiB', 30)} WHEN size >= 1048576 THEN {_scaled('MiB', 20)} WHEN size >= 1024 THEN {_scaled('KiB', 10)} ELSE printf('%d B', size) END AS spelled FROM objects_index WHERE size IS NOT NULL")
def format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _t(spark, sf, "objects_index").where("size is not null").select("size").distinct()
    return sizes.select("size", files.human_bytes(F.col("size")).alias("spelled"))


@_query("SELECT task_id, size <= 1048576 AS small_only, true AS always FROM (SELECT task_id, max(size) AS size FROM copy_tasks GROUP BY 1) WHERE size IS NOT NULL")
def should_verify(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "copy_tasks").groupBy("task_id").agg(F.max("size").alias("size")).where("size is not null")
    s = F.col("size")
    return t.select("task_id", files.should_verify(s, False, True).alias("small_only"), files.should_verify(s, True, False).alias("always"))


@_query("""SELECT rel_path, CASE WHEN strlen(plain) > 150 THEN left(plain, 141) || '_' || substr(sha1(name), 1, 8) ELSE plain END AS safe_name FROM (SELECT rel_path, name, replace(name, '/', '_') AS plain FROM (
  SELECT DISTINCT rel_path, CASE WHEN size > 100000 THEN repeat('x/', 90) ELSE rel_path END AS name FROM files_index WHERE size IS NOT NULL))""")
def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("size") > 100000, F.repeat(F.lit("x/"), 90)).otherwise(F.col("rel_path"))
    return _t(spark, sf, "files_index").where("size is not null").select("rel_path", name.alias("name")).distinct().select("rel_path", files.sanitized(F.col("name")).alias("safe_name"))


_L, _R = (_held(t, "path", "recorded_at", f"{_path('path')} AS path, size, mtime_ns, recorded_at", "path <> ''") for t in ("left_states", "right_states"))


@_query(f"SELECT path, abs(l.mtime_ns - r.mtime_ns) <= 2000000000 AS is_close, l.size = r.size AND abs(l.mtime_ns - r.mtime_ns) <= 2000000000 AS is_unchanged FROM ({_L}) l JOIN ({_R}) r USING (path)")
def mtime_close(spark: SparkSession, sf: str) -> DataFrame:
    def side(name: str, s: str) -> DataFrame:
        rows = with_clean_path(_t(spark, sf, name).where("path <> ''").select("path", "size", "mtime_ns", "recorded_at"), "path")
        return latest(rows, ["path"], "recorded_at", ["size", "mtime_ns"]).select("path", F.col("size").alias(f"{s}_size"), F.col("mtime_ns").alias(f"{s}_mtime"))

    j = side("left_states", "l").join(side("right_states", "r"), "path")
    close = files.mtime_close(F.col("l_mtime"), F.col("r_mtime"))
    return j.select("path", close.alias("is_close"), files.unchanged(F.col("l_size"), F.col("l_mtime"), F.col("r_size"), F.col("r_mtime")).alias("is_unchanged"))
