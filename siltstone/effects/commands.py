"""The commands: plan with DataFrames, act in parallel, commit the new state.

State lives below the target's metadata folder: ``files`` (per path) and ``objects`` (per key), which change in one commit. The
rows that acting returns are written before anything reads them, so a lost executor repeats at most what its own tasks were
doing, and every step can be repeated. A file's failure is a row, never an exception; reports show the first ``SHOWN`` of them
and have all in a table.
"""

from __future__ import annotations

import os
import shutil
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.effects import links, store
from siltstone.effects.lock import Lock
from siltstone.effects.progress import Reporter, Watch
from siltstone.functions.hashing import file_key, hashed
from siltstone.plans import bisync as bi
from siltstone.plans import dedup as dd
from siltstone.plans import sync as sy
from siltstone.plans import upkeep
from siltstone.session import written
from siltstone.sources.config import WORKERS, Config
from siltstone.sources.scan import files_of, folders_of, physical_objects, scan
from siltstone.streaming.state import Snapshots, State, Table

FILES = "rel_path string, size bigint, mtime_ns bigint, object_key string, synced_at timestamp"
OBJECTS = "object_key string, size bigint, ref_count int, stored_at timestamp_ntz, orphaned boolean"
STATES = "rel_path string, size bigint, mtime_ns bigint, hash string"
#: Rows of errors and warnings that a report lists, by path; its tables have all.
SHOWN = 1000
_RESULT = "rel_path string, object_key string, old_object_key string, status string, existed boolean, size bigint, mtime_ns bigint, error string, warning string"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

Rows = Iterator[list[dict]]


@dataclass
class Index:
    state: State
    files: Table
    objects: Table


def index_of(spark: SparkSession, target: str) -> Index:
    state = State(spark, os.path.join(target, store.METADATA, "index"), {"files": (FILES, "rel_path"), "objects": (OBJECTS, "object_key")})
    return Index(state, state.table("files"), state.table("objects"))


def _carried_out(rows: DataFrame, act: Callable[[Rows], Rows], schema: str) -> DataFrame:
    """What acting on ``rows`` returned; reading it never acts again."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in act(b.to_pylist() for b in batches):
            yield pa.RecordBatch.from_pylist(done, schema=fields)

    return written(rows.mapInArrow(run, schema))


def _first(rows: DataFrame, by: str = "rel_path") -> list:
    return rows.orderBy(by).limit(SHOWN).collect()


def _manifest(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    """The files of all sources, and the folders to have below the target."""
    parts, folders = [], spark.createDataFrame([(s.dest,) for s in config.sources], "rel_path string")
    for s in config.sources:
        listing = written(scan(spark, s.src, config.exclude))
        folders = folders.unionByName(folders_of(listing).select(F.concat(F.lit(f"{s.dest}/"), "rel_path").alias("rel_path")))
        parts.append((files_of(listing).select("rel_path", "abs_path", "size", "mtime_ns"), s.dest))
    return sy.union_sources(parts), folders


def sync(spark: SparkSession, config: Config, dry_run: bool = False, stop: threading.Event | None = None, on_event: Callable[[dict], None] | None = None) -> dict:
    """Copies what is new or changed; ``dry_run`` returns the plan and acts on nothing.

    Metadata is compared first, so content is read only for candidates. Refuses to start without the space it needs.
    Once ``stop`` is set no further file is begun: the rest counts as skipped, what is finished is committed.
    ``on_event`` gets rel_path, status, error, bytes of each file when it is done, failed ones at once.
    """
    target = config.target_root
    if dry_run:
        return _sync(spark, config, index_of(spark, target), True, None)
    with Lock(os.path.join(target, store.METADATA)), Watch(os.path.join(target, store.METADATA), stop, on_event) as watch:
        return _sync(spark, config, index_of(spark, target), False, watch)


def _sync(spark: SparkSession, config: Config, index: Index, dry_run: bool, watch: Watch | None) -> dict:
    target = config.target_root
    manifest, folders = _manifest(spark, config)
    old, fast = index.files.read(), config.on("metadata_fast_skip")
    # a stand-in key, to let the metadata decide who needs reading
    first = sy.sync_plan(manifest.withColumn("object_key", F.lit("?")), old, fast)
    skipped = first.where("action = 'skip'").count()
    candidates = manifest.join(first.where("action <> 'skip'").select("rel_path"), "rel_path", "left_semi")
    read = written(hashed(candidates).select("rel_path", "abs_path", "size", "mtime_ns", "object_key", "hash_error"))
    plan = written(sy.sync_plan(read, old, False).join(read.select("rel_path", "abs_path", "hash_error"), "rel_path"))
    unreadable = plan.where("action = 'skip_error'").select("rel_path", "hash_error")
    touches = plan.where("action = 'touch'")
    n = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    report = {
        "copied": 0, "skipped": skipped + n.get("touch", 0) + n.get("skip_error", 0), "failed": 0, "cancelled": 0, "bytes": 0, "dedup_saved": 0, "errors": [], "locked": [],
        "unreadable": [(r["rel_path"], r["hash_error"]) for r in _first(unreadable)], "plan": plan,
    }
    if dry_run:
        return report

    def make(batches: Rows) -> Rows:
        for b in batches:
            yield [{"warning": w} for w in (store.make_folder(target, t["rel_path"]) for t in b) if w]

    no_folder = _carried_out(folders, make, "warning string")
    mode = store.detect_mode(target)
    copies = plan.where("action = 'copy'")
    need = (sy.space_hardlink(copies, index.objects.read()) if mode == store.HARDLINK else sy.space_copy(copies, config.workers)).first()[0]
    if need > store.free_space(target):
        raise OSError(f"{need} bytes needed at {target}, {store.free_space(target)} free")
    verify, small, stamp, news, tell = config.on("verify"), config.on("verify_small_files"), store.timestamp(), watch.folder, watch.on_event is not None

    def take_in(batches: Rows) -> Rows:
        r = Reporter(news, False)
        for b in batches:
            yield [{"rel_path": t["rel_path"], "stored": s} for t in b if not r.stopped() and (s := store.store_one(t, target, mode)) is not None]

    def act(batches: Rows) -> Rows:
        r = Reporter(news, tell)
        for b in batches:
            rows = []
            for t in b:
                if r.stopped():
                    rows.append({"rel_path": t["rel_path"], "object_key": t["object_key"], "status": "cancelled"})
                    continue
                rows.append(store.copy_one(t, target, mode, verify or (small and t["size"] <= 1 << 20), stamp))
                r.done(t["rel_path"], rows[-1]["status"], rows[-1]["error"], rows[-1]["size"])
            yield rows
        r.close()

    # a key's content is taken in once, by its first path; then its copies are placed by as many tasks as there are workers
    heads = copies.groupBy("object_key").agg(F.min(F.struct("rel_path", "abs_path", "size", "mtime_ns")).alias("head")).select("object_key", "head.*")
    stored = _carried_out(heads.repartition(config.workers, "object_key"), take_in, "rel_path string, stored boolean")
    tasks = copies.select("rel_path", "abs_path", "object_key", "old_object_key", "size", "mtime_ns").join(stored, "rel_path", "left")
    done = _carried_out(tasks.repartition(config.workers, "rel_path"), act, _RESULT)
    ok = done.where("status = 'copied'")
    now = F.current_timestamp()
    totals = done.agg(
        F.count_if(F.col("status") == "copied"), F.count_if(F.col("status") == "failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "copied", F.col("size"))), F.lit(0)),
        F.coalesce(F.sum(F.when((F.col("status") == "copied") & F.col("existed"), F.col("size"))), F.lit(0)), F.count_if(F.col("status") == "cancelled"),
    ).first()
    if totals[0] or n.get("touch"):
        puts = ok.select("rel_path", "size", "mtime_ns", "object_key", now.alias("synced_at")).unionByName(touches.select("rel_path", "size", "mtime_ns", "object_key", now.alias("synced_at")))
        moved = ok.select("rel_path", "old_object_key", "object_key", "size")
        keys = moved.select("object_key").unionByName(moved.select(F.col("old_object_key").alias("object_key"))).distinct()
        changed = sy.merge_refcounts(index.objects.read().join(keys, "object_key", "left_semi"), moved)
        index.state.commit(puts={"files": puts, "objects": changed})
    if mode == store.COPY:
        def clear(batches: Rows) -> Rows:
            for b in batches:
                for t in b:
                    store.remove_temporary(os.path.join(target, store.METADATA, "objects"), t["object_key"], mode)
                yield []

        _carried_out(copies.select("object_key").unionByName(done.select("object_key")).where("object_key is not null").distinct(), clear, "object_key string")
    report |= {"copied": totals[0], "failed": totals[1], "bytes": totals[2], "dedup_saved": totals[3], "cancelled": totals[4], "skipped": report["skipped"] + totals[4], "results": done}
    report["errors"] = [(r["rel_path"], r["error"]) for r in _first(done.where("status = 'failed'").select("rel_path", "error"))]
    report["locked"] = [r["rel_path"] for r in _first(done.where("status = 'locked'").select("rel_path"))]
    warnings = no_folder.unionByName(ok.where("warning is not null").select("warning"))
    report["warnings"] = [r["warning"] for r in _first(warnings, "warning")]
    return report


def status(spark: SparkSession, target: str) -> dict:
    i = index_of(spark, target)
    return upkeep.status(i.files.read(), i.objects.read()).first().asDict()


def _hashed_target(spark: SparkSession, target: str) -> DataFrame:
    listing = files_of(scan(spark, target, [store.METADATA, f"{store.METADATA}/**"]))
    return hashed(listing)


def verify(spark: SparkSession, target: str) -> dict:
    """checked, missing, failed, and the rows that are not ok. Only indexed files are read."""
    index = index_of(spark, target).files.read()
    listing = files_of(scan(spark, target, [store.METADATA, f"{store.METADATA}/**"])).join(index.select("rel_path"), "rel_path", "left_semi")
    rows = written(upkeep.verify_report(index, hashed(listing)))
    out = upkeep.verify_stats(rows).first().asDict()
    return out | {"errors": [(r["rel_path"], r["verdict"]) for r in _first(rows.where("verdict <> 'ok'"))], "verdicts": rows}


def reindex(spark: SparkSession, target: str) -> dict:
    """Rebuilds the index from what is there; files linked to objects are not read."""
    with Lock(os.path.join(target, store.METADATA)):
        i = index_of(spark, target)
        objects = physical_objects(spark, os.path.join(target, store.METADATA, "objects"))
        listing = written(files_of(scan(spark, target, [store.METADATA, f"{store.METADATA}/**"])))
        inodes = objects.where("ino is not null").select("dev", "ino").distinct()
        linked = listing.join(inodes, ["dev", "ino"], "left_semi").withColumn("object_key", F.lit(None).cast("string")).withColumn("hash_error", F.lit(None).cast("string"))
        read = written(linked.unionByName(hashed(listing.join(inodes, ["dev", "ino"], "left_anti")).select(*linked.columns)))
        files = written(upkeep.reindex_files(read, objects, store.METADATA))
        good = files.where("object_key is not null")
        i.state.commit(whole={
            "files": good.select("rel_path", "size", "mtime_ns", "object_key", (F.col("mtime_ns") / 1e9).cast("timestamp").alias("synced_at")),
            "objects": upkeep.reindex_objects(good),
        })
        return {"files": good.count(), "objects": i.objects.read().count(), "failed": files.count() - good.count()}


def prune(spark: SparkSession, target: str, dry_run: bool = False) -> dict:
    """Deletes objects without references and stored files without a record; idempotent after a crash."""
    with Lock(os.path.join(target, store.METADATA)):
        i, root = index_of(spark, target), os.path.join(target, store.METADATA, "objects")
        objects = i.objects.read()
        plan = written(upkeep.prune_plan(objects, physical_objects(spark, root)))
        out = upkeep.prune_stats(objects, plan).first().asDict() | {"failed": 0}
        if dry_run:
            return out

        def act(batches: Rows) -> Rows:
            for b in batches:
                failed = []
                for t in b:
                    try:
                        store.delete_object(root, t["object_key"])
                    except (OSError, ValueError):
                        failed.append(t)
                yield failed

        failed = _carried_out(plan.select("object_key"), act, "object_key string")
        out["failed"] = failed.count()
        out["deleted"] -= out["failed"]
        gone = plan.where("reason = 'orphan'").join(failed, "object_key", "left_anti").select("object_key")
        i.objects.merge(deletes=gone)
        return out


def dedup(spark: SparkSession, root: str, exclude: list[str] | None = None, state_folder: str | None = None, dry_run: bool = False, readonly: bool = False) -> dict:
    """Links duplicate files of a folder. With ``state_folder`` hashes of unchanged files are remembered between runs.

    Files that changed after the scan are left as they are and listed as errors.
    """
    listing = written(files_of(scan(spark, root, exclude)))
    state = Snapshots(spark, state_folder, STATES, "rel_path") if state_folder else None
    columns = ["rel_path", "abs_path", "size", "mtime_ns", "dev", "ino"]
    if state:
        old = state.read()
        fresh = hashed(dd.to_hash(listing.select(*columns), old), to="hash").select(*columns, "hash")
        known = dd.with_cached_hash(listing.select(*columns), old).where("cached_hash is not null").withColumnRenamed("cached_hash", "hash")
        files = written(known.unionByName(fresh))
    else:
        files = written(hashed(dd.size_candidates(listing.select(*columns)), to="hash").select(*columns, "hash"))
    groups = written(dd.duplicate_groups(files))
    out = dd.dedup_stats(groups, listing).first().asDict() | {"deduped_files": 0, "linked_bytes": 0, "readonly_failed": 0, "errors": []}
    if not dry_run and store.detect_mode(root) == store.HARDLINK:
        plan = dd.link_plan(files, groups)

        def act(batches: Rows) -> Rows:
            for b in batches:
                groups: dict[links.Seen, list[links.Seen]] = {}
                for t in b:
                    head = links.Seen(os.path.join(root, t["representative"]), t["size"], t["head_mtime_ns"])
                    groups.setdefault(head, []).append(links.Seen(os.path.join(root, t["rel_path"]), t["size"], t["mtime_ns"]))
                done = [(head, links.link_group(head, others, readonly)) for head, others in groups.items()]
                yield [{"linked": len(r["linked"]), "bytes": len(r["linked"]) * head.size, "failed": r["readonly_failed"], "errors": r["errors"]} for head, r in done]

        # by path: the files of a large group are linked by many tasks
        done = _carried_out(plan.repartition("rel_path"), act, "linked bigint, bytes bigint, failed bigint, errors array<string>")
        s = done.agg(F.sum("linked"), F.sum("bytes"), F.sum("failed")).first()
        errors = done.select(F.explode("errors").alias("error"))
        out |= {"deduped_files": s[0] or 0, "linked_bytes": s[1] or 0, "readonly_failed": s[2] or 0, "results": done}
        out["errors"] = [r["error"] for r in _first(errors, "error")]
    if state and not dry_run:
        state.overwrite(files.where("hash is not null").select("rel_path", "size", "mtime_ns", "hash"))
    return out


def bisync(spark: SparkSession, left: str, right: str, state_folder: str, strategy: str = "keep-both", exclude: list[str] | None = None, dry_run: bool = False, workers: int = WORKERS) -> dict:
    """Reconciles two folders; ``state_folder`` remembers both sides of the last run, in one commit."""
    roots = {"left": left, "right": right}
    state = State(spark, state_folder, {s: (STATES, "rel_path") for s in roots})
    now = {s: written(files_of(scan(spark, r, exclude)).select("rel_path", "size", "mtime_ns")) for s, r in roots.items()}
    changes = written(bi.bisync_changes(now["left"], now["right"], state.read("left"), state.read("right")))
    actions = written(bi.bisync_actions(changes, strategy))
    out = bi.bisync_stats(changes).first().asDict() | {"errors": [], "actions": actions}
    if dry_run:
        return out | {"bytes_copied": 0}

    def act(batches: Rows) -> Rows:
        for b in batches:
            errors = []
            for t in b:
                try:
                    to = os.path.join(roots[t["to_side"]], t["to_path"])
                    if not store.within(roots[t["to_side"]], to):
                        raise OSError(0, "leaves the folder")
                    if t["op"] == "delete":
                        if os.path.lexists(to):
                            os.unlink(to)
                    else:
                        src = os.path.join(roots[t["from_side"]], t["rel_path"])

                        def make(draft: str, src: str = src) -> None:
                            shutil.copyfile(src, draft)
                            s = os.stat(src)
                            os.utime(draft, ns=(s.st_mtime_ns, s.st_mtime_ns))

                        store._replace_with(make, to)
                except OSError as e:
                    errors.append({"rel_path": t["to_path"], "side": t["to_side"], "error": str(e.strerror)})
            yield errors

    failed = None
    for phase in (0, 1, 2):  # conflicts, copies, deletes
        part = _carried_out(actions.where(F.col("phase") == phase).repartition(workers, "to_path"), act, "rel_path string, side string, error string")
        failed = part if failed is None else failed.unionByName(part)
    out |= {"errors": [(r["rel_path"], r["error"]) for r in _first(failed)], "failures": failed}
    final = {}
    for side in roots:
        bad = failed.where(F.col("side") == side).select("rel_path").distinct()
        final[side] = bi.final_state(side, changes, actions).withColumn("hash", F.lit(None).cast("string")).join(bad, "rel_path", "left_anti")
    state.commit(whole=final)
    return out


__all__ = ["bisync", "dedup", "file_key", "prune", "reindex", "status", "sync", "verify"]
