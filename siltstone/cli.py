"""python -m siltstone.cli COMMAND ...; exit code 1 when files failed or are missing."""

from __future__ import annotations

import argparse
import signal
import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from siltstone.effects import commands
from siltstone.effects.report import human, sync_text
from siltstone.plans.bisync import STRATEGIES
from siltstone.sources.config import WORKERS, Config, load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sync")
    s.add_argument("--config", default="config.yaml")
    s.add_argument("--workers", type=int)
    for flag in ("dry-run", "verify", "no-verify", "no-small-verify", "no-metadata-fast-skip"):
        s.add_argument(f"--{flag}", action="store_true")
    for name in ("status", "verify", "reindex", "prune"):
        c = sub.add_parser(name)
        c.add_argument("--target", required=True)
        if name == "prune":
            c.add_argument("--dry-run", action="store_true")
    d = sub.add_parser("dedup")
    d.add_argument("folder")
    d.add_argument("--index")
    d.add_argument("--exclude", action="append", default=[])
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--readonly", action="store_true")
    b = sub.add_parser("bisync")
    b.add_argument("--left", required=True)
    b.add_argument("--right", required=True)
    b.add_argument("--state", required=True)
    b.add_argument("--conflict", choices=STRATEGIES, default="keep-both")
    b.add_argument("--workers", type=int, default=WORKERS)
    b.add_argument("--exclude", action="append", default=[])
    b.add_argument("--dry-run", action="store_true")
    return p


def _telling() -> Callable[[dict], None]:
    """Prints how many files are done and the last one, a few times a second; failures always."""
    done, last = 0, 0.0

    def on_event(e: dict) -> None:
        nonlocal done, last
        done += 1
        if e["error"] or done == 1 or time.monotonic() - last > 0.2:
            last = time.monotonic()
            print(f"[{done}] {e['status']} {e['rel_path']}", file=sys.stderr)

    return on_event


def _sync(spark: SparkSession, config: Config, dry_run: bool) -> dict:
    """Interrupting it ends the sync after the files that are being copied."""
    stop, main_thread = threading.Event(), threading.current_thread() is threading.main_thread()
    before = {s: signal.signal(s, lambda *_: stop.set()) for s in (signal.SIGINT, signal.SIGTERM)} if main_thread else {}
    try:
        return commands.sync(spark, config, dry_run, stop, _telling())
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
    if a.command == "sync":
        with open(a.config) as f:
            config = load(f.read())
        config.workers = a.workers or config.workers
        config.override_verify(a.verify, a.no_verify)
        if a.no_small_verify:
            config.verify_small_files = False
        if a.no_metadata_fast_skip:
            config.metadata_fast_skip = False
        r = _sync(spark, config, a.dry_run)
        if a.dry_run:
            for row in r["plan"].where("action <> 'skip'").orderBy("rel_path").toLocalIterator():
                print(row["action"], row["rel_path"])
        print(sync_text(r))
        return int(r["failed"] > 0)
    if a.command == "status":
        r = commands.status(spark, a.target)
        print(f"{r['n_files']} files ({human(r['file_bytes'])}), {r['n_objects']} objects, {human(max(r['saved_bytes'], 0))} saved")
        return 0
    if a.command == "verify":
        r = commands.verify(spark, a.target)
        print(f"checked {r['checked']}, missing {r['missing']}, failed {r['failed']}", *[f"{v}: {p}" for p, v in r["errors"]], sep="\n")
        return int(r["missing"] + r["failed"] > 0)
    if a.command == "reindex":
        print(commands.reindex(spark, a.target))
        return 0
    if a.command == "prune":
        print(commands.prune(spark, a.target, a.dry_run))
        return 0
    if a.command == "dedup":
        r = commands.dedup(spark, a.folder, a.exclude, a.index, a.dry_run, a.readonly)
        print(f"scanned {r['scanned']}, {r['n_groups']} groups, {r['duplicate_files']} duplicates, {r['deduped_files']} linked, {human(r['linked_bytes'])} saved")
        return 0
    r = commands.bisync(spark, a.left, a.right, a.state, a.conflict, a.exclude, a.dry_run, a.workers)
    print({k: v for k, v in r.items() if k not in ("actions", "errors", "failures")}, *[f"failed: {p}: {e}" for p, e in r["errors"]], sep="\n")
    return int(bool(r["errors"]))


if __name__ == "__main__":
    sys.exit(main())
