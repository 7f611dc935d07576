"""Files of a content-addressed store. Every step can be repeated without harm."""

from __future__ import annotations

import errno
import os
import re
import shutil
import time
import uuid

from siltstone.functions.hashing import PREFIX, file_key

HARDLINK, COPY = "hardlink", "copy"
METADATA = ".siltstone"
#: errno values that mean "in use, try again later" rather than "failed".
LOCKED = frozenset({errno.EBUSY, errno.EACCES, errno.EAGAIN})
_KEY = re.compile(rf"{PREFIX}[0-9A-Fa-f]{{4,}}\Z")


def object_file(objects_root: str, key: str) -> str:
    if not _KEY.match(key or ""):
        raise ValueError(f"not an object key: {key!r}")
    h = key[len(PREFIX) :]
    return os.path.join(objects_root, h[:2], h[:4], h)


def within(root: str, path: str) -> bool:
    root, path = os.path.normpath(root), os.path.normpath(path)
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)


def _replace_with(make, dest: str) -> None:
    """Makes a draft beside ``dest`` and moves it there, so nobody ever sees half a file."""
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    draft = f"{dest}.{uuid.uuid4().hex}.part"
    try:
        make(draft)
        os.replace(draft, dest)
        if os.path.lexists(draft):  # both names were one file already
            os.unlink(draft)
    except BaseException:
        if os.path.lexists(draft):
            os.unlink(draft)
        raise


def ensure_object(objects_root: str, source: str, key: str, mode: str = HARDLINK) -> bool:
    """Stores a file under its key unless it is there; true if it was. Stored files are read-only when they get linked."""
    at = object_file(objects_root, key)
    if os.path.exists(at):
        return True

    def make(draft: str) -> None:
        shutil.copyfile(source, draft)
        if mode == HARDLINK:
            os.chmod(draft, 0o444)

    _replace_with(make, at)
    return False


def place(objects_root: str, key: str, dest: str, mode: str) -> None:
    """Puts the object at ``dest``, by hard link or as a writable copy, whatever was there before."""
    at = object_file(objects_root, key)

    def make(draft: str) -> None:
        if mode == HARDLINK:
            os.link(at, draft)
        else:
            shutil.copyfile(at, draft)
            os.chmod(draft, 0o644)

    _replace_with(make, dest)


def delete_object(objects_root: str, key: str) -> None:
    try:
        os.unlink(object_file(objects_root, key))
    except FileNotFoundError:
        pass


def remove_temporary(objects_root: str, key: str, mode: str) -> None:
    """Where files are copies, an object is only a way station; linked objects stay."""
    if mode == COPY:
        delete_object(objects_root, key)


def detect_mode(target: str) -> str:
    """Whether the target itself can hold hard links."""
    os.makedirs(target, exist_ok=True)
    a = os.path.join(target, f".probe-{uuid.uuid4().hex}")
    b = a + "-link"
    try:
        with open(a, "wb"):
            pass
        os.link(a, b)
        return HARDLINK
    except OSError:
        return COPY
    finally:
        for p in (b, a):
            if os.path.lexists(p):
                os.unlink(p)


def free_space(path: str) -> int:
    return shutil.disk_usage(path).free


def quarantine(root: str, rel_path: str, stamp: str) -> str:
    """Moves a destination that holds other content out of the way; returns where to."""
    from hashlib import sha1

    folder = rel_path.replace("/", "_").replace("\x00", "_")
    raw = folder.encode()
    if len(raw) > 150:
        folder = raw[:141].decode(errors="replace") + "_" + sha1(rel_path.encode()).hexdigest()[:8]
    to = os.path.join(root, METADATA, "conflict", stamp, folder, os.path.basename(rel_path))
    n, free = 0, to
    while os.path.lexists(free):
        n += 1
        free = f"{to}.{n}"
    os.makedirs(os.path.dirname(free), exist_ok=True)
    os.replace(os.path.join(root, rel_path), free)
    return free


def keep_mtime(path: str, mtime_ns: int) -> str | None:
    """Sets the modification time; a failure is a warning."""
    try:
        os.utime(path, ns=(mtime_ns, mtime_ns))
    except OSError as e:
        return f"mtime of {path}: {e.strerror}"
    return None


def make_folder(root: str, rel_path: str) -> str | None:
    """Makes a folder below the root; a failure is a warning."""
    try:
        os.makedirs(os.path.join(root, rel_path), exist_ok=True)
    except OSError as e:
        return f"{rel_path}: {e.strerror}"
    return None


def store_one(task: dict, target: str, mode: str) -> bool | None:
    """Stores a key's content ahead of its copies; whether it was there, None where that is left to the copies."""
    try:
        s = os.stat(task["abs_path"])
        if s.st_size != task["size"] or abs(s.st_mtime_ns - task["mtime_ns"]) > 2_000_000_000:
            return None
        return ensure_object(os.path.join(target, METADATA, "objects"), task["abs_path"], task["object_key"], mode)
    except (OSError, ValueError):
        return None


def copy_one(task: dict, target: str, mode: str, verify: bool, stamp: str) -> dict:
    """Carries out one copy: checks the source again, stores, sets conflicts aside, places, dates, verifies.

    ``stored`` of the task says whether its content was there before ``store_one`` took it in (null: it did not). Returns status (copied, failed, locked), existed, object_key, bytes, error, warning; it never raises for a file's sake.
    """
    rel, key, size, mtime = task["rel_path"], task["object_key"], task["size"], task["mtime_ns"]
    out = {"rel_path": rel, "object_key": key, "old_object_key": task.get("old_object_key"), "status": "copied", "existed": False, "size": size, "mtime_ns": mtime, "error": None, "warning": None}
    objects, dest = os.path.join(target, METADATA, "objects"), os.path.join(target, rel)
    try:
        if not within(target, dest):
            raise ValueError(f"{rel} leaves the target")
        s = os.stat(task["abs_path"])
        if s.st_size != size or abs(s.st_mtime_ns - mtime) > 2_000_000_000:
            key = file_key(task["abs_path"])
            out |= {"object_key": key, "size": s.st_size, "mtime_ns": s.st_mtime_ns}
        existed = ensure_object(objects, task["abs_path"], key, mode)
        out["existed"] = existed if task.get("stored") is None or key != task["object_key"] else bool(task["stored"])
        if os.path.isfile(dest) and not os.path.islink(dest):
            there = file_key(dest)
            if there not in (key, out["old_object_key"]):
                quarantine(target, rel, stamp)
        place(objects, key, dest, mode)
        out["warning"] = keep_mtime(dest, out["mtime_ns"])
        if verify and file_key(dest) != key:
            raise OSError(errno.EIO, "content differs after copying")
    except OSError as e:
        out |= {"status": "locked" if e.errno in LOCKED else "failed", "error": f"{type(e).__name__}: {e.strerror or e}"}
    except ValueError as e:
        out |= {"status": "failed", "error": str(e)}
    return out


def timestamp() -> str:
    return time.strftime("%Y%m%d-%H%M%S")
