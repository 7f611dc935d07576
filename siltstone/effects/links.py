"""Linking duplicate files to one another, on one file system."""

from __future__ import annotations

import os
import stat
import uuid
from typing import NamedTuple


class Seen(NamedTuple):
    """A file as the scan saw it, before its content was read."""

    path: str
    size: int
    mtime_ns: int


def _check(at: str, seen: Seen) -> os.stat_result:
    s = os.lstat(at)
    if not stat.S_ISREG(s.st_mode) or (s.st_size, s.st_mtime_ns) != (seen.size, seen.mtime_ns):
        raise OSError(0, "changed since it was scanned")
    return s


def _link(head: Seen, other: Seen) -> bool:
    """Replaces ``other`` by a link to ``head``; False where it is one already.

    The old file is set aside first and looked at there, the new link is looked at in its place: whoever writes to either
    name in between finds the old file back, never its content gone.
    """
    h, s = os.lstat(head.path), os.lstat(other.path)
    if (s.st_dev, s.st_ino) == (h.st_dev, h.st_ino):
        return False
    _check(head.path, head)
    _check(other.path, other)
    aside = f"{other.path}.{uuid.uuid4().hex}.old"
    os.rename(other.path, aside)
    try:
        _check(aside, other)
        os.link(head.path, other.path, follow_symlinks=False)
        try:
            _check(other.path, head)
        except OSError:
            os.unlink(other.path)
            raise
    except OSError:
        if not os.path.lexists(other.path):
            os.rename(aside, other.path)
        raise
    os.unlink(aside)
    return True


def link_group(head: Seen, others: list[Seen], readonly: bool = False) -> dict:
    """Replaces each other file by a hard link to the head; files already on its inode are left alone.

    Files whose size or mtime is no longer what the scan saw, the head's included, are errors and stay as they are. A
    failure is an entry in the result, never an exception. Returns linked (paths), errors, readonly_failed.
    """
    linked, errors, readonly_failed = [], [], 0
    for other in others:
        try:
            if _link(head, other):
                linked.append(other.path)
        except OSError as e:
            errors.append(f"{other.path}: {e.strerror}")
    if linked:
        try:
            os.utime(head.path, ns=(head.mtime_ns, head.mtime_ns))
        except OSError as e:
            errors.append(f"{head.path}: {e.strerror}")
        for path in [head.path, *linked] if readonly else []:
            try:
                os.chmod(path, 0o444)
            except OSError:
                readonly_failed += 1
    return {"linked": linked, "errors": errors, "readonly_failed": readonly_failed}
