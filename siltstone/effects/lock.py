"""One process at a time per target."""

from __future__ import annotations

import os


class Locked(RuntimeError):
    pass


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Lock:
    """Held from ``acquire`` to ``release``; the file names the process. A dead holder's lock is taken over."""

    def __init__(self, folder: str):
        self.path, self.held = os.path.join(folder, "lock"), False

    def acquire(self) -> "Lock":
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        for _ in range(2):
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
            except FileExistsError:
                try:
                    with open(self.path) as f:
                        pid = int(f.read().strip())
                except FileNotFoundError:
                    continue
                except ValueError:
                    raise Locked(f"{self.path} is unreadable; remove it if no other process runs") from None
                if _alive(pid):
                    raise Locked(f"held by process {pid}") from None
                os.unlink(self.path)
                continue
            with os.fdopen(fd, "w") as f:
                f.write(str(os.getpid()))
            self.held = True
            return self
        raise Locked(f"{self.path} cannot be taken")

    def release(self) -> None:
        if self.held:
            self.held = False
            try:
                os.unlink(self.path)
            except FileNotFoundError:
                pass

    __enter__ = acquire

    def __exit__(self, *_) -> None:
        self.release()
