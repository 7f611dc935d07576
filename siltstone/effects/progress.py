"""News of running tasks, and word to stop them, through small files next to the target's state.

Tasks append a line for each file that is done; the driver reads what is new a few times a second. A file named ``stop`` tells
tasks to begin nothing more.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable

#: Seconds between two looks of the driver and two lines' writes of a task; failures are written at once.
PERIOD = 0.2
STOP = "stop"


class Reporter:
    """A task's side. Does nothing without a folder."""

    def __init__(self, folder: str | None, news: bool):
        self.stop = os.path.join(folder, STOP) if folder else None
        self.out = open(os.path.join(folder, f"{uuid.uuid4().hex}.news"), "w") if folder and news else None
        self.last = 0.0

    def stopped(self) -> bool:
        return bool(self.stop) and os.path.exists(self.stop)

    def done(self, path: str, status: str, error: str | None, size: int) -> None:
        if self.out:
            self.out.write(json.dumps({"rel_path": path, "status": status, "error": error, "bytes": size}) + "\n")
            if error or time.monotonic() - self.last > PERIOD:
                self.out.flush()
                self.last = time.monotonic()

    def close(self) -> None:
        if self.out:
            self.out.close()


class Watch:
    """The driver's side: ``on_event`` gets each finished file; tasks stop once ``stop`` is set."""

    def __init__(self, folder: str, stop: threading.Event | None = None, on_event: Callable[[dict], None] | None = None):
        self.folder, self.stop, self.on_event = os.path.join(folder, f"run-{uuid.uuid4().hex}"), stop, on_event
        self.read: dict[str, int] = {}
        self.over = threading.Event()

    def __enter__(self) -> Watch:
        os.makedirs(self.folder)
        self._look()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def _run(self) -> None:
        while not self.over.wait(PERIOD):
            self._look()

    def _look(self) -> None:
        if self.stop is not None and self.stop.is_set():
            open(os.path.join(self.folder, STOP), "w").close()
        for name in sorted(os.listdir(self.folder)) if self.on_event else []:
            if name.endswith(".news"):
                with open(os.path.join(self.folder, name), "rb") as f:
                    f.seek(self.read.get(name, 0))
                    whole = f.read().rpartition(b"\n")[0]
                self.read[name] = self.read.get(name, 0) + len(whole) + bool(whole)
                for line in whole.splitlines():
                    self.on_event(json.loads(line))

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self._look()
        shutil.rmtree(self.folder, ignore_errors=True)
