"""Refreshes on reading: one at a time for each warehouse, and not more often than every FLOOR seconds."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

FLOOR = 15.0


class Refresher:
    """Shares refreshes among readers. work(root) refreshes; ready(root) says whether there is anything to show meanwhile."""

    def __init__(self, work: Callable[[str], None], ready: Callable[[str], bool], floor: float = FLOOR, clock: Callable[[], float] = time.monotonic, failed: Callable[[str, Exception], None] | None = None):
        self.work, self.ready, self.floor, self.clock, self.failed = work, ready, floor, clock, failed
        self.lock = threading.Lock()
        self.running: dict[str, threading.Thread] = {}
        self.ended: dict[str, float] = {}
        self.errors: dict[str, Exception] = {}

    def request(self, root: str) -> bool:
        """Asks for a refresh. True if this call has started one. Where there is nothing to show yet it is waited for."""
        if not root:
            return False
        first = not self.ready(root)
        with self.lock:
            thread = self.running.get(root)
            started = thread is None and (first or root not in self.ended or self.clock() - self.ended[root] >= self.floor)
            if started:
                thread = self.running[root] = threading.Thread(target=self._run, args=(root,), daemon=True)
                thread.start()
        if first and thread:
            thread.join()
        return started

    def _run(self, root: str) -> None:
        try:
            self.work(root)
            self.errors.pop(root, None)
        except Exception as e:  # told to the owner, not to a reader who has been served already
            self.errors[root] = e
            if self.failed:
                self.failed(root, e)
        finally:
            with self.lock:
                self.running.pop(root, None)
                self.ended[root] = self.clock()
