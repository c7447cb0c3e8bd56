"""Admission: how many statements may run at once. Nobody waits in a queue."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from halyard.config import KEY_CONCURRENCY, PROCESS_CONCURRENCY
from halyard.errors import LIMITED, EngineError


class Gate:
    def __init__(self, per_key: int = KEY_CONCURRENCY, in_all: int = PROCESS_CONCURRENCY):
        self.per_key, self.in_all = per_key, in_all
        self._lock, self._held = threading.Lock(), Counter()

    def _enter(self, key: str) -> None:
        with self._lock:
            if self._held[key] >= self.per_key:
                raise EngineError(LIMITED, "too many statements of this key", {"reason": "key_concurrency_limit", "limit": self.per_key})
            if sum(self._held.values()) >= self.in_all:
                raise EngineError(LIMITED, "too many statements", {"reason": "process_concurrency_limit", "limit": self.in_all})
            self._held[key] += 1

    def _leave(self, key: str) -> None:
        with self._lock:
            self._held[key] -= 1
            if self._held[key] <= 0:
                del self._held[key]

    @contextmanager
    def slot(self, key: str) -> Iterator[None]:
        """A place for one statement, given back at the end, or rate_limited at once."""
        self._enter(key)
        try:
            yield
        finally:
            self._leave(key)
