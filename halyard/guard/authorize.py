"""Whether a user may read the tables of a statement."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable

from halyard.config import Route
from halyard.errors import denied
from halyard.guard.plan import TableRef

#: Seconds between looks at the revision of the grants.
RELOAD_S = 5.0


def candidates(ref: TableRef, route: Route, schemas: frozenset[str] = frozenset({"public"})) -> list[str]:
    """The full names a reference can mean: unqualified names and those of the given
    schemas are tables of the route; nothing else can be reached."""
    if len(ref.parts) == 1 or len(ref.parts) == 2 and ref.parts[0].lower() in schemas:
        return [f"{route.service}.{route.dbname}.{ref.parts[-1].lower()}"]
    return []


def authorize(refs: Iterable[TableRef], route: Route, allowed: Callable[[str], bool] | None) -> None:
    """EngineError for the first table that is unknown or not granted. One granted
    candidate suffices; without a way to ask, everything is refused."""
    for ref in refs:
        names = candidates(ref, route)
        if not names:
            raise denied("unknown_table", f"no table {ref.name}", table=ref.name)
        if allowed is None or not any(map(allowed, names)):
            raise denied("not_granted", f"no grant for {ref.name}", table=ref.name, candidate_fqns=names)


class AccessList:
    """The grants in memory, loaded again when their revision has changed.

    load() -> (revision, pairs of user and table). If loading fails everything is
    refused until it works again, and the revision is -1."""

    def __init__(self, load: Callable[[], tuple[int, Iterable[tuple[str, str]]]], revision: Callable[[], int], every: float = RELOAD_S):
        self._load, self._current, self._every = load, revision, every
        self._lock = threading.Lock()
        self._pairs: frozenset[tuple[str, str]] = frozenset()
        self.revision, self._looked = -1, float("-inf")

    def refresh(self) -> None:
        """Look at the revision if that is due; whoever comes meanwhile waits."""
        with self._lock:
            if time.monotonic() - self._looked < self._every:
                return
            try:
                if self._current() != self.revision:
                    self.revision, pairs = self._load()
                    self._pairs = frozenset((u, t.lower()) for u, t in pairs)
            except Exception:
                self.revision, self._pairs = -1, frozenset()
            self._looked = time.monotonic()

    def allows(self, user: str, fqn: str) -> bool:
        if time.monotonic() - self._looked >= self._every:
            self.refresh()
        return (user, fqn.lower()) in self._pairs
