"""A small JSON state that several engines change: numbered versions, each made exclusively, the last one counts."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TypeVar

from millrace.sources.files import files, joined

T = TypeVar("T")
#: Older versions that stay for readers that have just listed them.
KEPT = 8


class Ledger:
    def __init__(self, folder: str, first: dict):
        self.folder, self.first, self.store = folder, first, files(folder)
        self.seen: tuple[int, dict] = (-1, first)

    def _path(self, version: int) -> str:
        return joined(self.folder, f"{version:020d}.json")

    def _versions(self) -> list[int]:
        return [int(n[:20]) for n in self.store.names(self.folder) if n.endswith(".json")]

    def read(self) -> dict:
        """The newest state; a version never changes, so it is read once."""
        known = self._versions()
        if known and known[-1] != self.seen[0]:
            text = self.store.read(self._path(known[-1]))
            if not text:  # another writer has it open, or has cleared it: look again
                return self.read()
            self.seen = (known[-1], json.loads(text))
        return self.seen[1]

    def update(self, change: Callable[[dict], T]) -> T:
        """Apply a change to the newest state; again to a newer one if another writer was first."""
        while True:
            state = json.loads(json.dumps(self.read()))
            version = self.seen[0] + 1
            out = change(state)
            if state == self.seen[1]:
                return out
            if self.store.put_new(self._path(version), json.dumps(state, indent=1, sort_keys=True)):
                self.seen = (version, state)
                for old in self._versions()[:-KEPT]:
                    self.store.remove(self._path(old))
                return out
