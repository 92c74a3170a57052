"""A bounded memory of a function's values, for use inside tasks."""

from __future__ import annotations

import weakref
from collections.abc import Callable

_MEMORIES: weakref.WeakSet = weakref.WeakSet()


def keep_only(*wanted: Memo) -> None:
    """Empties all other memories of this worker. A task calls it first, as workers live on and serve other operators."""
    for memory in list(_MEMORIES):
        if not any(memory is w for w in wanted):
            memory.forget()


class Memo(dict):
    """Key to ``make(key)``, remembered in two generations of ``limit`` short keys each.

    When the young generation is full it becomes the old one, and what was old is
    forgotten unless it was asked for since.
    """

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 40):
        super().__init__()
        self._make, self._limit, self._longest = make, limit, longest
        self._old: dict = {}
        _MEMORIES.add(self)

    __hash__ = object.__hash__

    def forget(self) -> None:
        self.clear()
        self._old = {}

    def __missing__(self, key):
        value = self._old.get(key)
        return self.put(key, self._make(key) if value is None else value)

    def put(self, key, value):
        if len(key) <= self._longest:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value
