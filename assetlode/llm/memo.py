"""A memo of bounded size for what is asked again and again."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """What ``make`` gives for each key, in two generations: when the young one is full, keys of the old one that nobody asked for go."""

    def __init__(self, make: Callable[[str], bytes], old: dict | None = None):
        super().__init__()
        self.make, self.old = make, old or {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value

    def trimmed(self, most: int) -> Memo:
        if len(self) <= most:
            return self
        self.old = {}
        return Memo(self.make, self)
