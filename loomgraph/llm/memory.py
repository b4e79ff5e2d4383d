"""A bounded memory for what a Python worker has worked out."""

from __future__ import annotations

from collections.abc import Iterator


class Memory(dict):
    """A dictionary of two generations: what is used again outlives what is not, and the size stays bounded."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit // 2, {}

    def fetch(self, keys: set, learn) -> dict:
        """The values of keys, in a small dictionary of their own; learn(list) gives those not remembered, as a dictionary."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        here = dict(zip(keys, map(self.get, keys), strict=True))
        absent = [k for k, v in here.items() if v is None]
        if absent:
            got = dict(zip(absent, map(self.old.get, absent), strict=True))
            got.update(learn([k for k, v in got.items() if v is None]))
            self.update(got)
            here.update(got)
        return here


def groups(texts: list, chars: int = 1_000_000) -> Iterator[list]:
    """Consecutive texts in lists of about so many characters; a longer text stands alone."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
