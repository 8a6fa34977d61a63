"""Cutting texts where a byte-level BPE never joins, and remembering what each chunk became.

Both public split patterns of the byte-level vocabularies start a new piece at
a single space between two visible characters: the space belongs to what
follows, and no piece crosses it. So a text may be cut there and each chunk
encoded alone; frequent chunks are encoded once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: characters that every engine's pattern treats as visible (no white space among them)
_VISIBLE = "!-~¡-ɏ"
_UNSURE = re.compile(f"(?<![{_VISIBLE}]) | (?![{_VISIBLE}])")
_CUT = re.compile(f"(?<=[{_VISIBLE}]) (?=[{_VISIBLE}])")

#: a chunk with its space that can stand between others of its kind
begins_and_ends_visibly = re.compile(f" [{_VISIBLE}](?s:.*[{_VISIBLE}])?").fullmatch

#: entries that a worker learns before the older half is forgotten (two halves: about 125 MB)
REMEMBERED = 300_000


def chunks(text: str) -> list[str]:
    """The text cut at safe spaces; every chunk but the first lost the one space before it."""
    return _CUT.split(text) if _UNSURE.search(text) else text.split(" ")


class Memory:
    """key -> value of what was worked out lately.

    Two generations: what is used again moves to the young one, and when that
    is full the old one is forgotten, so frequent keys stay.
    """

    def __init__(self, work_out: Callable[[list], dict], limit: int):
        self.work_out, self.limit, self.young, self.old = work_out, limit, {}, {}

    def values_of(self, keys: set) -> dict:
        """A dictionary that holds all the keys; misses are worked out in one call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        want = keys - self.young.keys()
        known = want & self.old.keys()
        self.young.update((k, self.old[k]) for k in known)
        want -= known
        if want:
            self.young.update(self.work_out(list(want)))
        return self.young


class ChunkMemory:
    """chunk -> value, with the space before it or without."""

    def __init__(self, work_out: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.first = Memory(lambda some: dict(zip(some, work_out(some))), limit)
        self.later = Memory(lambda some: dict(zip(some, work_out([" " + c for c in some]))), limit)

    def values(self, texts: list[str]) -> list[list]:
        """Per text, the values of its chunks in order."""
        cut = [chunks(t) for t in texts]
        first = self.first.values_of({c[0] for c in cut})
        later = self.later.values_of(set().union(*[c[1:] for c in cut])).__getitem__
        return [[first[c[0]], *map(later, c[1:])] for c in cut]


def blocks(items: list, size: Callable, most: int):
    """Consecutive items whose sizes add up to about ``most``; a larger item is a block of its own."""
    block, held = [], 0
    for x in items:
        block.append(x)
        held += size(x)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block
