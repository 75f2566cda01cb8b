"""A binary heap that says how many keys each operation compared.

A rising entry is compared with its parent until it isn't smaller; a sinking one with each child there is. Equal
keys stay as they stand. Removing the last entry compares nothing.
"""

from __future__ import annotations


class CountingHeap:
    def __init__(self) -> None:
        self.entries: list[tuple] = []  # (key, item); keys alone are compared

    def __len__(self) -> int:
        return len(self.entries)

    def push(self, item: int, key: object) -> int:
        a, at, compared = self.entries, len(self.entries), 0
        entry = (key, item)
        a.append(entry)
        while at:
            up = (at - 1) // 2
            compared += 1
            if not key < a[up][0]:
                break
            a[at], at = a[up], up
        a[at] = entry
        return compared

    def pop(self) -> tuple[int, object, int]:
        """(item, key, comparisons)."""
        a = self.entries
        key, item = a[0]
        last = a.pop()
        if not a:
            return item, key, 0
        at, compared, size = 0, 0, len(a)
        while (child := 2 * at + 1) < size:
            best, least = at, last[0]
            for c in (child, child + 1):
                if c < size:
                    compared += 1
                    if a[c][0] < least:
                        best, least = c, a[c][0]
            if best == at:
                break
            a[at], at = a[best], best
        a[at] = last
        return item, key, compared
