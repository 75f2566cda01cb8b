"""A list of blocks for partial sorting: keys by value, cheap inserts, cheap prepends of what is smaller than all else,
and pulls of the least M. Written from the published structure's properties; comparisons are counted as they are made.

Blocks lie in order of their values and are unsorted inside. An insert finds its block by the blocks' upper bounds; a
block that grows over M is split about its middle value. Blocks under a third of M are joined to a neighbour, and a
block that this makes too large is cut into even pieces, so that sizes stay between a third of M and M but for the last.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable

Pair = tuple[float, int]


class Counter:
    def __init__(self) -> None:
        self.compared = 0


def split_at(pairs: list[Pair], k: int, count: Counter) -> tuple[list[Pair], list[Pair]]:
    """The k least pairs, and the others: by parting about a value again and again, on the side where the kth lies."""
    less: list[Pair] = []
    rest, more = pairs, []
    while rest and len(less) < k:
        pivot = sorted((rest[0], rest[len(rest) // 2], rest[-1]))[1]
        count.compared += len(rest)
        low, high = [p for p in rest if p < pivot], [p for p in rest if p > pivot]
        if len(less) + len(low) >= k:
            more, rest = [pivot, *high, *more], low
            if len(less) + len(low) == k:
                return less + low, more
        else:
            less, rest = [*less, *low, pivot], high
    return less, rest + more


class BlockList:
    def __init__(self, m: float, bound: Pair):
        if m < 1:
            raise ValueError("a pull takes at least one")
        self.m, self.bound, self.count = m, bound, Counter()
        self.blocks: list[dict[int, float]] = []
        self.tops: list[Pair] = []  # the greatest pair that a block may hold
        self.value: dict[int, float] = {}

    def __len__(self) -> int:
        return len(self.value)

    def place(self, pair: Pair) -> int:
        """The block for a pair, by halving."""
        self.count.compared += max(1, math.ceil(math.log2(len(self.tops) + 1)))
        return min(bisect.bisect_left(self.tops, pair), max(0, len(self.tops) - 1))

    def drop(self, key: int) -> None:
        i = self.place((self.value[key], key))
        del self.blocks[i][key], self.value[key]
        if not self.blocks[i]:
            del self.blocks[i], self.tops[i]

    def insert(self, key: int, value: float) -> None:
        """Keep the smaller value of a key; one that isn't below the structure's bound has no place."""
        if not (math.isfinite(value) and (value, key) < self.bound):
            raise ValueError("a value must be finite and below the bound")
        if key in self.value:
            self.count.compared += 1
            if self.value[key] <= value:
                return
            self.drop(key)
        if not self.blocks:
            self.blocks, self.tops = [{}], [self.bound]
        i = self.place((value, key))
        self.tops[i] = max(self.tops[i], (value, key))
        self.blocks[i][key] = self.value[key] = value
        if len(self.blocks[i]) > self.m:
            self.split(i)

    def split(self, i: int) -> None:
        """Cut a block into even pieces of two thirds of M at most."""
        pairs = [(v, k) for k, v in self.blocks[i].items()]
        pieces = max(2, math.ceil(len(pairs) / max(1, math.floor(2 * self.m / 3))))
        made, tops = [], []
        for left in range(pieces, 0, -1):
            head, pairs = split_at(pairs, math.ceil(len(pairs) / left), self.count) if left > 1 else (pairs, [])
            if head:
                made.append({k: v for v, k in head})
                tops.append(max(head))
        tops[-1] = self.tops[i]
        self.blocks[i : i + 1], self.tops[i : i + 1] = made, tops

    def join(self, i: int) -> None:
        """A block under a third of M goes into the one behind it; the last into the one before."""
        if len(self.blocks) < 2 or len(self.blocks[i]) >= self.m / 3:
            return
        i = min(i, len(self.blocks) - 2)
        both = self.blocks[i] | self.blocks[i + 1]
        self.blocks[i : i + 2], self.tops[i : i + 2] = [both], [self.tops[i + 1]]
        if len(both) > self.m:
            self.split(i)

    def prepend(self, pairs: Iterable[Pair]) -> None:
        """Pairs below all that is held; of a key that comes twice the smaller stays, and one already held is replaced."""
        new: dict[int, float] = {}
        for value, key in pairs:
            new[key] = min(value, new.get(key, math.inf))
        for key in [k for k in new if k in self.value]:
            self.drop(key)
        if not new:
            return
        self.count.compared += len(new)
        self.blocks.insert(0, dict(new))
        self.tops.insert(0, max((v, k) for k, v in new.items()))
        self.value |= new
        if len(new) > self.m:
            self.split(0)

    def pull(self) -> tuple[Pair, list[int]]:
        """The M least keys, ascending, and the least pair left (the bound if none is)."""
        if len(self.value) <= self.m:
            keys = sorted(self.value)
            self.blocks, self.tops, self.value = [], [], {}
            return self.bound, keys
        size, held = int(self.m), 0
        reach = next(i for i, b in enumerate(self.blocks) if (held := held + len(b)) >= size)
        front = [(v, k) for b in self.blocks[: reach + 1] for k, v in b.items()]
        taken, left = split_at(front, size, self.count)
        top = self.tops[reach]
        self.blocks[: reach + 1], self.tops[: reach + 1] = ([{k: v for v, k in left}], [top]) if left else ([], [])
        if left:
            self.join(0)
        for _, key in taken:
            del self.value[key]
        least = min((v, k) for k, v in self.blocks[0].items())
        self.count.compared += len(self.blocks[0])
        return least, sorted(k for _, k in taken)
