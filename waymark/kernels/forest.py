"""The forest-based lane, written from the published algorithm: labels (length, arcs, vertex, predecessor) leave no ties.

Pivots come from local searches that grow trees of k vertices, merge where they meet, and are cut into groups of k to
3k; the recursion pulls sources from a partial order, and what a part leaves unfinished is merged into its parent's
order. Distances are exact; the billed comparisons are this program's own.
"""

from __future__ import annotations

import bisect
import math

from waymark.functions.parameters import Bounded, forest_block, forest_cap
from waymark.kernels.heap import CountingHeap
from waymark.kernels.record import INFINITY, Arcs, Recorder

Label = tuple[float, float, float, float]
ENDLESS: Label = (INFINITY, INFINITY, INFINITY, INFINITY)


class LabelOrder:
    """Keys by label: insert keeps the smaller, merge takes another's keys, pull gives the m smallest and what is next."""

    def __init__(self, m: float, bound: Label, out: Recorder):
        self.m, self.bound, self.out = m, bound, out
        self.sorted: list[tuple[Label, int]] = []
        self.label: dict[int, Label] = {}

    def __len__(self) -> int:
        return len(self.label)

    def put(self, key: int, label: Label) -> int:
        old = self.label.get(key)
        if old is not None and old <= label:
            return 1
        if old is not None:
            self.sorted.pop(bisect.bisect_left(self.sorted, (old, key)))
        self.label[key] = label
        bisect.insort(self.sorted, (label, key))
        return max(1, math.ceil(math.log2(len(self.sorted) + 1)))

    def insert(self, key: int, label: Label) -> None:
        self.out.dstruct(0, 1, self.put(key, label))

    def merge(self, other: LabelOrder) -> None:
        if len(other):
            if other.m >= self.m:
                raise ValueError("only an order of smaller blocks can be merged")
            self.out.dstruct(3, len(other), sum(self.put(k, v) for v, k in other.sorted))

    def pull(self) -> tuple[Label, list[int]]:
        n = len(self.sorted) if len(self.sorted) <= self.m else int(self.m)
        taken, self.sorted = self.sorted[:n], self.sorted[n:]
        for _, key in taken:
            del self.label[key]
        self.out.dstruct(2, n, n)
        return (self.sorted[0][0] if self.sorted else self.bound), sorted(k for _, k in taken)


def cut_tree(vertices: list[int], sides: list[tuple[int, int, int]], size: int) -> list[tuple[list[int], list[int]]]:
    """Groups (vertices, edges) of a tree given by sides (edge, a, b): walking from the least vertex, children in order,
    a vertex reports what it has gathered once that is `size` vertices; the rest joins the last group."""
    if not vertices:
        return []
    near: dict[int, list[tuple[int, int]]] = {v: [] for v in vertices}
    for e, a, b in sides:
        near[a].append((b, e))
        near[b].append((a, e))
    root, groups = min(vertices), []
    got: dict[int, tuple[list[int], list[int]]] = {root: ([root], [])}
    walk = [(root, -1, iter(sorted(near[root])))]
    while walk:
        v, edge, children = walk[-1]
        step = next(((u, e) for u, e in children if e != edge), None)
        if step is not None:
            u, e = step
            got[u] = ([u], [])
            walk.append((u, e, iter(sorted(near[u]))))
            continue
        walk.pop()
        if walk:
            up = walk[-1][0]
            got[up][0].extend(got[v][0])
            got[up][1].extend([*got[v][1], edge])
            if len(got[up][0]) >= size:
                groups.append(got[up])
                got[up] = ([up], [])
    rest = got[root]
    if not groups:
        return [rest]
    groups[-1] = (sorted({*groups[-1][0], *rest[0]}), groups[-1][1] + rest[1])
    return groups


class Lane:
    def __init__(self, arcs: Arcs, source: int, params: Bounded, out: Recorder):
        self.arcs, self.k, self.t, self.levels, self.out = arcs, params.k, params.t, params.levels, out
        self.label: list[Label] = [(INFINITY, 0, v, -1) for v in range(arcs.n)]
        self.label[source] = (0.0, 0, source, -1)
        self.done: set[int] = set()
        self.searches = 0

    def settle(self, v: int) -> None:
        if v not in self.done:
            self.done.add(v)
            self.out.settle(v)

    def candidate(self, e: int) -> Label:
        u = self.arcs.src[e]
        length, hops, _, _ = self.label[u]
        return (length + self.arcs.w[e], hops + 1, self.arcs.dst[e], u)

    def relax(self, e: int, bound: Label) -> bool:
        """A candidate that isn't worse, below the bound, is taken; only a smaller one counts as improved."""
        new, v = self.candidate(e), self.arcs.dst[e]
        taken = new <= self.label[v] and new < bound
        self.out.relax(e, taken and new < self.label[v])
        if taken:
            self.label[v] = new
        return taken

    def grow(self, x: int, bound: Label, home: dict[int, int]) -> tuple[dict[int, int], int]:
        """A local search from x: {vertex: incoming edge} (-1 at x), and the tree it ran into (-1 for none)."""
        tree, search, heap = {x: -1}, self.searches, CountingHeap()
        self.searches += 1
        self.out.heap(0, heap.push(x, self.label[x]))
        while heap and len(tree) < self.k:
            u, key, compared = heap.pop()
            self.out.heap(1, compared)
            if key != self.label[u]:
                continue
            for e in self.arcs.of(u):
                if not self.relax(e, bound):
                    continue
                v = self.arcs.dst[e]
                self.out.forest(0, e, search)
                if v in home:
                    tree.setdefault(v, e)
                    return tree, home[v]
                if v != x:
                    tree[v] = e
                self.out.heap(0, heap.push(v, self.label[v]))
                if len(tree) >= self.k:
                    break
        return tree, -1

    def pivots(self, bound: Label, sources: list[int]) -> tuple[list[list[int]], list[int], list[int]]:
        """(groups of sources, lone sources Q, the vertices W of their small trees)."""
        home: dict[int, int] = {}
        trees: list[tuple[list[int], dict[int, tuple[int, int]]]] = []
        lone, small = [], set()
        for x in sorted(set(sources)):
            if x in home or self.label[x][0] == INFINITY:
                continue
            tree, met = self.grow(x, bound, home)
            if met < 0 and len(tree) < self.k:
                lone.append(x)
                small |= set(tree)
                continue
            if met < 0:
                met = len(trees)
                trees.append(([], {}))
            for v, e in tree.items():
                if v not in home:
                    home[v] = met
                    trees[met][0].append(v)
                if e >= 0:
                    trees[met][1].setdefault(e, (self.arcs.src[e], self.arcs.dst[e]))
        groups, taken, number = [], set(lone), 0
        for vertices, edges in trees:
            for members, cut in cut_tree(vertices, spanning(vertices, edges), self.k):
                for e in cut:
                    self.out.forest(1, e, number)
                number += 1
                own = sorted(v for v in set(members) & set(sources) if v not in taken)
                taken |= set(own)
                if own:
                    groups.append(own)
        return groups, sorted(lone), sorted(small)

    def base(self, bound: Label, sources: list[int]) -> tuple[Label, list[int], LabelOrder]:
        order, got, upto = LabelOrder(1, bound, self.out), [], bound
        for v in sources:
            order.insert(v, self.label[v])
        while len(order) and len(got) <= self.t**3:
            upto, (u,) = order.pull()
            got.append(u)
            self.settle(u)
            for e in self.arcs.of(u):
                if self.relax(e, bound):
                    order.insert(self.arcs.dst[e], self.label[self.arcs.dst[e]])
        return (upto if len(order) else bound), got, order

    def solve(self, level: int, bound: Label, sources: list[int]) -> tuple[Label, list[int], LabelOrder]:
        self.out.recurse(False, level, bound[0])
        found = self.base(bound, sources) if level == 0 else self.split(level, bound, sources)
        self.out.recurse(True, level, found[0][0])
        return found

    def split(self, level: int, bound: Label, sources: list[int]) -> tuple[Label, list[int], LabelOrder]:
        label, order = self.label, LabelOrder(max(level + 1.0, forest_block(level, self.t)), bound, self.out)
        groups, _, small = self.pivots(bound, sources)
        group_of = {v: j for j, g in enumerate(groups) for v in g}
        members = [set(g) for g in groups]
        pivot = [min(g, key=label.__getitem__) for g in groups]
        for p in pivot:
            self.out.pivot(p, level)
            order.insert(p, label[p])
        upto, got = min([bound, *(label[p] for p in pivot)]), []
        finished: set[int] = set()
        while len(order) and len(got) <= forest_cap(level, self.t):
            ahead, pulled = order.pull()
            start = set(pulled)
            for x in pulled:
                j = group_of.get(x, -1)
                if j >= 0 and pivot[j] == x:
                    start |= {v for v in members[j] if label[v] < ahead}
            upto, near, left = self.solve(level - 1, ahead, sorted(start))
            order.merge(left)
            again = set()
            for u in near:
                j = group_of.get(u, -1)
                if j >= 0 and u in members[j]:
                    members[j].discard(u)
                    if u == pivot[j] and members[j]:
                        again.add(j)
            for u in near:
                for e in self.arcs.of(u):
                    if self.relax(e, bound) and label[v := self.arcs.dst[e]] >= ahead:
                        order.insert(v, label[v])
                        j = group_of.get(v, -1)
                        if j >= 0 and v in members[j] and j not in again and label[v] < label[pivot[j]]:
                            pivot[j] = v
            for j in sorted(j for j in again if members[j]):
                pivot[j] = min(members[j], key=label.__getitem__)
                order.insert(pivot[j], label[pivot[j]])
            got += [u for u in near if u not in finished]
            finished |= set(near)
        if not len(order):
            upto = bound
        for x in sources:
            if upto <= label[x] < bound:
                order.insert(x, label[x])
        late = [x for x in small if x not in finished and label[x] < upto]
        for u in late:
            self.settle(u)
            for e in self.arcs.of(u):
                if self.relax(e, bound) and label[v := self.arcs.dst[e]] >= upto:
                    order.insert(v, label[v])
        return upto, got + late, order


def spanning(vertices: list[int], edges: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The edges (in the order met) that join separate parts of the tree: later ones that would close a ring are left out."""
    parent = {v: v for v in vertices}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for e, (a, b) in edges.items():
        if a in parent and b in parent and (p := find(a)) != (q := find(b)):
            parent[p] = q
            out.append((e, a, b))
    return out


def labelled(arcs: Arcs, source: int, params: Bounded, out: Recorder) -> list[Label]:
    lane = Lane(arcs, source, params, out)
    lane.solve(params.levels, ENDLESS, [source])
    return lane.label


def run(arcs: Arcs, source: int, params: Bounded, out: Recorder) -> tuple[list[float], list[int]]:
    label = labelled(arcs, source, params, out)
    return [x[0] for x in label], [int(x[3]) for x in label]
