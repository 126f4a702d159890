"""A prefix tree of globally ordered sets, and joins by walking it."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


class _Node:
    __slots__ = ("children", "first", "last", "least", "longest", "mixed", "most", "rep", "run", "sets")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.sets = run, {}, []
        self.least, self.most, self.longest, self.first, self.last = 1 << 60, 0, 0, 1 << 60, -1
        self.rep, self.mixed = -1, False


class Trie:
    """Sets as rising arrays of ranks. Equal beginnings share nodes; a node carries bounds over the sets below it:
    their sizes, the longest list, and the first insertion.

    A probe carries the overlap gathered on the way down. It leaves a subtree when the overlap so far, plus what
    the probe and the subtree's longest list have left, can't reach the least overlap that the sizes ask for,
    when sizes are out of range, or when every set below is already known to be in the probe's component.
    """

    def __init__(self, ranks: int, percent: int):
        self.root, self.percent = _Node(np.zeros(0, np.int64)), percent
        self.mark = np.zeros(ranks + 1, bool)
        self.lists: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.up: list[int] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def add(self, ranks: np.ndarray, size: int) -> int:
        """Number a set without storing it in the tree."""
        self.lists.append(ranks)
        self.sizes.append(size)
        self.up.append(len(self.up))
        return len(self.up) - 1

    def _cover(self, node: _Node, i: int) -> None:
        size, length = self.sizes[i], len(self.lists[i])
        node.least, node.most, node.longest, node.first = min(node.least, size), max(node.most, size), max(node.longest, length), min(node.first, i)
        if node.rep < 0:
            node.rep = i
        elif not node.mixed and self.find(node.rep) != self.find(i):
            node.mixed = True

    def insert(self, i: int) -> None:
        node, rest = self.root, self.lists[i]
        self._cover(node, i)
        while True:
            if not len(rest):
                node.sets.append(i)
                return
            child = node.children.get(int(rest[0]))
            if child is None:
                child = node.children[int(rest[0])] = _Node(rest)
                self._cover(child, i)
                child.sets.append(i)
                return
            k = min(len(rest), len(child.run))
            differ = np.flatnonzero(rest[:k] != child.run[:k])
            k = int(differ[0]) if len(differ) else k
            if k < len(child.run):
                above = _Node(child.run[:k])
                for name in ("least", "most", "longest", "first", "rep", "mixed"):
                    setattr(above, name, getattr(child, name))
                child.run = child.run[k:]
                above.children[int(child.run[0])] = child
                node.children[int(rest[0])] = child = above
            self._cover(child, i)
            node, rest = child, rest[k:]

    def probe(self, i: int, before: int | None = None, skip: bool = True):
        """Sets linked with set i, as they are found; between two of them the caller may join components.

        before: only sets numbered below it. skip: leave subtrees that lie in i's component.
        """
        own, size, percent = self.lists[i], self.sizes[i], self.percent
        self.mark[own] = True
        stack = [(self.root, 0, 0)]
        try:
            while stack:
                node, overlap, depth = stack.pop()
                if before is not None and node.first >= before:
                    continue
                if 100 * node.most < percent * size or 100 * size < percent * node.least:
                    continue
                if skip and not node.mixed and node.rep >= 0 and self.find(node.rep) == self.find(i):
                    continue
                if len(node.run):
                    overlap += int(np.count_nonzero(self.mark[node.run]))
                    depth += len(node.run)
                    left = len(own) - int(np.searchsorted(own, node.run[-1], side="right"))
                else:
                    left = len(own)
                if (100 + percent) * (overlap + min(left, node.longest - depth)) < percent * (size + node.least):
                    continue
                for j in node.sets:
                    if j != i and (before is None or j < before) and (100 + percent) * overlap >= percent * (size + self.sizes[j]):
                        yield j
                if node.children:
                    if skip and node.mixed and not node.sets and len({self.find(c.rep) if not c.mixed else -1 - k for k, c in enumerate(node.children.values())}) == 1:
                        node.mixed = next(iter(node.children.values())).mixed
                    stack.extend((c, overlap, depth) for c in node.children.values())
        finally:
            self.mark[own] = False


#: A token of a set with its place in the global order.
KEY = np.dtype([("order", "<u4"), ("token", "<u8")])


def ranked(keys: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Arrays of KEY, each in global order -> arrays of ranks that rise in the same order."""
    every = np.concatenate(keys) if keys else np.zeros(0, KEY)
    tokens, first, inverse = np.unique(np.ascontiguousarray(every["token"]), return_index=True, return_inverse=True)
    place = np.empty(len(tokens), np.int64)
    place[np.lexsort((tokens, every["order"][first]))] = np.arange(len(tokens))
    return np.split(place[inverse], np.cumsum([len(k) for k in keys])[:-1]), len(tokens)


def components(sets: list[np.ndarray], sizes: list[int], percent: int) -> list[int]:
    """For each set the lowest index in its component under the links among all of them."""
    lists, ranks = ranked(sets)
    trie = Trie(ranks, percent)
    for own, size in zip(lists, sizes, strict=True):
        i = trie.add(own, size)
        for j in trie.probe(i):
            trie.union(i, j)
        trie.insert(i)
    return [trie.find(i) for i in range(len(lists))]


def earlier(sets: list[np.ndarray], sizes: list[int], percent: int) -> list[bool]:
    """Whether a set is linked with one before it in the list."""
    lists, ranks = ranked(sets)
    trie, out = Trie(ranks, percent), []
    for own, size in zip(lists, sizes, strict=True):
        i = trie.add(own, size)
        out.append(next(trie.probe(i, skip=False), None) is not None)
        trie.insert(i)
    return out


def across(left: tuple[list, list, list], right: tuple[list, list, list], percent: int) -> list[tuple[int, int]]:
    """Links (label, label) that tie the labelled sets of the left to those of the right, enough of them for the components."""
    lists, ranks = ranked([*left[0], *right[0]])
    trie, labels = Trie(ranks, percent), [*left[2], *right[2]]
    heads: dict[int, int] = {}
    for own, size, label in zip(lists, [*left[1], *right[1]], labels, strict=True):
        i = trie.add(own, size)
        trie.union(i, heads.setdefault(label, i))
    for i in range(len(left[0])):
        trie.insert(i)
    out = []
    for i in range(len(left[0]), len(lists)):
        for j in trie.probe(i):
            if trie.find(i) != trie.find(j):
                trie.union(i, j)
                out.append((labels[i], labels[j]))
    return out


def ahead(left: tuple[list, list, list], right: tuple[list, list, list], percent: int) -> list[bool]:
    """Whether a set of the right is linked with one of the left whose place is before its own; places of the left rise."""
    lists, ranks = ranked([*left[0], *right[0]])
    trie, n = Trie(ranks, percent), len(left[0])
    for own, size in zip(lists[:n], left[1], strict=True):
        trie.insert(trie.add(own, size))
    out = []
    for own, size, place in zip(lists[n:], right[1], right[2], strict=True):
        i = trie.add(own, size)
        out.append(next(trie.probe(i, before=bisect_left(left[2], place), skip=False), None) is not None)
    return out
