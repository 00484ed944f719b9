"""Deep-shallow ordering of suffixes: multikey quicksort, then blind tries.

Suffixes are split on one byte after another down to SHALLOW bytes; the groups
that still agree there share a long prefix, and a blind trie orders each: it
holds only the depths at which suffixes part, is descended without comparing,
and one comparison with the leaf reached gives the place of a new suffix.
"""

from __future__ import annotations

SHALLOW = 12


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two texts that agree up to `start`."""
    lo, hi = start, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Orders suffixes that agree on their first `start` bytes."""

    def __init__(self, texts: list[bytes], start: int):
        self.texts, self.start = texts, start
        self.root: list | None = None

    def insert(self, item: int) -> None:
        """A leaf is [-1, items of equal text]; a node [depth, {byte or -1 at the end: child}, an item below]."""
        text = self.texts[item]
        if self.root is None:
            self.root = [-1, [item]]
            return
        node = self.root
        while node[0] >= 0:
            d = node[0]
            child = node[1].get(text[d] if d < len(text) else -1)
            if child is None:
                break
            node = child
        other = self.texts[node[1][0] if node[0] < 0 else node[2]]
        depth = common_prefix(text, other, self.start)
        if depth == len(text) == len(other):
            node[1].append(item)
            return
        parent, node, key = None, self.root, 0
        while 0 <= node[0] < depth:
            parent, key = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][key]
        own = text[depth] if depth < len(text) else -1
        if node[0] == depth:
            node[1][own] = [-1, [item]]
            return
        new = [depth, {own: [-1, [item]], other[depth] if depth < len(other) else -1: node}, item]
        if parent is None:
            self.root = new
        else:
            parent[1][key] = new

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(texts: list[bytes], start: int = 0) -> tuple[list[int], list[int]]:
    """(order of the texts, common prefix of each with the one before, 0 first); all agree on `start` bytes."""
    order: list[int] = []
    stack = [(list(range(len(texts))), start)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2 or depth < 0:
            order += items
            continue
        if depth - start >= SHALLOW:
            trie = BlindTrie(texts, depth)
            for i in items:
                trie.insert(i)
            order += trie.ordered()
            continue
        byte = [texts[i][depth] if depth < len(texts[i]) else -1 for i in items]
        pivot = byte[len(byte) // 2]
        less = [i for i, b in zip(items, byte, strict=True) if b < pivot]
        more = [i for i, b in zip(items, byte, strict=True) if b > pivot]
        same = [i for i, b in zip(items, byte, strict=True) if b == pivot]
        stack += [(more, depth), (same, -1 if pivot < 0 else depth + 1), (less, depth)]
    return order, [0, *(common_prefix(texts[a], texts[b], start) for a, b in zip(order, order[1:], strict=False))][: len(order)]
