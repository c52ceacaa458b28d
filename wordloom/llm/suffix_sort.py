"""Deep-shallow sorting of byte strings of one width (suffixes cut at the depth that matters).

Shallow: multikey sorting by big-endian words, each word only inside the groups that the words
before have left tied.  Deep: groups still tied at the shallow depth hold long common prefixes; their
distinct strings are put into a blind trie, which looks at one branching byte a node and at whole
strings only once an insertion, and its order is read off.
"""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 4


class BlindTrie:
    """Compact trie of equally long strings whose inner nodes know only where their leaves differ."""

    def __init__(self):
        self.root: list | bytes | None = None  # a leaf is its string, an inner node [depth, {byte: child}]

    def insert(self, s: bytes) -> None:
        if self.root is None:
            self.root = s
            return
        node = self.root
        while not isinstance(node, bytes):  # blind: skipped bytes are not looked at
            child = node[1].get(s[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        if node == s:
            return
        lo, hi = 0, len(s)  # first byte that differs from the leaf
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if node[lo:mid] == s[lo:mid]:
                lo = mid
            else:
                hi = mid
        other = node[lo]
        parent, edge, node = None, None, self.root
        while not isinstance(node, bytes) and node[0] < lo:
            parent, edge, node = node, s[node[0]], node[1][s[node[0]]]
        if not isinstance(node, bytes) and node[0] == lo:
            node[1][s[lo]] = s
            return
        branch = [lo, {other: node, s[lo]: s}]
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def ordered(self) -> list[bytes]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                out.append(node)
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def words(strings: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words of the rows."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = strings
    return padded.view(">u8").astype(np.uint64)


def sort_strings(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows of a uint8 matrix in order, and each one's common prefix with the row before (0 for the first)."""
    n, width = strings.shape
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    w = words(strings)
    order = np.argsort(w[:, 0], kind="stable")
    fresh = np.ones(n, dtype=bool)  # a new group begins
    fresh[1:] = w[order[1:], 0] != w[order[:-1], 0]
    for k in range(1, min(SHALLOW_WORDS, w.shape[1])):
        tied = ~fresh | np.append(~fresh[1:], False)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh)[at]
        inner = np.lexsort((w[order[at], k], group))
        order[at] = order[at][inner]
        differs = np.ones(n, dtype=bool)
        differs[1:] = w[order[1:], k] != w[order[:-1], k]
        fresh |= differs & tied
    equal = np.zeros(n, dtype=bool)  # to the row before, in full
    equal[1:] = (w[order[1:]] == w[order[:-1]]).all(axis=1) & ~fresh[1:]
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    # groups whose rows are not all equal go deep
    unequal = np.add.reduceat((~equal).astype(np.int64), starts) > 1
    for a, b in zip(starts[unequal].tolist(), ends[unequal].tolist(), strict=True):
        rows = order[a:b]
        trie, at = BlindTrie(), {}
        for r, s in zip(rows.tolist(), map(bytes, strings[rows]), strict=True):
            if s in at:
                at[s].append(r)
            else:
                at[s] = [r]
                trie.insert(s)
        order[a:b] = [r for s in trie.ordered() for r in at[s]]
    lcp = np.zeros(n, dtype=np.int64)
    same = strings[order[1:]] == strings[order[:-1]]
    lcp[1:] = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
    return order, lcp


def classes_at(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """Per row the number of its class: rows of one class agree in their first ``depth`` bytes."""
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(lcp < depth) if depth > 0 else 0
    return number
