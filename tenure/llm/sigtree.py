"""Signature trees over token sets and their dual traversal for an exact Jaccard join.

Leaves hold up to ``LEAF`` sets that stand together in the order of their smallest token; a node holds the OR of
its sets' token bitmaps, the range of their sizes, and how many tokens a set may lose to shared bits. A pair of
nodes is pruned when the sizes alone, or the bits both have plus the tokens that may hide, leave no pair of sets
that reaches the threshold. Pairs of leaves that remain are intersected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tenure.llm.textbatch import mix

LEAF = 16
FAN = 4
MAX_BITS = 1 << 15


class Node:
    __slots__ = ("lo", "hi", "bits", "least", "most", "hidden", "children", "leaf")


class Tree:
    def __init__(self, sets: list[np.ndarray], bits: int):
        self.at = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.sets = [sets[i] for i in self.at]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        level = [self._leaf(lo, min(lo + LEAF, len(sets)), bits, len(sets) > LEAF) for lo in range(0, len(sets), LEAF)]
        while len(level) > 1:
            level = [self._over(level[i:i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0]

    def _leaf(self, lo: int, hi: int, bits: int, mapped: bool) -> Node:
        node = Node()
        sizes = self.sizes[lo:hi]
        node.lo, node.hi, node.children = lo, hi, []
        node.least, node.most = int(sizes.min()), int(sizes.max())
        tokens = np.concatenate(self.sets[lo:hi])
        row = np.repeat(np.arange(hi - lo), sizes)
        words, back = np.unique(tokens, return_inverse=True)
        matrix = np.zeros((hi - lo, len(words)), np.float32)
        matrix[row, back] = 1
        node.leaf = (words, matrix, tokens, row)
        node.bits, node.hidden = None, 0
        if mapped:
            own = np.zeros((hi - lo, bits), bool)
            own[row, (mix(tokens) % np.uint64(bits)).astype(np.int64)] = True
            node.hidden = int((sizes - own.sum(1)).max())
            node.bits = np.packbits(own.any(0)).view(np.uint64)
        return node

    @staticmethod
    def _over(children: list[Node]) -> Node:
        node = Node()
        node.lo, node.hi, node.children, node.leaf = children[0].lo, children[-1].hi, children, None
        node.least, node.most = min(c.least for c in children), max(c.most for c in children)
        node.hidden = max(c.hidden for c in children)
        node.bits = np.bitwise_or.reduce([c.bits for c in children])
        return node


def _prunes(a: Node, b: Node, num: int, den: int) -> bool:
    if a.most * den < b.least * num or b.most * den < a.least * num:
        return True
    if a.bits is None or b.bits is None:
        return False
    overlap = min(int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.hidden, b.hidden), a.most, b.most)
    return overlap * (num + den) < num * (a.least + b.least)


def linked_pairs(left: Tree, right: Tree | None, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into the lists the trees were built from) with den * |a & b| >= num * |a | b|, block by block.

    ``right`` None joins ``left`` with itself, each pair once.
    """
    other = right or left
    stack = [(left.root, other.root)]
    while stack:
        a, b = stack.pop()
        if _prunes(a, b, num, den):
            continue
        if a.leaf is None or b.leaf is None:
            if right is None and a is b:
                kids = a.children
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
            elif a.leaf is None and (b.leaf is not None or a.hi - a.lo >= b.hi - b.lo):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]
            continue
        words, matrix, _, _ = b.leaf
        _, _, tokens, row = a.leaf
        at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
        hit = words[at] == tokens
        mine = np.zeros((a.hi - a.lo, len(words)), np.float32)
        mine[row[hit], at[hit]] = 1
        common = (mine @ matrix.T).astype(np.int64)
        sizes = left.sizes[a.lo:a.hi, None] + other.sizes[None, b.lo:b.hi]
        link = common * den >= num * (sizes - common)
        if right is None and a is b:
            link = np.triu(link, 1)
        i, j = np.nonzero(link)
        if len(i):
            yield np.array(left.at)[i + a.lo], np.array(other.at)[j + b.lo]


def width(sets: list[np.ndarray]) -> int:
    """Bitmap bits for sets of these sizes: about four a token, a power of two."""
    most = max(len(s) for s in sets)
    return min(MAX_BITS, max(256, 1 << (4 * most - 1).bit_length()))
