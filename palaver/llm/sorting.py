"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries.

The quicksort is ternary on characters of eight bytes and runs breadth-first: in each round every
open segment of the order is split in three by its own pivot, all segments in a few array operations.
A segment leaves when it has one string or all its strings agree to the shallow depth; what is left
are long-common-prefix groups, and a blind (Patricia) trie orders each of those. A blind trie
compares a new string at branching bytes only, then once against the leaf that it reached.
"""

from __future__ import annotations

import numpy as np

#: Bytes to which the quicksort goes.
SHALLOW = 24


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Nodes are [depth, {byte: child}]; a leaf is the list of the equal strings' numbers. -1 ends a string."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i], None
            return
        at, path = self.root, []
        while at[1] is not None:  # blind descent: only branching bytes are looked at
            path.append(at)
            depth, children = at
            at = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[at[0][0]]
        n = common(s, other)
        if n == len(s) == len(other):
            at[0].append(i)
            return
        # the highest node on the path that is deeper than the common prefix hangs below the new branch
        above = [x for x in path if x[0] <= n]
        if above and above[-1][0] == n:
            above[-1][1][s[n] if n < len(s) else -1] = ([i], None)
            return
        below = path[len(above)] if len(above) < len(path) else at
        branch = (n, {other[n] if n < len(other) else -1: below, s[n] if n < len(s) else -1: ([i], None)})
        if above:
            depth, children = above[-1]
            children[s[depth] if depth < len(s) else -1] = branch
        else:
            self.root = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """The numbers in order, and the common prefix of each with the one before it (0 for the first)."""
        order, lcp, stack, between = [], [], [(self.root, 0)], 0
        while stack:
            (head, children), between = stack.pop()
            if children is None:
                for k, i in enumerate(head):
                    order.append(i)
                    lcp.append(between if k == 0 else len(self.strings[i]))
            else:
                ranked = sorted(children)
                for b in reversed(ranked[1:]):
                    stack.append((children[b], head))
                stack.append((children[ranked[0]], between))
        return order, lcp


def quicksort(strings: list[bytes], depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings by their first ``depth`` bytes, and the segment number of each place.

    Strings of one segment agree to that depth (shorter ones wholly).
    """
    n = len(strings)
    joined = np.frombuffer(b"".join(s[:depth].ljust(depth, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    size = np.minimum(np.array([len(s) for s in strings], np.int64), depth)
    columns = np.concatenate([joined, size[:, None].astype(np.uint64)], axis=1)  # the length parts padded strings
    order = np.arange(n)
    segment = np.zeros(n, np.int64)
    level = np.zeros(n, np.int64)  # of the string's segment
    while True:
        count = np.bincount(segment, minlength=1)
        open_ = np.flatnonzero((count[segment] > 1) & (level < columns.shape[1]))
        if not len(open_):
            return order, segment
        key = columns[order[open_], level[open_]]
        own = segment[open_]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        many = np.diff(np.concatenate([begin, [len(own)]]))
        pivot = np.repeat(key[begin + many // 2], many)
        side = (key > pivot).astype(np.int64) + (key >= pivot)  # 0 below, 1 equal, 2 above
        rank = np.argsort(own * 3 + side, kind="stable")
        order[open_] = order[open_][rank]
        sides = np.ones(n, np.int64)
        sides[open_] = side[rank]
        moved = level[open_][rank] + (side[rank] == 1)
        level[open_] = moved
        mark = segment * 3 + sides
        segment = np.cumsum(np.concatenate([[0], (mark[1:] != mark[:-1]).astype(np.int64)]))


def ordered_group(strings: list[bytes], group: list[int]) -> tuple[list[int], list[int]]:
    """The order of different strings by a blind trie, and common prefixes; that of two is their comparison."""
    if len(group) < 3:
        group.sort(key=strings.__getitem__)
        return group, [0, common(*map(strings.__getitem__, group))] if len(group) > 1 else [0]
    trie = BlindTrie(strings)
    for i in group:
        trie.add(i)
    return trie.ordered()


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of the strings and the common prefix of each with the one before it."""
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, segment = quicksort(strings)
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    ends, before, ranked, shared = [*begin[1:].tolist(), len(order)], order.tolist(), [], []
    for a, b in zip(begin.tolist(), ends, strict=True):
        if b - a == 1:
            ranked.append(before[a])
            shared.append(0)
            continue
        equal: dict[bytes, list[int]] = {}
        for i in before[a:b]:
            equal.setdefault(strings[i], []).append(i)
        for i, n in zip(*ordered_group(strings, [x[0] for x in equal.values()]), strict=True):
            own = equal[strings[i]]
            ranked += own
            shared += [n, *[len(strings[i])] * (len(own) - 1)]
    order, lcp = np.array(ranked, np.int64), np.array(shared, np.int64)
    # of neighbours in two segments
    heads = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), np.uint8).reshape(len(strings), -1)
    last, next_ = order[begin[1:] - 1], order[begin[1:]]
    other = np.concatenate([heads[last] != heads[next_], np.ones((len(last), 1), bool)], axis=1)
    sizes = np.array([len(s) for s in strings], np.int64)
    lcp[begin[1:]] = np.minimum(other.argmax(axis=1), np.minimum(sizes[last], sizes[next_]))
    return order, lcp
