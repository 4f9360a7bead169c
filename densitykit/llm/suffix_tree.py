"""Suffix tree of one integer sequence, constant-time longest common extensions, and the maximal repetitions.

Ukkonen's construction reads the sequence once. The Euler tour of the tree, with the string depth of each visit, turns
the lowest common ancestor of two leaves into a range minimum; the longest common extension of two places is that
minimum. Many queries are answered at once.
"""

from __future__ import annotations

import numpy as np

#: Tour entries in a block of the range-minimum structure.
BLOCK = 16


class RangeMin:
    """Minimum of any range by blocks: running minima inside them, doubled spans of whole ones."""

    def __init__(self, a: np.ndarray):
        n = -(-len(a) // BLOCK)
        self.a = np.full(n * BLOCK, np.iinfo(a.dtype).max, a.dtype)
        self.a[:len(a)] = a
        rows = self.a.reshape(n, BLOCK)
        self.fore = np.minimum.accumulate(rows, axis=1).ravel()
        self.back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.spans = [rows.min(axis=1)]
        while 2 << len(self.spans) - 1 <= n:
            half = 1 << len(self.spans) - 1
            self.spans.append(np.minimum(self.spans[-1][:-half], self.spans[-1][half:]))

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum over ``lo..hi``, both inside."""
        b, c = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.back[lo], self.fore[hi])
        one = np.flatnonzero(b == c)
        if len(one):
            least = self.a[lo[one]]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.a[np.minimum(lo[one] + step, hi[one])])
            out[one] = least
        far = np.flatnonzero(c - b > 1)
        if len(far):
            first, width = b[far] + 1, c[far] - b[far] - 1
            level = np.frexp(width.astype(float))[1] - 1
            for k in np.unique(level):
                at = level == k
                f, w = first[at], width[at]
                least = np.minimum(self.spans[k][f], self.spans[k][f + w - (1 << int(k))])
                out[far[at]] = np.minimum(out[far[at]], least)
        return out


class SuffixTree:
    """Tree of ``word`` (integers from 1) with an end mark below all of them."""

    def __init__(self, word: list[int], sigma: int):
        self.n = len(word)
        text = [*word, 0]
        wide = sigma + 1
        start, stop, edge, leaves = _ukkonen(text, wide)
        self._tour(np.array(start), np.array(stop), edge, wide, leaves)

    def _tour(self, start, stop, edge, wide, leaves):
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        kids = np.fromiter(edge.values(), np.int64, len(edge))
        order = np.argsort(keys, kind="stable")
        first = np.searchsorted(keys[order] // wide, np.arange(len(start) + 1)).tolist()
        kids, size = kids[order].tolist(), (stop - start).tolist()
        at, ends = first[:-1], first[1:]
        depth, place = [0] * len(size), [0] * len(size)
        visits, above, node = [0], [], 0
        while True:
            if at[node] < ends[node]:
                child = kids[at[node]]
                at[node] += 1
                above.append(node)
                depth[child] = depth[node] + size[child]
                node = child
                place[node] = len(visits)
            elif above:
                node = above.pop()
            else:
                break
            visits.append(depth[node])
        self.place = np.array(place)[leaves]
        self.depths = RangeMin(np.array(visits, np.int32))
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[np.argsort(self.place)] = np.arange(len(leaves))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j`` (different places, up to n)."""
        a, b = self.place[i], self.place[j]
        return self.depths.query(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def _ukkonen(text: list[int], wide: int):
    """Edge labels ``[start, stop)`` of the nodes, child by ``node * wide + symbol``, leaves in suffix order."""
    n = len(text)
    start, stop, link, edge, leaves = [0], [0], [0], {}, []
    node = at = length = pending = 0  # the active point and the suffixes still implicit
    for i, c in enumerate(text):
        pending += 1
        fresh = 0  # inner node that waits for its suffix link
        while pending:
            if not length:
                at = i
            key = node * wide + text[at]
            child = edge.get(key)
            if child is None:
                edge[key] = leaf = len(start)
                owner = node
            else:
                s = start[child]
                span = stop[child] - s
                if length >= span:
                    node, at, length = child, at + span, length - span
                    continue
                if text[s + length] == c:
                    if fresh:
                        link[fresh] = node
                    length += 1
                    break
                owner = len(start)
                start.append(s)
                stop.append(s + length)
                link.append(0)
                edge[key] = owner
                start[child] = s + length
                edge[owner * wide + text[s + length]] = child
                edge[owner * wide + c] = leaf = len(start)
            leaves.append(leaf)
            start.append(i)
            stop.append(n)
            link.append(0)
            if fresh:
                link[fresh] = owner
            fresh = owner if child is not None else 0
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - pending + 1
    return start, stop, edge, leaves


def _next_smaller(rank: list[int], n: int) -> np.ndarray:
    """For each place the next one of lower rank (n + 1 if there is none); ranks cover places 0..n."""
    after = [n + 1] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, r = i + 1, rank[i]
        while j <= n and rank[j] > r:
            j = after[j]
        after[i] = j
    return np.array(after[:n])


def repetitions(word: np.ndarray, least_exponent: int = 2, least_length: int = 2) -> np.ndarray:
    """All maximal stretches of ``word`` with smallest period q, ``least_exponent * q`` long at least (2 or more),
    and ``least_length``: rows ``start, length, period`` by start, then period.

    The longest Lyndon word at a place ends at the next smaller suffix. Each repetition has such a word as a root, in
    the order of the symbols or in the opposite one; its period, extended to both sides by longest common extensions
    of the sequence and of its reversal, gives the stretch.
    """
    n = len(word)
    if n < max(2, least_length):
        return np.zeros((0, 3), np.int64)
    symbols, ids = np.unique(word, return_inverse=True)
    seq = (ids + 1).tolist()
    tree = SuffixTree(seq, len(symbols))
    rank = tree.rank
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_next_smaller(rank.tolist(), n), _next_smaller((n - rank).tolist(), n)])
    able = (j <= n) & ((j - i) * least_exponent <= n)
    i, j = i[able], j[able]
    both = np.unique(i * (n + 1) + j)
    i, j = both // (n + 1), both % (n + 1)
    end = j + tree.extension(i, j)
    back = SuffixTree(seq[::-1], len(symbols))
    start = i - back.extension(n - i, n - j)
    p = j - i
    good = (end - start >= least_exponent * p) & (end - start >= least_length)
    found = np.unique(np.stack([start, p, end - start], axis=1)[good], axis=0)
    return found[:, [0, 2, 1]]
