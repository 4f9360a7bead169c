"""Best-fit-decreasing over runs of equal items, on a balanced tree of remaining capacities.

The input is a histogram (item size -> number of items), so its size does not grow with the
number of items: a run of equal items fills the tightest bin that holds one of them until no
more fit (after one item that bin is tighter still, so this is what item-by-item best fit does).
"""

from __future__ import annotations


class RemainingTree:
    """AA tree of ``(remaining capacity, bin)``: insert, delete and least entry not below a key."""

    __slots__ = ("root", "size")

    def __init__(self):
        self.root = None
        self.size = 0

    # a node is [key, level, left, right]
    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            r = t[3]
            t[3], r[2] = r[2], t
            r[1] += 1
            return r
        return t

    def insert(self, key):
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)
        self.size += 1

    def delete(self, key):
        def level(t):
            return t[1] if t else 0

        def drop(t, k):
            if t is None:
                raise KeyError(k)
            if k < t[0]:
                t[2] = drop(t[2], k)
            elif k > t[0]:
                t[3] = drop(t[3], k)
            elif t[2] is None and t[3] is None:
                return None
            elif t[2] is None:
                near = t[3]
                while near[2]:
                    near = near[2]
                t[0] = near[0]
                t[3] = drop(t[3], near[0])
            else:
                near = t[2]
                while near[3]:
                    near = near[3]
                t[0] = near[0]
                t[2] = drop(t[2], near[0])
            low = min(level(t[2]), level(t[3])) + 1
            if low < t[1]:
                t[1] = low
                if t[3] and t[3][1] > low:
                    t[3][1] = low
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.root = drop(self.root, key)
        self.size -= 1

    def ceiling(self, key):
        """Least entry that is not below ``key``, or None."""
        t, best = self.root, None
        while t:
            if t[0] < key:
                t = t[3]
            else:
                best, t = t[0], t[2]
        return best


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, max_bins: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Place ``(size, count)`` runs into bins of ``capacity``.

    Returns ``[(size, bin, count), ..]`` in order of placement and the number of bins, or None
    if ``max_bins`` do not hold everything.
    """
    tree, placed, bins = RemainingTree(), [], 0
    for size, count in sorted(runs, reverse=True):
        if size > capacity:
            return None if max_bins is not None else _raise(size, capacity)
        while count:
            spot = tree.ceiling((size, -1))
            if spot is None:
                if max_bins is not None and bins == max_bins:
                    return None
                room, b = capacity, bins
                bins += 1
            else:
                room, b = spot
                tree.delete(spot)
            k = min(count, room // size)
            placed.append((size, b, k))
            count -= k
            tree.insert((room - k * size, b))
    return placed, bins


def _raise(size, capacity):
    raise ValueError(f"an item of {size} does not fit into a bin of {capacity}")


def even_bins(runs: list[tuple[int, int]], n_bins: int) -> tuple[list[tuple[int, int, int]], int]:
    """Best fit decreasing into ``n_bins`` bins at the least capacity that it manages with
    (bisection); returns the placement and that capacity."""
    if not runs:
        return [], 0
    total = sum(s * c for s, c in runs)
    lo = max(-(-total // n_bins), max(s for s, _ in runs))
    hi = lo
    while (got := best_fit_decreasing(runs, hi, n_bins)) is None:
        hi += max(1, hi // 8)
    best = got[0]
    while lo < hi:
        mid = (lo + hi) // 2
        got = best_fit_decreasing(runs, mid, n_bins)
        if got is None:
            lo = mid + 1
        else:
            hi, best = mid, got[0]
    return best, hi
