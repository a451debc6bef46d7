"""Parity sketches of sets: the parity of how many members fall in each of a number of cells.

The cells in which two sketches differ are at most as many as the members that
only one set has, so they bound the symmetric difference from below. Larger sets
get longer sketches, each twice as long as the one below; a longer one folds to
a shorter one, so sets of unlike size compare at the length that both have.
"""

from __future__ import annotations

import numpy as np

from corpusloom.llm.hashing import mixed


class Shape:
    """64 cells for sets of up to unit members, twice as many for each doubling, at most 64 << most."""

    def __init__(self, unit: int, most: int) -> None:
        self.unit, self.most = unit, most

    def levels(self, size: np.ndarray) -> np.ndarray:
        return np.minimum(np.ceil(np.log2(np.maximum(size, self.unit) / self.unit)), self.most).astype(np.int64)

    def lengths(self, size: np.ndarray) -> np.ndarray:
        """64-bit words of each sketch."""
        return 1 << self.levels(size)

    def made(self, size: np.ndarray, members: np.ndarray) -> np.ndarray:
        """The sketches of sets that stand one after the other, likewise."""
        wide = 64 * self.lengths(size)
        before = np.cumsum(wide) - wide
        cell = (mixed(members, 3) & np.repeat((wide - 1).astype(np.uint64), size)).astype(np.int64)
        odd = np.bincount(np.repeat(before, size) + cell, minlength=int(wide.sum())) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


class Sketches:
    """Sketches of sets of these sizes, one after the other in flat."""

    def __init__(self, shape: Shape, size: np.ndarray, flat: np.ndarray) -> None:
        self.level = shape.levels(size)
        wide = 1 << self.level
        starts = np.cumsum(wide) - wide
        self.folded, self.row = [], []
        for level in range(int(self.level.max(initial=0)) + 1):
            has = np.flatnonzero(self.level >= level)
            out = np.zeros((len(has), 1 << level), np.uint64)
            for own in range(level, int(self.level.max(initial=0)) + 1):
                at = np.flatnonzero(self.level[has] == own)
                if len(at):
                    x = flat[starts[has[at]][:, None] + np.arange(1 << own)].reshape(len(at), -1, 1 << level)
                    out[at] = np.bitwise_xor.reduce(x, axis=1)
            row = np.zeros(len(size), np.int32)
            row[has] = np.arange(len(has))
            self.folded.append(out)
            self.row.append(row)

    def near(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are apart by at most most cells at 64 cells and at the length that both have, and by how many at the latter."""
        short = self.folded[0][:, 0]
        apart = np.bitwise_count(short[i] ^ short[j]).astype(np.int64)
        at = np.flatnonzero(apart <= most)
        common = np.minimum(self.level[i[at]], self.level[j[at]])
        for level in range(1, len(self.folded)):
            own = at[common == level]
            # as many at once as fit a small block, whatever the length
            for part in np.array_split(own, -(-(len(own) << level) // 4_000_000) or 1):
                if len(part):
                    folded, row = self.folded[level], self.row[level]
                    apart[part] = np.bitwise_count(folded[row[i[part]]] ^ folded[row[j[part]]]).sum(1)
        at = at[apart[at] <= most[at]]
        return at, apart[at]


def partners(group: np.ndarray, size: np.ndarray, narrow, look, beside: int, at_once: int) -> None:
    """All pairs of one group and of near sizes that may matter, a block at a time.

    The rows are in order of (group, size). narrow: (least, most) sizes that a
    size can go with. look(i, j) gets positions of pairs and returns which rows
    need no more; first each row's next beside neighbours, then for the rows that
    still look all others within reach. A pair is left out only where neither
    row looks any more."""
    n = len(group)
    if n < 2:
        return
    size = size.astype(np.int64)
    wide = int(size.max()) + 2
    base = np.cumsum(np.diff(group, prepend=group[0]) != 0) * wide
    least, most = narrow(size)
    low = np.searchsorted(base + size, base + np.minimum(least, wide - 1), side="left")
    high = np.searchsorted(base + size, base + np.minimum(most, wide - 1), side="right")
    done, alive = np.zeros(n, bool), np.arange(n)
    for lag in range(1, beside + 1):
        alive = alive[alive + lag < high[alive]]
        for part in np.array_split(alive, -(-len(alive) // at_once) or 1):
            if len(part):
                done[look(part, part + lag)] = True
    open_ = ~done
    own = np.flatnonzero(open_)
    for begin, end, above in ((low[own], own - beside, False), (own + beside + 1, high[own], True)):
        count = np.maximum(end - begin, 0)
        total, a = np.cumsum(count), 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, side="right")))
            i = np.repeat(own[a:b], count[a:b])
            j = np.repeat(begin[a:b] - np.cumsum(count[a:b]) + count[a:b], count[a:b]) + np.arange(len(i))
            use = ~(done[i] & done[j]) & (~open_[j] if above else True)
            done[look(np.minimum(i, j)[use], np.maximum(i, j)[use])] = True
            a = b
