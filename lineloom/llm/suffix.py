"""Suffix arrays and common-prefix intervals over integer sequences, by prefix doubling in numpy."""

from __future__ import annotations

import numpy as np


class SuffixIndex:
    """Suffixes of ``ids`` in order, with common-prefix lengths, up to ``depth`` symbols (0: unbounded).

    Every record should end with a symbol that occurs once, so that no common prefix crosses records.
    Ties beyond ``depth`` stand in text order, so members of an interval of that depth are in text order.
    """

    def __init__(self, ids: np.ndarray, depth: int = 0):
        n = len(ids)
        self.n = n
        if not n:
            self.order = np.zeros(0, np.int64)
            self.lcp = np.zeros(0, np.int64)
            return
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        levels, width = [rank], 1
        order = np.argsort(rank, kind="stable")
        while not depth or width < depth:
            key = rank * (n + 1)
            if width < n:
                key[:-width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            levels.append(rank)
            width *= 2
            if new[-1] == n - 1 or width >= n:
                break
        self.order = order
        self.lcp = self._common(levels, order, n)
        if depth:
            np.minimum(self.lcp, depth, out=self.lcp)

    @staticmethod
    def _common(levels: list[np.ndarray], order: np.ndarray, n: int) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order, from the ranks of each doubling."""
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(n, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            rank, step = levels[level], 1 << level
            for _ in range(1 if level < len(levels) - 1 else 2):
                inside = (a < n) & (b < n)
                same = np.zeros(n - 1, bool)
                same[inside] = rank[a[inside]] == rank[b[inside]]
                length[1:][same] += step
                a[same] += step
                b[same] += step
        return length

    def intervals(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the interval of ``depth`` common symbols that each place in the order belongs to, and its starts."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = self.lcp < depth
        first[0] = True
        return np.cumsum(first) - 1, np.flatnonzero(first)

    def counts(self, depth: int, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each interval of ``depth``: its start in the order, its occurrences, and its records.

        Records are the occurrences less the adjacencies, in text order, of two occurrences of one record.
        """
        number, starts = self.intervals(depth)
        if not self.n:
            return starts, starts, starts
        widths = np.diff(np.append(starts, self.n))
        place = np.lexsort((self.order, number))
        rec, num = record[self.order[place]], number[place]
        again = (rec[1:] == rec[:-1]) & (num[1:] == num[:-1])
        repeats = np.bincount(num[1:][again], minlength=len(starts))
        return starts, widths, widths - repeats
