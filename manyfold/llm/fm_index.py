"""An FM-index over word numbers: wavelet-matrix ranks, vectorised backward search, located by sampled positions."""

from __future__ import annotations

import numpy as np

SEPARATOR = 1  # 0 is the end of the text


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of ``seq`` in order; each separator sorts by its place, so no comparison runs past one.

    Prefix doubling that only re-sorts the suffixes still tied: repeats cost rounds for themselves alone.
    """
    n = len(seq)
    breaks = seq == SEPARATOR
    # separators get places 1..b among themselves; words come after all of them
    rank = np.where(breaks, np.cumsum(breaks), seq + int(breaks.sum())).astype(np.int64)
    rank[seq == 0] = 0
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
    width = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, width)
    step = 1
    tied = np.flatnonzero(np.repeat(width, width) > 1)  # places in order whose suffixes are tied
    while len(tied):
        who = order[tied]
        ahead = np.where(who + step < n, rank[np.minimum(who + step, n - 1)], -1)
        by = np.lexsort((ahead, rank[who]))
        who, ahead = who[by], ahead[by]
        order[tied] = who
        group = rank[who]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])))
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(who)))
        rank[who] = np.repeat(tied[starts], sizes)
        tied = tied[np.repeat(sizes, sizes) > 1]
        step *= 2
    return order


class FMIndex:
    """Index of ``seq`` (word numbers >= 2, segments closed by SEPARATOR).

    Backward search never crosses a separator, and the first word of each segment has its position sampled, so walking
    back from an occurrence ends inside its segment.
    """

    def __init__(self, seq: np.ndarray, sample: int = 8):
        seq = np.append(np.asarray(seq, np.int64), 0)
        self.size = len(seq)
        order = suffix_array(seq)
        symbols = int(seq.max()) + 1
        self.levels = max(1, int(symbols - 1).bit_length())
        self.base = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=1 << self.levels))))
        marked = (order % sample == 0) | (np.concatenate(([SEPARATOR], seq[:-1]))[order] == SEPARATOR)
        self.marked = marked
        self.mark_rank = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.samples = order[marked]
        column = seq[order - 1]
        self.ranks, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = column >> level & 1
            self.ranks.append(np.concatenate(([0], np.cumsum(bits))).astype(np.int32))
            self.zeros.append(self.size - int(self.ranks[-1][-1]))
            column = np.concatenate((column[bits == 0], column[bits == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transformed text."""
        low = np.zeros_like(at)
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbol >> level & 1).astype(bool)
            ones, zeros = self.ranks[k], self.zeros[k]
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer (the symbol is read off the same wavelet levels)."""
        symbol, low, at = np.zeros_like(row), np.zeros_like(row), row
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol << 1 | bit
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return self.base[symbol] + at - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of all phrases at once; ``phrases`` is right-padded, ``lengths`` tells how much counts."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - step]
            known = symbol < 1 << self.levels
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            start = self.base[symbol]
            low[live] = start + self.rank(symbol, low[live])
            high[live] = start + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled position and add the steps."""
        out, row = np.full(len(rows), -1, np.int64), rows.astype(np.int64)
        todo = np.arange(len(rows))
        steps = 0
        while len(todo):
            done = self.marked[row]
            out[todo[done]] = self.samples[self.mark_rank[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            row = self.back(row)
            steps += 1
        return out
