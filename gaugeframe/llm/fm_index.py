"""An FM-index over word numbers: backward search on a wavelet matrix of packed bits.

Everything is an array operation over many searches at once. The index keeps one bit for
each text place and bit of a word number, a running count for each 64 of them, the places
where words start in the sorted order, and running weights in the order of the suffixes.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 1
#: The number of the first word; 0 ends the text, 1 stands between its parts.
FIRST_WORD = 2


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the sorted prefix; the last symbol is unique."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank << 32
        key[: n - step] |= rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(sorted_[1:] != sorted_[:-1])
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n = len(symbols)
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        left = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (left >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            words[: len(packed)] = packed
            words = words.view("<u8")
            self.bits.append(words)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words)[:-1], dtype=np.int64))))
            self.zeros.append(int(self.n - bit.sum()))
            left = np.concatenate((left[~bit], left[bit]))
        #: Where each symbol starts on the last level.
        self.starts = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            high = (symbols >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(high, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbols, at) - self.starts[symbols]


class FMIndex:
    """``parts`` are sequences of word numbers (from ``FIRST_WORD``), ``weights`` how often each counts."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, size: int):
        ends = np.cumsum(lengths + 1)
        text = np.full(int(lengths.sum()) + len(lengths) + 1, SEPARATOR, np.int64)
        keep = np.ones(len(text), bool)
        keep[ends - 1] = False
        keep[-1] = False
        text[keep] = words
        text[-1] = 0
        order = suffix_order(text)
        self.size = size
        self.matrix = WaveletMatrix(text[order - 1], size)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        weight = np.append(np.repeat(weights, lengths + 1), 0)
        self.weights = np.concatenate(([0], np.cumsum(weight[order])))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The suffixes that start with each symbol and go on as those in ``low:high``."""
        both = self.matrix.rank(np.tile(symbols, 2), np.concatenate((low, high)))
        n = len(symbols)
        return self.before[symbols] + both[:n], self.before[symbols] + both[n:]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weights[high] - self.weights[low]


def repeated_windows(
    index: FMIndex,
    words: np.ndarray,
    first: np.ndarray,
    lengths: np.ndarray,
    least: int,
    window: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges ``(query, from, to)`` of window starts, such that each window weighs ``least`` or more.

    Query q is ``words[first[q]:first[q] + lengths[q]]``; words below 0 are not in the index.
    Searches go backward from an end. One that reaches the first window of its range settles
    the range. One that fails leaves a match whose windows are settled too, and the match
    with one more word occurs too seldom, which settles the windows that hold it.
    """
    query = np.flatnonzero(lengths >= window)
    low_window = np.zeros(len(query), np.int64)
    high_window = lengths[query] - window
    wide = np.ones(len(query), bool)  # from the end of the last window of the range, else of the first
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    everything = np.full(1, len(index.matrix.starts) and index.matrix.n)
    while len(query):
        end = np.where(wide, high_window, low_window) + window - 1
        at = end.copy()
        low, high = np.zeros(len(query), np.int64), np.repeat(everything, len(query))
        active = np.arange(len(query))
        while len(active):
            symbols = words[first[query[active]] + at[active]]
            known = symbols >= 0
            a, b = index.extend(np.maximum(symbols, 0), low[active], high[active])
            good = known & (index.weight(a, b) >= least)
            active, a, b = active[good], a[good], b[good]
            low[active], high[active] = a, b
            at[active] -= 1
            active = active[at[active] >= low_window[active]]
        # words after ``at`` up to ``end`` occur often enough, with the word at ``at`` they do not
        whole = at < low_window
        done = whole & (wide | (low_window == high_window))
        out.append((query[done], low_window[done], high_window[done]))
        settled = wide & ~whole & (at < high_window)
        out.append((query[settled], at[settled] + 1, high_window[settled]))
        more = []
        again = wide & ~whole
        more.append((again, low_window, np.minimum(at, high_window - 1), False))
        missed = ~wide & ~whole
        more.append((missed, at + 1, high_window, False))
        halved = ~wide & whole & ~done
        middle = (low_window + high_window) // 2
        more.append((halved, low_window, middle, True))
        more.append((halved, middle + 1, high_window, False))
        rows = [
            (query[m], a[m], b[m], np.full(int(m.sum()), w)) for m, a, b, w in more
        ]
        query, low_window, high_window, wide = (
            np.concatenate([r[k] for r in rows]) for k in range(4)
        )
        left = low_window <= high_window
        query, low_window, high_window, wide = (
            x[left] for x in (query, low_window, high_window, wide)
        )
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3)) if out else (
        np.zeros(0, np.int64),
        np.zeros(0, np.int64),
        np.zeros(0, np.int64),
    )
