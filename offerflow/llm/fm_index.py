"""An FM-index over a sequence of small integers, by numpy: suffix order, wavelet matrix,
backward search for many patterns at once, and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``seq`` in lexical order. The last symbol must be the only 0.

    Packs as many symbols as fit 62 bits for a first sort, then doubles the compared length
    for the suffixes that are not yet apart."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        part = np.zeros(n, dtype=np.int64)
        part[:max(n - j, 0)] = seq[j:]
        key = (key << bits) | part
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    start = np.flatnonzero(new)
    group = np.repeat(start, np.diff(np.append(start, n)))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    step = width
    while True:
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        todo = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(todo):
            return order
        suffix = order[todo]
        after = suffix + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[suffix]
        place = np.lexsort((second, first))
        order[todo] = suffix[place]
        first, second = first[place], second[place]
        apart = np.ones(len(todo), dtype=bool)
        apart[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[todo] |= apart
        begins = np.flatnonzero(apart)
        rank[order[todo]] = np.repeat(todo[begins], np.diff(np.append(begins, len(todo))))
        step *= 2


class _Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """``seq`` holds symbols of 1 and up; searches find where patterns begin in it."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        text = np.append(np.asarray(seq, dtype=np.int64), 0)
        order = suffix_order(text)
        last = text[order - 1]  # the symbol before each suffix; the whole text's is the end mark
        self.n, self.bits = len(text), max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << self.bits) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.levels, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (last >> level & 1).astype(bool)
            self.levels.append(_Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        kept = order % sample == 0
        self.marked, self.places = _Bits(kept), order[kept]

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at`` in the last column."""
        low = np.zeros_like(at)
        for k, bits in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(at)
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return at - low

    def _step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        symbol, at, low = np.zeros_like(row), row, np.zeros_like(row)
        for k, bits in enumerate(self.levels):
            one = bits.get(at)
            symbol = symbol << 1 | one
            a, b = bits.rank(low), bits.rank(at)
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return self.smaller[symbol] + at - low

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray):
        """Rows (from, to) of the suffixes that begin with each pattern. Patterns are filled up at
        their end."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for back in range(int(lengths.max()) if len(lengths) else 0):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - back]
            inside = symbol < len(self.smaller) - 1
            known = np.where(inside, symbol, 0)
            a = self.smaller[known] + self._rank(known, low[live])
            b = self.smaller[known] + self._rank(known, high[live])
            low[live], high[live] = np.where(inside, a, 0), np.where(inside, b, 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of the rows begin: steps back to a sampled one."""
        rows = rows.astype(np.int64)
        out, steps = np.full(len(rows), -1, dtype=np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            found = self.marked.get(rows[left])
            hit = left[found]
            out[hit] = self.places[self.marked.rank(rows[hit])] + steps
            left = left[~found]
            rows[left] = self._step_back(rows[left])
            steps += 1
        return out
