"""An FM-index over word numbers: wavelet-tree ranks, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` in order; every 0 is a separator, smaller the earlier it stands.

    Prefix doubling that sorts only suffixes still tied. Separators differ from one another,
    so ties end with a passage, however many copies of it a shard holds.
    """
    n = len(symbols)
    first = symbols.astype(np.int64)
    gaps = first == 0
    first[~gaps] += int(gaps.sum())
    first[gaps] = np.arange(gaps.sum())
    ahead = np.append(first[1:] + 1, 0)
    key = first * (int(first.max(initial=0)) + 2) + ahead
    place = np.empty(n, np.int64)
    live, reach = np.arange(n), 2
    base = np.zeros(n, np.int64)
    while len(live):
        order = np.lexsort((key, base))
        live, key, base = live[order], key[order], base[order]
        new_base = np.append(True, base[1:] != base[:-1])
        new_key = new_base.copy()
        new_key[1:] |= key[1:] != key[:-1]
        at = np.arange(len(live))
        base_start = np.maximum.accumulate(np.where(new_base, at, 0))
        key_start = np.maximum.accumulate(np.where(new_key, at, 0))
        base = base + key_start - base_start
        place[live] = base
        tied = ~(new_key & np.append(new_key[1:], True))
        live, base = live[tied], base[tied]
        ahead = live + reach
        key = np.where(ahead < n, place[np.minimum(ahead, n - 1)] + 1, 0)
        reach *= 2
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order


class WaveletTree:
    """Ranks of any symbol in a sequence, one bit of the symbol to a level (matrix layout)."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma).bit_length())
        self.zeros: list[np.ndarray] = []
        current = sequence
        for level in range(self.bits - 1, -1, -1):
            one = (current >> level) & 1 == 1
            self.zeros.append(np.append(0, np.cumsum(~one, dtype=np.int32)).astype(np.int32))
            current = np.concatenate([current[~one], current[one]])
        self.start = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            before = zeros[at].astype(np.int64)
            at = np.where((symbol >> level) & 1 == 1, zeros[-1] + at - before, before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``at``."""
        return self._down(symbol, at) - self.start[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for zeros in self.zeros:
            before = zeros[at].astype(np.int64)
            one = zeros[at + 1] == before
            symbol = symbol * 2 + one
            at = np.where(one, zeros[-1] + at - before, before)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Find every occurrence of word sequences in one shard. Symbol 0 separates passages."""

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = 8) -> None:
        order = suffix_order(symbols)
        last = symbols[order - 1].astype(np.int64)
        if len(order):
            last[order == 0] = 0
        self.tree = WaveletTree(last, sigma)
        self.before = np.append(0, np.cumsum(np.bincount(symbols, minlength=sigma + 1)))[: sigma + 1]
        kept = (order % rate == 0) | (last == 0)
        self.kept, self.kept_before = kept, np.append(0, np.cumsum(kept))
        self.position = order[kept]
        self.size = len(symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (one to a row): ranges of suffixes [lo, hi)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            lo[live] = self.before[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back through the text to the nearest sampled one."""
        out = np.empty(len(suffixes), np.int64)
        live, at, steps = np.arange(len(suffixes)), suffixes, 0
        while len(live):
            here = self.kept[at]
            out[live[here]] = self.position[self.kept_before[at[here]]] + steps
            live, at = live[~here], at[~here]
            symbol, rank = self.tree.access_rank(at)
            at = self.before[symbol] + rank
            steps += 1
        return out
