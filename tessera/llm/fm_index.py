"""A succinct FM-index over sequences of word numbers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank over a sequence of small numbers: one bit vector for each binary digit, levels laid out end to end.

    Each vector is packed 64 bits a word. Counts are kept for blocks of eight words, and within a block in 16 bits a word:
    about a third of a bit beside each bit. A rank is two lookups and one popcount.
    """

    def __init__(self, a: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.words, self.blocks, self.inside, self.zeros = [], [], [], []
        order = np.arange(symbols, dtype=np.int64)
        seen = np.bincount(a, minlength=symbols)
        for d in range(self.depth - 1, -1, -1):
            bit = (a >> d) & 1
            packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(-len(bit) % 512 + 512, np.uint8)]), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).reshape(-1, 8).astype(np.uint16)
            upto = np.cumsum(ones, axis=1, dtype=np.uint16)
            self.words.append(packed)
            self.inside.append((upto - ones).ravel())
            self.blocks.append(np.concatenate([[0], np.cumsum(upto[:-1, -1], dtype=np.int64)]).astype(np.uint32))
            self.zeros.append(int(len(a) - bit.sum()))
            a = np.concatenate([a[bit == 0], a[bit == 1]])
            up = (order >> d) & 1
            order = np.concatenate([order[up == 0], order[up == 1]])
        self.start = np.zeros(symbols, np.int64)
        self.start[order] = np.cumsum(seen[order]) - seen[order]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before place i."""
        for level in range(self.depth):
            w = i >> 6
            part = np.bitwise_count(self.words[level][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            ones = self.blocks[level][w >> 3].astype(np.int64) + self.inside[level][w] + part
            i = np.where((c >> (self.depth - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i - self.start[c]


class FMIndex:
    """Over texts of numbers from 1 on, each followed by a 0. Exact for patterns of up to longest symbols."""

    def __init__(self, texts: np.ndarray, longest: int):
        n = len(texts)
        self.symbols = int(texts.max()) + 1 if n else 1
        place = np.argsort(texts, kind="stable")
        rank = texts.astype(np.int64)
        h = 1
        while h < longest:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            key = rank * (n + self.symbols + 2) + after
            place = np.argsort(key, kind="stable")
            ordered = key[place]
            new = np.zeros(n, np.int64)
            new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
            rank = np.empty(n, np.int64)
            rank[place] = new
            h *= 2
            if n and new[-1] == n - 1:
                break
        self.tree = WaveletTree(texts[place - 1], self.symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=self.symbols))])
        self.n = n

    def repeated(self, texts: np.ndarray, first: np.ndarray, stop: np.ndarray, window: int, least: int = 2) -> np.ndarray:
        """For each range of texts: bits of its windows that stand least times or more in the index.

        Matching statistics by backward search from the range's end: how many symbols up to there stand so often. Windows
        within the match are found together; the search goes on at the end of the next window that it leaves open.
        Ranges are of one window at least and 62 at most.
        """
        masks = np.zeros(len(first), np.int64)
        which, end, size = np.arange(len(first)), stop.copy(), np.zeros(len(first), np.int64)
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), self.n, np.int64)
        while len(which):
            at = end - size - 1
            inside = at >= first[which]
            c = np.where(inside, texts[at], 0)
            both = self.before[c] + self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi])).reshape(2, -1)
            on = inside & (both[1] - both[0] >= least)
            lo, hi, size = np.where(on, both[0], 0), np.where(on, both[1], self.n), np.where(on, size + 1, size)
            off = np.flatnonzero(~on)
            if len(off):
                s, e, w = size[off], end[off], which[off]
                hit = s >= window
                h = np.flatnonzero(hit)
                masks[w[h]] |= ((np.int64(1) << (s[h] - window + 1)) - 1) << (e[h] - s[h] - first[w[h]])
                end[off] = np.where(hit, e - s - 1 + window, e - 1)
                size[off] = 0
                left = end - window >= first[which]
                which, end, size, lo, hi = which[left], end[left], size[left], lo[left], hi[left]
        return masks
