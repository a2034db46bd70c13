"""Words and their 64-bit hashes from Arrow string columns, in numpy passes over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 21

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and its inverse modulo 2**64, for i below n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = 1 << int(n - 1).bit_length()
        both = []
        for base in (_P, _P_INV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and each text's offsets in them; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows again, about SLICE_BYTES of text at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.diff(raw(b.column(b.schema.get_field_index(column)))[1])
        total = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            n = max(1, int(np.searchsorted(total, base + SLICE_BYTES, "right")) - at)
            yield b.slice(at, n)
            at += n


class Words:
    """Words (runs without white space) of a slice of texts.

    starts and ends: byte places in buf; first: the first word of each text, with the total at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.buf, self.off = raw(texts)
        if lower:
            self.buf = _LOWER[self.buf]
        n = len(self.buf)
        inside = ~_SPACE[self.buf]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        heads = self.off[:-1][(self.off[:-1] < n) & (np.diff(self.off) > 0)]
        start[heads] = inside[heads]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        tails = heads[heads > 0] - 1
        end[tails] = inside[tails]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        p, inv = powers(len(self.buf) + 1)
        cs = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[: len(self.buf)], out=cs[1:])
        h = (cs[self.ends] - cs[self.starts]) * inv[self.starts]
        return mix(h ^ mix((self.ends - self.starts).astype(np.uint64)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; the last k - 1 places are cut off."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(_P) + h[j : j + n]
    return mix(g)


def owners(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each place of grams(): True if its k words are of one text."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    cuts = first[1:-1]
    for j in range(1, k):
        at = cuts - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok
