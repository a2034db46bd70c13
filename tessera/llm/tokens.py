"""Token ids of whole texts by a public tokenizer file.

A word-level vocabulary drops white space and never joins across it, nor between a letter or digit and a mark. So a text's
ids are those of its units in a row: runs of ASCII letters and digits, runs of ASCII marks, and runs with an apostrophe or
other characters as they stand. Units repeat: a worker keeps the ids of those it has met in numpy tables, by a 64-bit hash of
the lower-cased bytes, and only new ones go to the tokenizer, many in one call. Each piece's ids end with one that closes
a word, which tells where the next begins. A slice of texts is looked up and put together in a few numpy passes.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .textbytes import mix, powers, raw

#: Units that go to the tokenizer alone: with white space beyond ASCII, or a letter that becomes two when lower-cased.
ODD = re.compile("[\\sİ]")
#: Ends the last token of each piece in word-level vocabularies.
SUFFIX = "</w>"
#: Units in one call of the tokenizer.
CALL = 8192

#: Kinds of bytes: white space, ASCII letters and digits, ASCII marks, others. A text is cut beside white space and between the second and the third.
BLANK, PLAIN, MARK, OTHER = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = PLAIN
_KIND[ord("'")] = OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern(settings: dict) -> str | None:
    """The pattern of a word-level vocabulary's pieces; None if the file is of another kind."""
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [x.get("type") for x in (settings.get("normalizer") or {}).get("normalizers", [])]
    if settings["model"].get("end_of_word_suffix") != SUFFIX or kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
        return None
    if not all(re.fullmatch(r"<\|\w+\|>", x["content"]) for x in settings["added_tokens"]):
        return None
    return steps[0]["pattern"].get("Regex")


class WordTokens:
    """Ids of texts, each with `end` after it. Files that aren't word-level, and texts with "<|" (a special token may follow), are encoded whole.

    When the tables hold `most` units they start anew.
    """

    def __init__(self, path: str, end: int = 1, most: int = 2_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.end, self.most = end, most
        with open(path, encoding="utf-8") as f:
            pattern = piece_pattern(settings := json.load(f))
        self.pieces = regex.compile(pattern) if pattern else None
        if pattern:
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closes[[i for x, i in settings["model"]["vocab"].items() if x.endswith(SUFFIX)]] = True
        self._forget()

    def _forget(self) -> None:
        """Tables: hashes in order, and the ids of each one as a range of the pool, which begins with `end`."""
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.full(1 << 16, self.end, np.uint32), 1

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _count(self, unit: str) -> int:
        """Pieces of a unit; 0 if it is odd."""
        if not unit.isascii():
            unit = unicodedata.normalize("NFC", unit)
        if unit.isalpha() and "İ" not in unit:
            return 1
        return 0 if ODD.search(unit) else len(self.pieces.findall("".join(map(str.lower, unit))))

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end, and how many each has."""
        counts = np.fromiter(map(self._count, units), np.int64, len(units))
        if counts.all():
            # the quicker call, without offsets
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) == counts.sum() and (not len(ids) or stops[-1] == len(ids)):
                return ids, np.diff(stops[np.cumsum(counts) - 1], prepend=0)
            counts[:] = 0
        odd = np.flatnonzero(counts == 0)
        parts = {j: self._whole(units[j]) for j in odd.tolist()}
        if len(odd) < len(units):
            ids, sizes = self._ids([u for u, n in zip(units, counts, strict=True) if n])
            parts |= dict(zip(np.flatnonzero(counts).tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
        parts = [parts[j] for j in range(len(units))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        begin, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int32)
        for a in range(0, len(units), CALL):
            ids, sizes = self._ids([u.decode() for u in units[a : a + CALL]])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
            self.pool[self.used : self.used + len(ids)] = ids
            begin[a : a + CALL], size[a : a + CALL] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.begin, self.size = np.insert(self.begin, at, begin[order]), np.insert(self.size, at, size[order])

    def _places(self, h: np.ndarray, unit) -> np.ndarray:
        """The table row of each hash; unit(k) gives the bytes of the k-th."""
        coded = pa.array(h).dictionary_encode()
        met = coded.dictionary.to_numpy()
        at = np.searchsorted(self.hashes, met)
        new = np.ones(len(met), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != met[inside]
        which = coded.indices.to_numpy()
        if new.any():
            if len(self.hashes) + new.sum() > self.most and len(self.hashes):
                self._forget()
                return self._places(h, unit)
            one = np.zeros(len(met), np.int64)
            one[which] = np.arange(len(h))
            self._learn(met[new], [unit(k) for k in one[new].tolist()])
            at = np.searchsorted(self.hashes, met)
        return at[which]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin, with the total at the end. Nulls are empty texts."""
        buf, off = raw(texts)
        data, n = buf.tobytes(), len(texts)
        if self.pieces is None or b"<|" in data:
            alone = [self.pieces is None or b"<|" in data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        else:
            alone = [False] * n
        kind = _KIND[buf]
        if any(alone):
            for j in np.flatnonzero(alone).tolist():
                kind[off[j] : off[j + 1]] = BLANK
        low = _LOWER[buf]
        cut = np.ones(len(buf) + 1, bool)
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (a == BLANK) | (b == BLANK) | ((a ^ b == PLAIN ^ MARK) & (a != OTHER) & (b != OTHER))
        cut[off] = True
        edge = np.flatnonzero(cut)
        keep = kind[edge[:-1]] != BLANK if len(buf) else np.zeros(0, bool)
        starts, ends = edge[:-1][keep], edge[1:][keep]
        p, inv = powers(len(buf) + 1)
        cs = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=cs[1:])
        h = mix((cs[ends] - cs[starts]) * inv[starts] ^ mix((ends - starts).astype(np.uint64)))
        lows = low.tobytes()
        at = self._places(h, lambda k: lows[starts[k] : ends[k]])
        # units and, after each text's, the end id (place 0 of the pool)
        stop = np.searchsorted(starts, off[1:])
        begin, size = np.insert(self.begin[at], stop, 0), np.insert(self.size[at], stop, 1).astype(np.int64)
        total = np.cumsum(size)
        ids = self.pool[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        first = np.concatenate([[0], total[stop + np.arange(n)]])
        if any(alone):
            parts = [np.append(self._whole(texts[j].as_py() or ""), np.uint32(self.end)) if alone[j] else ids[first[j] : first[j + 1]] for j in range(n)]
            ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, first


_tokens: dict[tuple, WordTokens] = {}


def word_tokens(path: str, end: int) -> WordTokens:
    """One for each vocabulary and worker: what it has seen serves the worker's later tasks too."""
    if (path, end) not in _tokens:
        _tokens[path, end] = WordTokens(path, end)
    return _tokens[path, end]
