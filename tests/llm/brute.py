"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re
import struct
import zlib

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, k=35):
    """[(id, text)] -> [(id, n_words, n_removed, sha)]"""
    words = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    count = collections.Counter(tuple(w[j : j + k]) for _, w in words for j in range(len(w) - k + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if count[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def contamination(rows, items, k=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        for j in range(max(1, len(w) - k + 1)) if w else ():
            windows[tuple(w[j : j + k])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[j : j + size]))) is not None:
                    found |= own
                    hit[j : j + size] = [1] * size
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0))
    return out


def shingle_set(text):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


def near_duplicates(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]


def base_counts(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    rep = [0] * len(w)
    for j in range(len(w) - 2):
        if count[tuple(w[j : j + 3])] > 1:
            rep[j : j + 3] = [1] * 3
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, sum(rep)


def token_bytes(texts, end=1):
    """Each whole text's ids by the tokenizer, and the end id, as bytes."""
    from tokenizers import Tokenizer

    from tessera.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary())
    return [struct.pack(f"<{len(x) + 1}I", *x, end) for x in (t.encode(s or "", add_special_tokens=False).ids for s in texts)]


def shard_slots(rows, n_bytes, block_bytes, length, slot_of):
    """Rows of doc_id, text, k2, h (hash of both) -> slot: number of ids, crc32 of them as 32-bit numbers."""
    blocks = max(1, -(-n_bytes // block_bytes))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["h"] % blocks].append(r)
    parts = []
    for b in sorted(by):
        own = sorted(by[b], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["k2"]))
        data = b"".join(token_bytes([r["text"] for r in own]))
        parts += [data[k : k + 4 * length] for k in range(0, len(data), 4 * length)]
    return {slot_of(k, len(parts)): (len(x) // 4, zlib.crc32(x)) for k, x in enumerate(parts)}


def quality_kept(texts, threshold=0.5, steps=50):
    """Whether each text is kept: rules vote, expectation-maximisation goes over the texts one by one."""
    import math

    votes, failed = [], []
    for t in texts:
        n, chars, symbols, dup, rep = base_counts(t)
        lines = [x for x in (t or "").split("\n") if SPACE_WORD.search(x)]
        w, c, rows, kinds = max(n, 1), max(chars, 1), max(len(lines), 1), len(set(SPACE_WORD.findall(t or "")))
        failed.append(n < 50 or 100 * rep > 50 * n)
        bad_high = lambda x, bad, good=None: -1 if x > bad else 1 if good is not None and x <= good else 0
        bad_low = lambda x, bad, good=None: -1 if x < bad else 1 if good is not None and x >= good else 0
        votes.append([bad_low(n, 50, 80), bad_high(symbols / w, 0.2, 0.02), bad_high(symbols / c, 0.03), bad_high(symbols / rows, 2.0), bad_high(rep / w, 0.4, 0.15), bad_high(dup / rows, 0.3), bad_low(kinds / math.sqrt(w), 3.0, 5.0), bad_high(chars / w, 12.0), bad_low(chars / w, 2.5), bad_low(w / rows, 1.5)])
    prior, rates = 0.8, [{-1: (0.4, 0.1), 0: (0.5, 0.5), 1: (0.1, 0.4)} for _ in range(10)]

    def chance(v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(r[x][1] / r[x][0]) for r, x in zip(rates, v, strict=True) if x)
        return 1 / (1 + math.exp(-odds))

    for _ in range(steps):
        good = [chance(v) for v in votes]
        prior = min(0.98, max(0.5, (sum(good) + 8) / (len(votes) + 10)))
        for k in range(10):
            share = {}
            for side, first in ((0, {-1: 4, 0: 5, 1: 1}), (1, {-1: 1, 0: 5, 1: 4})):
                mass = {x: first[x] + sum(g if side else 1 - g for g, v in zip(good, votes, strict=True) if v[k] == x) for x in (-1, 0, 1)}
                share[side] = {x: m / sum(mass.values()) for x, m in mass.items()}
            b, g = share[0], share[1]
            rates[k] = {-1: (max(b[-1], 1.5 * g[-1]), g[-1]), 0: (b[0], g[0]), 1: (min(b[1], g[1] / 1.5), g[1])}
    return [not f and chance(v) >= threshold for f, v in zip(failed, votes, strict=True)]
