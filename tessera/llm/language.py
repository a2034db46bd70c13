"""Language of each word span: script ranges narrow the candidates, Viterbi picks among them.

A word's score in a language is the sum of log probabilities of its letter trigrams, learned from labelled texts. Viterbi
over a text's words, with a penalty for each switch, labels spans; a text's language is that of most of its letters.
A run of over PIECE letters (scripts without spaces, glued text) is labelled in pieces; all of its trigrams count, once each.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import carrying, held_out, own_fields, sampled, with_text
from .textbytes import slices

UNKNOWN = "und"


def _ranges(characters: str) -> str:
    """A character class body for sorted characters."""
    ends = [x for a, b in zip("\0" + characters, characters, strict=False) if ord(b) != ord(a) + 1 for x in (a, b)][1:] + [characters[-1]]
    return "".join(f"{a}-{b}" for a, b in zip(ends[::2], ends[1::2], strict=True))


#: Letters and nothing else: what a pattern takes for a part of a word less digits, other numbers (like one half) and the underscore.
WORD = re.compile(rf"[^\W\d_{_ranges(''.join(c for c in re.findall(r'[^\W\d_]', ''.join(map(chr, range(0x80, 0x20000)))) if not c.isalpha()))}]+")
#: Letters up to which a run is one word of the Viterbi pass.
PIECE = 40
#: The score of a language that isn't a candidate for a word's script.
NEVER = -1e6
#: Begins the key of a piece, which is lower-cased and has the letter, or space, before and after it.
PART = "\0"
#: First code points of script ranges and their scripts; fixed values from the Unicode block table.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_FIRST = np.array([x for x, _ in SCRIPTS])


def script(word: str) -> str:
    """The script of a word's first letter."""
    at = int(np.searchsorted(_FIRST, ord(word[0]), "right")) - 1
    return SCRIPTS[at][1] if at >= 0 else "other"


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[j : j + 3] for j in range(len(w) - 2)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> partial trigram counts: words are counted first, so that a frequent word is taken apart once."""
    words: dict[str, Counter] = {}

    def done() -> pa.RecordBatch:
        total: Counter = Counter()
        for lang, counts in words.items():
            grams: Counter = Counter()
            for w, n in counts.items():
                grams[f"#{script(w)}"] += n
                for g in trigrams(w):
                    grams[g] += n
            total.update({(lang, g): n for g, n in grams.items()})
        words.clear()
        return _table(total)

    for b in slices(batches):
        for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        if sum(map(len, words.values())) > 500_000:
            yield done()
    yield done()


def _table(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in total], pa.string()), "gram": pa.array([k[1] for k in total], pa.string()), "n": pa.array(list(total.values()), pa.int64())})


def pieces(word: str) -> list[str]:
    """Keys of a long run's pieces of PIECE letters. Each trigram of the run stands in one key."""
    low = word.lower()
    at = range(len(word) + 1) if len(low) == len(word) else list(accumulate((len(c.lower()) for c in word), initial=0))
    w = f" {low} "
    return [PART + w[at[a] : at[min(a + PIECE, len(word))] + 2] for a in range(0, len(word), PIECE)]


def units(text: str) -> tuple[list[str], list[int]]:
    """A text's words, long runs as their pieces, and the letters of each."""
    words = WORD.findall(text)
    letters = list(map(len, words))
    if max(letters, default=0) <= PIECE:
        return words, letters
    parts = [pieces(w) if n > PIECE else [w] for w, n in zip(words, letters, strict=True)]
    return [x for p in parts for x in p], [min(PIECE, n - a) for n in letters for a in range(0, n, PIECE)]


class LanguageModel:
    """Trigram log probabilities of each learned language and the scripts it is written in. Small: see fit()."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({x[0] for x in counts})
        at = {x: j for j, x in enumerate(self.languages)}
        k = len(self.languages)
        self.scripts: dict[str, np.ndarray] = {}
        total, letters = np.zeros(k), np.zeros(k)
        self.grams: dict[str, np.ndarray] = {}
        for lang, gram, n in counts:
            part = self.scripts if gram[0] == "#" and len(gram) > 3 else self.grams
            part.setdefault(gram, np.zeros(k))[at[lang]] += n
            (letters if part is self.scripts else total)[at[lang]] += n
        # a script is a language's own if a hundredth of its words are in it
        self.scripts = {s[1:]: x >= 0.01 * np.maximum(letters, 1) for s, x in self.scripts.items()}
        floor = np.log(0.5 / (total + 0.5 * (len(self.grams) + 1))) if k else np.zeros(0)
        self.rows = np.stack([np.log((x + 0.5) / (total + 0.5 * (len(self.grams) + 1))) for x in self.grams.values()] + [floor]).astype(np.float32) if k else np.zeros((1, 0), np.float32)
        self.grams = {g: j for j, g in enumerate(self.grams)}
        #: A script that every language uses, if there is one: it leaves all of them candidates.
        self.plain = next((name for name, own in self.scripts.items() if own.all()), "")
        self.name = uuid.uuid4().hex

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, or piece, in each language; the same for all if no candidate has its script."""
        get, last = self.grams.get, len(self.grams)
        flat, first = [], np.zeros(len(words), np.int64)
        for j, w in enumerate(words):
            first[j] = len(flat)
            w = w[1:] if w[0] == PART else f" {w.lower()} "
            flat += [get(w[i : i + 3], last) for i in range(len(w) - 2)]
        s = np.add.reduceat(self.rows[np.array(flat, np.int64)], first) if words else np.zeros((0, len(self.languages)), np.float32)
        for j, w in enumerate(words):
            w = w[2:] if w[0] == PART else w
            if (name := "latin" if w[0] < "\u0250" else script(w)) != self.plain:
                own = self.scripts.get(name)
                s[j] = 0 if own is None or not own.any() else np.where(own, s[j], NEVER)
        return s


_known: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language number of each word. scores: words x languages; first: each text's first word, and the total.

    All texts advance together, longest first, so that a step is a few numpy calls for all that still have words.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    kind = np.min_scalar_type(-max(1, scores.shape[1]))
    back = np.zeros(scores.shape, kind)
    state = np.zeros((len(order), scores.shape[1]), np.float32)
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    stay = np.arange(scores.shape[1], dtype=kind)[None, :]
    for t, n in enumerate(active):
        s = state[:n]
        if t:
            best = s.argmax(axis=1)
            other = np.take_along_axis(s, best[:, None], 1) - np.float32(penalty)
            back[begin[:n] + t] = np.where(s >= other, stay, best[:, None])
            s = np.maximum(s, other)
        state[:n] = s + scores[begin[:n] + t]
    out = np.zeros(len(scores), kind)
    now = state.argmax(axis=1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        out[begin[:n] + t] = now[:n]
        if t:
            now[:n] = back[begin[:n] + t, now[:n]]
    return out


def fit(docs: DataFrame, max_fit_docs: int = 20_000, max_grams: int = 50_000) -> LanguageModel:
    """Learn from the labelled rows that are not held out.

    The fit is on a bounded sample: rows in the order of a hash of their id, about max_fit_docs of them, whole texts.
    The model keeps the max_grams most frequent trigrams of each language, so its size has a bound. Rows of null text,
    language or id teach nothing, repeated rows count each, other columns are ignored; from an empty table a model comes
    that knows no language.
    """
    rows = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    rows = sampled(rows, max_fit_docs, "doc_id")
    counts = rows.select("text", "lang").mapInArrow(_counts, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= max_grams)
    return LanguageModel([tuple(x) for x in ranked.select("lang", "gram", "n").collect()])


#: Words that a worker keeps with their row in the score table, which is emptied when it has grown larger; those of one slice stay, if they are more.
MOST_WORDS = 60_000


def _label(model: LanguageModel, penalty: float, with_spans: bool, most: int = MOST_WORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        # kept for the worker's later tasks
        known, table = _known.get(model.name, ({}, np.zeros((1024, k), np.float32)))
        for b in slices(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            cut = [units(x) for x in texts]
            found = [x for x, _ in cut]
            new = {w for x in found for w in x} - known.keys()
            if len(known) + len(new) > most:
                known, table, new = {}, np.zeros((1024, k), np.float32), {w for x in found for w in x}
            if k and len(known) + len(new) > len(table):
                table = np.resize(table, (2 * (len(known) + len(new)), k))
            if k:
                table[len(known) : len(known) + len(new)] = model.scores(fresh := list(new))
                known.update(zip(fresh, range(len(known), len(known) + len(new)), strict=True))
                _known.clear()
                _known[model.name] = known, table
            first = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
            flat = [w for x in found for w in x]
            at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat)) if k else np.zeros(len(flat), np.int64)
            letters = np.fromiter((n for _, x in cut for n in x), np.int64, len(flat))
            best = viterbi(table[at], first, penalty) if k else np.zeros(len(flat), np.int8)
            text = np.repeat(np.arange(len(found)), np.diff(first))
            share = np.zeros((len(found), max(k, 1)))
            np.add.at(share, (text, best), letters)
            total = share.sum(axis=1)
            top = share.argmax(axis=1)
            none = (total == 0) | (k == 0)
            langs = [UNKNOWN if none[j] else model.languages[top[j]] for j in range(len(found))]
            score = np.where(none, 0.0, share.max(axis=1) / np.maximum(total, 1))
            cols = {"carried": b.column(2), "text": b.column(1)} if b.num_columns > 2 else {}
            cols |= {"doc_id": b.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score)}
            if with_spans:
                cols["spans"] = pa.array([_spans(x, cut[j][1], best[first[j] : first[j + 1]], model.languages) for j, x in enumerate(texts)], _SPANS)
            yield pa.RecordBatch.from_pydict(cols)

    return run


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _spans(text: str, letters: list[int], best: np.ndarray, languages: list[str]) -> list[dict]:
    """Ranges of code points from the first to the last word, or piece, of each run of one language."""
    out: list[dict] = []
    begin = (a for m in WORD.finditer(text) for a in range(m.start(), m.end(), PIECE))
    for a, n, k in zip(begin, letters, best, strict=True):
        if out and out[-1]["lang"] == languages[k]:
            out[-1]["end"] = a + n
        elif languages:
            out.append({"begin": a, "end": a + n, "lang": languages[k]})
    return out


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 8.0, with_spans: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score (share of the letters), spans, and a struct of the columns in carry: one row for each row.

    Only texts are read. A null text, and one without a letter, is `und` with score 0, and so is any if the model knows
    no language; words in a script of no learned language follow their neighbours. Texts are whole, of any length,
    and so are words: a run of over PIECE letters may hold spans of several languages. Null and repeated ids are rows
    like others; other columns are ignored unless carried; an empty table gives an empty table.
    """
    ddl = "text string, " * bool(carry) + "doc_id bigint, lang_pred string, score double" + ", spans array<struct<begin:int,end:int,lang:string>>" * with_spans
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *([own_fields(docs, carry).alias("carried")] if carry else []))
    out = rows.mapInArrow(_label(model, penalty, with_spans), carrying(rows.schema["carried"].dataType if carry else None, ddl))
    return out.withColumn("carried", with_text(docs, carry)).drop("text") if carry else out
