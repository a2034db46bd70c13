"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols: insult, violence, intent, target, negation, reporting, other. Five transducers, whose arcs carry
factors, read a clause in turn. The insult transducer joins insults that follow each other closely; the threat transducer
makes a threat of intent and violence that follows it, in a few words, and lets violence alone count little; a target near
by strengthens what attacks; negation and reporting weaken what is in their scope. They are composed into one machine,
whose states are made as they are met. Only clauses in which a pattern matches are read; a text's score joins those of its
clauses.

The insult patterns, whole words and word beginnings, and their weights are learned from labelled texts, and so is what
threats add to the score; the closed classes of the grammar (targets, negations, reporting, violence, intent) are fixed.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, sampled, staged
from .near_dedup import minhashes, shingles
from .textbytes import Words, slices

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Closed classes in the four languages of the labelled texts.
TARGETS = frozenset("you your yours yourself he him his she her they them their these those people vous tu toi te tes ihr du dich dein euch usted tú ti te vosotros ellos".split())
NEGATIONS = frozenset("not no never neither nor without isn aren wasn weren don doesn didn cannot won nicht kein keine nie pas jamais sin nunca".split())
REPORTS = frozenset("said says say told wrote writes quoted quote quoting called reported claims claimed alleged according sagte schrieb dit écrit dijo escribió".split())
VIOLENCE = frozenset(
    "kill kills killing hurt hurts hurting destroy destroys destroying murder murders murdering stab stabs stabbing strangle strangles strangling shoot shooting burn burning "
    "töte töten umbringen schlagen vernichten erwürgen erschießen tuer tuerai frapper détruire étrangler brûler matar mataré golpear destruir estrangular quemar".split()
)
INTENTS = frozenset("will shall going gonna ll want wants must should werde werden will muss sollte vais va veux dois voy vas quiero debo".split())
OTHER, INSULT, VIOLENT, INTENT, TARGET, NEGATION, REPORT, THREAT = ".ivmynrt"
#: What can attack after the grammar.
ATTACKS = (INSULT, THREAT, VIOLENT)

CLOSED = {w: x for x, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (INTENT, INTENTS), (VIOLENT, VIOLENCE)) for w in words}

#: Letters of the word beginnings that are learned; longer words are told by these and as whole words.
BEGINNINGS = range(3, 13)


@dataclass
class Transducer:
    """Reads a symbol in a state, gives the next state, a symbol and the factor of the arc."""

    start: int
    step: Callable[[int, str], tuple[int, str, float]]

    def then(self, other: Transducer) -> Transducer:
        """Their composition: what this one writes, the other reads; factors multiply. States are numbered as they are met."""
        numbers: dict[tuple[int, int], int] = {(self.start, other.start): 0}
        pairs = [(self.start, other.start)]
        seen: dict[tuple[int, str], tuple[int, str, float]] = {}

        def step(state: int, symbol: str) -> tuple[int, str, float]:
            if (state, symbol) not in seen:
                a, b = pairs[state]
                a, middle, f = self.step(a, symbol)
                b, out, g = other.step(b, middle)
                if (a, b) not in numbers:
                    numbers[a, b] = len(pairs)
                    pairs.append((a, b))
                seen[state, symbol] = numbers[a, b], out, f * g
            return seen[state, symbol]

        return Transducer(0, step)


def _insult(scope: int = 3) -> Transducer:
    """An insult within `scope` words after another is part of one phrase with it, and weighs more."""
    return Transducer(0, lambda s, x: (scope, x, 1.25 if s else 1.0) if x == INSULT else (max(0, s - 1), x, 1.0))


def _threat(scope: int = 5) -> Transducer:
    """Violence within `scope` words after an intent is a threat; without one it weighs little."""

    def step(s: int, x: str) -> tuple[int, str, float]:
        if x == INTENT:
            return scope, x, 1.0
        if x == VIOLENT:
            return max(0, s - 1), THREAT if s else x, 1.0 if s else 0.25
        return max(0, s - 1), x, 1.0

    return Transducer(0, step)


def _target(scope: int = 6) -> Transducer:
    """Strengthens what stands within `scope` words after somebody is named."""
    return Transducer(0, lambda s, x: (scope, x, 1.0) if x == TARGET else (max(0, s - 1), x, 1.25 if s and x in ATTACKS else 1.0))


def _negation(scope: int = 4) -> Transducer:
    """Weakens what attacks within `scope` words after a negation."""
    return Transducer(0, lambda s, x: (scope, x, 1.0) if x == NEGATION else (max(0, s - 1), x, 0.25 if s and x in ATTACKS else 1.0))


def _reporting() -> Transducer:
    """Weakens what follows a reporting verb in its clause."""
    return Transducer(0, lambda s, x: (1, x, 1.0) if x == REPORT else (s, x, 0.25 if s and x in ATTACKS else 1.0))


def grammar() -> Transducer:
    return _insult().then(_threat()).then(_target()).then(_negation()).then(_reporting())


#: What the evidence of a text is; the first says whether anything matches.
EVIDENCE = ("match", "strongest clause", "log of the clauses' sum", "log of clauses with an unweakened attack", "log of threats")


@dataclass
class ToxicityModel:
    """Learned insult patterns (`=word`, `^beginning`, `+beginning` with more letters after it) with weights, the weight of a threat before learning, and how EVIDENCE gives a score."""

    patterns: dict[str, float] = field(default_factory=dict)
    threat: float = 4.0
    coefficients: list[float] = field(default_factory=lambda: [-2.5, 0.8, 0.2, 0.0, 0.0])
    base: float = 0.03

    def score(self, evidence: list[float]) -> float:
        if not evidence[0]:
            return self.base
        z = self.coefficients[0] + sum(w * x for w, x in zip(self.coefficients[1:], evidence[1:], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __post_init__(self):
        self.name = uuid.uuid4().hex
        self.words = {p[1:]: w for p, w in self.patterns.items() if p[0] == "="}
        self.beginnings = {p[1:]: w for p, w in self.patterns.items() if p[0] == "^"}
        self.stems = {p[1:]: w for p, w in self.patterns.items() if p[0] == "+"}
        self.lengths = sorted({len(p) for p in [*self.beginnings, *self.stems]})

    def weight(self, word: str) -> float:
        """The weight of the strongest insult pattern that a lower-case word matches."""
        found = self.words.get(word, 0.0)
        for k in self.lengths:
            if len(word) >= k:
                found = max(found, self.beginnings.get(word[:k], 0.0), self.stems.get(word[:k], 0.0) if len(word) > k else 0.0)
        return found

    def symbol(self, word: str) -> tuple[str, float]:
        if (w := self.weight(word)) > 0:
            return INSULT, w
        return (CLOSED[word], self.threat if word in VIOLENCE else 0.0) if word in CLOSED else (OTHER, 0.0)


class Seen:
    """The words a worker has met: all, the ones that aren't plain with symbol and weight, and those that attack."""

    def __init__(self):
        self.all: set[str] = set()
        self.special: dict[str, tuple[str, float]] = {}
        self.attacks: set[str] = set()

    def learn(self, words: set[str], model: ToxicityModel) -> None:
        if len(self.all) > 400_000:
            self.all = set()
        for w in words - self.all:
            symbol, weight = model.symbol(w)
            if symbol != OTHER:
                self.special[w] = symbol, weight
                if symbol in (INSULT, VIOLENT):
                    self.attacks.add(w)
        self.all |= words


_seen: dict[str, Seen] = {}


def features(words: set[str]) -> set[str]:
    """Patterns that the distinct lower-case words of a text match."""
    out = {"=" + w for w in words}
    for k in BEGINNINGS:
        words = [w for w in words if len(w) >= k]
        out.update("^" + w[:k] for w in words)
        out.update("+" + w[:k] for w in words if len(w) > k)
    return out


def _count(wanted: frozenset[str] | None):
    """(text) rows -> partial counts for each pattern: texts with it, and pairs of such a text and a word of its; only of the wanted ones if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: Counter = Counter()
        pairs: Counter = Counter()
        of: dict[str, list[str]] = {}
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                own: Counter = Counter()
                for w in set(WORD.findall((text or "").lower())):
                    if (found := of.get(w)) is None:
                        found = of[w] = sorted(features({w}) if wanted is None else features({w}) & wanted)
                    own.update(found)
                texts.update(own.keys())
                pairs.update(own)
            if len(texts) > 500_000 or len(of) > 200_000:
                yield _partial(texts, pairs)
                texts, pairs, of = Counter(), Counter(), {}
        yield _partial(texts, pairs)

    return run


def _partial(texts: Counter, pairs: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"pattern": pa.array(list(texts), pa.string()), "n": pa.array(list(texts.values()), pa.int64()), "pairs": pa.array([pairs[p] for p in texts], pa.int64())})


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two MinHash values of each text's 4-word shingles: copies and near copies mostly share one."""
    for b in slices(batches, "text"):
        g, first = shingles(Words(b.column(1), lower=True), 4)
        some = np.diff(first) > 0
        keys = np.zeros((2, b.num_rows), np.uint64)
        keys[:, some] = minhashes(g, first, 2).T
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "k0": pa.array(keys[0].view(np.int64)), "k1": pa.array(keys[1].view(np.int64))})


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int = 20_000, least: float = 30.0) -> ToxicityModel:
    """Learn patterns from labelled rows that are not held out.

    The fit is on a bounded sample, whole texts: labelled rows in the order of a hash of their id, about max_fit_docs of
    them. A pattern stays if it stands in toxic texts far more often than in others (likelihood ratio of `least` or
    more); beginnings that say as much replace the words they cover. Only patterns of so many toxic texts that they can
    reach `least` come to the driver. Rows of null text, and of a null label or id, teach nothing; an id that is labelled
    twice is toxic if one label says so; of texts that repeat or nearly repeat each other one counts; other columns are
    ignored. Without a row of each label nothing is learned.
    """
    rows = labels.where("toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = sampled(rows, max_fit_docs, "doc_id")
    # about max_fit_docs rows, whatever the input
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(rows), "doc_id")
    # copies of one text would count as many witnesses: one of them stays
    keys = staged(texts.select("doc_id", "text").mapInArrow(_keys, "doc_id bigint, k0 bigint, k1 bigint"), "keys")
    for k in ("k0", "k1"):
        keys = keys.join(keys.groupBy(k).agg(F.min("doc_id").alias("doc_id")).hint("merge"), [k, "doc_id"], "left_semi")
    rows = staged(rows.join(keys.select("doc_id").hint("merge"), "doc_id", "left_semi"), "fitted")
    texts = texts.drop("toxic").join(F.broadcast(rows), "doc_id")
    sizes = {x["toxic"]: x["n"] for x in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel()
    schema = "pattern string, n bigint, pairs bigint"
    # no pattern of fewer toxic texts reaches the ratio, even if it stands in no other text
    enough = max(5, math.ceil(least / (2 * math.log((n1 + n0) / n1))))
    counted = lambda label, wanted: texts.where(F.col("toxic") == label).select("text").mapInArrow(_count(wanted), schema).groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"))
    pos = {x["pattern"]: (x["n"], x["pairs"]) for x in counted(1, None).where(F.col("n") >= enough).collect()}
    neg = {x["pattern"]: (x["n"], x["pairs"]) for x in counted(0, frozenset(pos)).collect()}
    model = ToxicityModel(select_patterns(pos, neg, n1, n0, least))
    # about max_fit_docs rows of EVIDENCE numbers
    known = texts.select("doc_id", "text").mapInArrow(_score(model), SCORED).join(F.broadcast(rows), "doc_id").select("toxic", "evidence").collect()
    return calibrate(model, np.array([x["evidence"] for x in known]), np.array([x["toxic"] for x in known]))


def select_patterns(pos: dict[str, tuple[int, int]], neg: dict[str, tuple[int, int]], n1: int, n0: int, least: float) -> dict[str, float]:
    """Patterns that stand in toxic texts far more often than in others, with log ratios. Counts are of texts, and of texts' words.

    A beginning must do so without the words that longer patterns explain better; what a chosen beginning explains as well goes.
    """

    def measure(a: float, b: float) -> tuple[float, float]:
        rate = (a + b) / (n1 + n0)
        ratio = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        return ratio, 2 * sum(o * math.log(o / e) for o, e in ((a, rate * n1), (b, rate * n0)) if o > 0)

    chosen: dict[str, tuple[float, int, int]] = {}
    stems: list[tuple[str, str]] = []  # of the chosen patterns, sorted: those that begin alike are neighbours
    # whole words, then beginnings from long to short, of one stem the narrower first
    for p in sorted(pos, key=lambda p: (p[0] != "=", -len(p), p[0] == "^", p)):
        (a, words1), (b, words0) = pos[p], neg.get(p, (0, 0))
        ratio, g = measure(a, b)
        if ratio <= 2 or g < least:
            continue
        stem = p[1:]
        if p[0] != "=":
            covered = [kind + q for q, kind in stems[bisect_left(stems, (stem, "")) : bisect_left(stems, (stem + "\U0010ffff", ""))] if p[0] == "^" or len(q) > len(stem)]
            better = [q for q in covered if chosen[q][0] > ratio + 1]
            # a word counts with the shortest of them
            outer = [q for q in better if not any(r != q and r[0] != "=" and q[1:].startswith(r[1:]) and (r[0] == "^" or len(q) > len(r)) for r in better)]
            rest, rest_g = measure(max(0, words1 - sum(chosen[q][1] for q in outer)), max(0, words0 - sum(chosen[q][2] for q in outer)))
            if better and (rest <= 2 or rest_g < least):
                continue
            ratio = min(ratio, rest) if better else ratio
            for q in covered:
                if q not in better:
                    del chosen[q]
                    stems.remove((q[1:], q[0]))
        chosen[p] = ratio, words1, words0
        insort(stems, (stem, p[0]))
    return {p: x[0] for p, x in chosen.items()}


def calibrate(model: ToxicityModel, x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0) -> ToxicityModel:
    """Logistic regression of the labels on the evidence of texts with a match, by Newton steps; the others get their own rate."""
    hit = x[:, 0] > 0 if len(x) else np.zeros(0, bool)
    model.base = float((y[~hit].sum() + 0.5) / (np.count_nonzero(~hit) + 5))
    a, t = np.column_stack([np.ones(hit.sum()), x[hit][:, 1:]]) if hit.any() else np.zeros((0, len(EVIDENCE))), y[hit]
    if not 5 <= t.sum() <= len(t) - 5:
        return model
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (t - p) - ridge * w)
    model.coefficients = [float(v) for v in w]
    return model


SCORED = "doc_id bigint, score double, evidence array<double>, clauses array<struct<begin:int,end:int,weight:double>>"


def _score(model: ToxicityModel):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        if model.name not in _seen:
            _seen.clear()
            _seen[model.name] = Seen()
        seen, plain = _seen[model.name], (OTHER, 0.0)
        for b in slices(batches):
            scores, evidence, found = [], [], []
            for text in b.column(1).to_pylist():
                lower = (text or "").lower()
                words = set(WORD.findall(lower))
                seen.learn(words, model)
                hits = words & seen.attacks
                clauses, strong, threats = [], 0, 0
                if hits:
                    begin = 0
                    for stop in [*CLAUSE.finditer(lower), None]:
                        end = stop.start() if stop else len(lower)
                        own = WORD.findall(lower, begin, end)
                        if not hits.isdisjoint(own):
                            state, total, attacked = machine.start, 0.0, False
                            for w in own:
                                symbol, weight = seen.special.get(w, plain)
                                state, out, factor = machine.step(state, symbol)
                                if weight:
                                    total += weight * factor
                                    if factor >= 1:
                                        attacked = True
                                        threats += out == THREAT
                            strong += attacked
                            clauses.append({"begin": begin, "end": end, "weight": total})
                        begin = stop.end() if stop else end
                weights = [c["weight"] for c in clauses]
                evidence.append([1.0, max(weights), math.log1p(sum(weights)), math.log1p(strong), math.log1p(threats)] if weights else [0.0] * len(EVIDENCE))
                scores.append(model.score(evidence[-1]))
                found.append(clauses)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(scores, pa.float64()), "evidence": pa.array(evidence, pa.list_(pa.float64())), "clauses": pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])))})

    return run


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, text -> doc_id, score (0 to 1), evidence, clauses (ranges of the lower-cased text that matched): a row for each row.

    Only texts are read. Null and empty texts get the score of a text without a match. Null and repeated ids are rows
    like others; texts are whole, of any length; an empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), SCORED)
