"""Deterministic respelling of known words, as a pass over a text's words.

Each rule is one whole word, so a pass over words is the same as rules in turn over the text, but that a rule's outcome
may be the word of a later rule; those chains are followed. A draw is taken from sha256 of seed, rule and the
word's place in the text, so it doesn't depend on partitions, nor on what comes after the word.
"""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

from . import rules as R
from .text import let, word_rule

ALL_RULES = [*R.VARIANTS, *((w, [to], R.FINAL_DROP_REASON) for w, to in R.FINAL_DROPS)]


def check_rate(rate: float) -> None:
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"rate must be within 0 and 1: {rate}")


def match_case(original: Column, new: Column) -> Column:
    """Like the original: all capitals (of more than one), a capital first, or as it is."""
    capital = F.substring(original, 1, 1)
    cased = F.upper(capital) != F.lower(capital)
    return (
        F.when((original == F.upper(original)) & (F.upper(original) != F.lower(original)) & (F.length(original) > 1), F.upper(new))
        .when(cased & (capital == F.upper(capital)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new))))
        .otherwise(new)
    )


#: Any word that a rule knows.
KNOWN = word_rule("|".join(w for w, _, _ in ALL_RULES))
#: A text up to the end of the last such word: what comes after it is left as it is.
UP_TO_KNOWN = f"(?s)^.*{KNOWN}"


def _draw(seed: Column, rule: Column, place: Column, what: str) -> Column:
    """A number from 0 to 1 for a rule at a word's place."""
    h = F.sha2(F.concat_ws(":", seed.cast("string"), rule.cast("string"), F.lit(what), place.cast("string")), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def perturb_text(text: Column, seed: Column, rate: float = R.RATE) -> Column:
    """Struct of text and subs: array of (original, replacement, reason), one for each replaced word.

    Words after the last one that a rule knows cost nothing, others one lookup. Rate 0 changes nothing, 1 replaces each match.
    Null stays null.
    """
    check_rate(rate)
    edge = rf"(?<={R.WORD})(?!{R.WORD})|(?<!{R.WORD})(?={R.WORD})"
    rules = F.create_map(*(x for k, (w, to, why) in enumerate(ALL_RULES) for x in (F.lit(w), F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, to)).alias("to"), F.lit(why).alias("why")))))
    no_subs = F.array().cast("array<struct<original:string,replacement:string,reason:string>>")

    plain = lambda w: F.struct(w.alias("word"), no_subs.alias("subs"))

    def once(state: Column, rule: Column, place: Column) -> Column:
        """A word with its replacements so far, after one rule."""
        w, subs = state["word"], state["subs"]
        pick = F.element_at(rule["to"], F.floor(_draw(seed, rule["k"], place, "choice") * F.size(rule["to"])).cast("int") + 1)
        new = let(match_case(w, pick), lambda to: F.struct(to.alias("word"), F.concat(subs, F.array(F.struct(w.alias("original"), to.alias("replacement"), rule["why"].alias("reason")))).alias("subs")))
        return F.when(_draw(seed, rule["k"], place, "apply") < rate, new).otherwise(state)

    def apply(word: Column, place: Column, rule: Column) -> Column:
        """The word after its rule and, if that made the word of a later rule, after that rule too."""

        def chain(one: Column) -> Column:
            later = F.try_element_at(rules, F.lower(one["word"]))
            return let(later, lambda r: F.when((F.size(one["subs"]) > 0) & (r["k"] > rule["k"]), once(one, r, place)).otherwise(one))

        return let(once(plain(word), rule, place), chain)

    names = [w for w, _, _ in ALL_RULES]
    respelt = lambda w, i: F.when(F.lower(w).isin(names), let(F.try_element_at(rules, F.lower(w)), lambda rule: apply(w, i, rule))).otherwise(plain(w))
    made = lambda words, rest: F.struct(F.concat(F.array_join(F.transform(words, lambda x: x["word"]), ""), rest).alias("text"), F.flatten(F.transform(words, lambda x: x["subs"])).alias("subs"))
    return let(F.regexp_extract(text, UP_TO_KNOWN, 0), lambda head: let(F.transform(F.split(head, edge), respelt), lambda words: made(words, _after(text, head))))


def _after(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def perturb_text_exact(text: Column, seed: Column, rate: float = R.RATE) -> Column:
    """The same rules with draws of a seeded Mersenne Twister, rule by rule over the text: for parity with that generator.

    Its outputs differ from perturb_text()'s. Same struct. Only the rules of words that are there are tried, and only up to the
    last of these words.
    """
    check_rate(rate)
    rules = [(re.compile(rf"\b{w}\b", re.IGNORECASE), to, why, len(to) > 1 or why != R.FINAL_DROP_REASON) for w, to, why in ALL_RULES]
    pieces, names = re.compile(r"\w+|\W+"), {w: k for k, (w, _, _) in enumerate(ALL_RULES)}
    # letters that a caseless pattern takes for i, s and k; without them lower() keeps the length
    fold = str.maketrans("\u0131\u0130\u017f\u212a", "iisk")
    # the later rules that know what a rule makes
    leads = [{j for j, (w, _, _) in enumerate(ALL_RULES) if j > k and w in to} for k, (_, to, _, _) in enumerate(rules)]

    def like(old: str, new: str) -> str:
        if old.isupper() and len(old) > 1:
            return new.upper()
        return new[0].upper() + new[1:] if old[0].isupper() else new

    @pandas_udf("struct<text:string,subs:array<struct<original:string,replacement:string,reason:string>>>")
    def run(texts: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        out = []
        for body, s in zip(texts, seeds, strict=True):
            low = pieces.findall((body if body.isascii() else body.translate(fold)).lower()) if body else []
            found = {names[w] for w in names.keys() & set(low)}
            draws, subs = random.Random(int(s)) if found else None, []
            if found:
                last = next(n for n in range(len(low), 0, -1) if low[n - 1] in names)
                end = sum(map(len, low[:last]))
                body, rest = body[:end], body[end:]
            for k, (pattern, to, why, chooses) in enumerate(rules):
                if k not in found:
                    continue

                def put(m, to=to, why=why, chooses=chooses, draws=draws, subs=subs):
                    if draws.random() > rate:
                        return m[0]
                    new = like(m[0], draws.choice(to) if chooses else to[0])
                    subs.append({"original": m[0], "replacement": new, "reason": why})
                    return new

                body = pattern.sub(put, body)
                found |= leads[k]
            out.append((body + rest if found else body, subs))
        return pd.DataFrame(out, columns=["text", "subs"])

    return run(text, seed)
