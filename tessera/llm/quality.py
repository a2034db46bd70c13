"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measure of a text and votes good, bad, or not at all. Its accuracy isn't set by hand: votes of
all documents are counted by pattern (a table bounded by the number of rules, not by the input), and EM over the counts
estimates each rule's vote rates in good and bad texts. A text's posterior quality then takes the place of passing all
rules. Measures are DataFrame expressions; only the pattern counts come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Places of a text's word windows share a 64-bit number with a part of the window's hash; more words take the slower way.
PLACE_BITS = 20


def _with_repeats(x: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with words w and their number n: words in 3-word windows found twice or more in w.

    Window hashes are sorted beside their places; of windows with equal hashes, mostly few, the words themselves are sorted,
    and neighbours with equal words are repeats. Each array is a column of its own, so that it is made once and not for each
    element. In texts of up to 2**20 words hash and place share one number (44 bits of hash), in longer ones they are a pair.
    """
    mask = (1 << PLACE_BITS) - 1
    w, n = F.col("w"), F.col("n")
    key = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
    place = lambda z: z.bitwiseAND(F.lit(mask)).cast("int")
    few = (n >= 3) & (n <= mask)
    x = x.withColumn("keys", F.when(few, F.transform(F.sequence(F.lit(0), n - 3), lambda i: key(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))))
    x = x.withColumn("keys", F.sort_array("keys"))
    x = x.withColumn("pairs", F.when(n > mask, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(key(i).alias("h"), i.alias("i"))))))

    def beside(name: str, same: Callable[[Column, Column], Column]) -> Column:
        """Elements of a sorted array that are the same as the one before or after."""
        like = lambda z, j: F.coalesce(same(z, F.get(name, j)), F.lit(False))
        return F.filter(name, lambda z, j: like(z, j - 1) | like(z, j + 1))

    short = F.transform(beside("keys", lambda a, b: F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0), place)
    long_ = F.transform(beside("pairs", lambda a, b: a["h"] == b["h"]), lambda z: z["i"])
    x = x.withColumn("maybe", F.coalesce(short, long_, F.array().cast("array<int>")))
    x = x.withColumn("windows", F.sort_array(F.transform("maybe", lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i")))))
    equal = lambda a, b: (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
    x = x.withColumn("starts", F.sort_array(F.transform(beside("windows", equal), lambda z: z["i"])))
    begin = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", begin, lambda a, s: F.struct(s.alias("at"), (a["n"] + F.least(F.lit(3), s - a["at"])).alias("n")))["n"]
    return x.withColumn("n_repeat_words", covered.cast("bigint")).drop("keys", "pairs", "maybe", "windows", "starts")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id and the base counts, with some further measures for the rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    x = x.select("doc_id", "text", F.array_remove(F.split("text", BLANK), "").alias("w"), F.split("text", "\n").alias("all_lines"))
    lines = F.filter("all_lines", lambda s: F.length(F.translate(s, BLANKS, "")) > 0)
    x = x.select("doc_id", "text", "w", lines.alias("lines"), F.size("w").alias("n"))
    distinct = F.size(F.array_distinct("w"))
    return _with_repeats(x).select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("bigint").alias("n_lines"),
        distinct.cast("bigint").alias("n_distinct"),
    )


@dataclass(frozen=True)
class Rule:
    """A measure that votes bad beyond `bad`, good on the other side of `good` if that is given, and else abstains."""

    name: str
    value: Column
    bad: float
    good: float | None = None
    high_is_bad: bool = True

    def vote(self) -> Column:
        bad = self.value > self.bad if self.high_is_bad else self.value < self.bad
        votes = F.when(bad, -1)
        if self.good is not None:
            votes = votes.when(self.value <= self.good if self.high_is_bad else self.value >= self.good, 1)
        return votes.otherwise(0)


def rules() -> list[Rule]:
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    return [
        Rule("few_words", c("n_words").cast("double"), 50, 80, high_is_bad=False),
        Rule("symbols_per_word", c("n_symbols") / n, 0.2, 0.02),
        Rule("symbols_per_character", c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)), 0.03),
        Rule("symbols_per_line", c("n_symbols") / lines, 2.0),
        Rule("repeats", c("n_repeat_words") / n, 0.4, 0.15),
        Rule("duplicate_lines", c("n_dup_lines") / lines, 0.3),
        Rule("distinct_words", c("n_distinct") / F.sqrt(n.cast("double")), 3.0, 5.0, high_is_bad=False),
        Rule("long_words", c("word_chars") / n, 12.0),
        Rule("short_words", c("word_chars") / n, 2.5, high_is_bad=False),
        Rule("short_lines", n / lines, 1.5, high_is_bad=False),
    ]


@dataclass
class VoteModel:
    """Share of good texts, and each rule's chances of (bad, no, good) vote in bad and in good texts."""

    prior: float
    rates: list[tuple[tuple[float, float, float], tuple[float, float, float]]]

    def posterior(self, votes: tuple[int, ...]) -> float:
        """Chance that a text with these votes is good. Abstaining says nothing."""
        logit = math.log(self.prior / (1 - self.prior))
        for (bad, good), v in zip(self.rates, votes, strict=True):
            if v:
                logit += math.log(good[v + 1] / bad[v + 1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def expectation_maximisation(counts: dict[tuple[int, ...], int], n_rules: int, steps: int = 50) -> VoteModel:
    """Fit on vote patterns and how many texts have each. Starts from: a vote is right four times in five.

    A rate is the share of a class's texts in which the rule casts the vote, abstentions counted in. The share of good
    texts stays within 0.5 and 0.98, and a vote always speaks for its own class by a factor of 1.5 at least, so the two
    classes can't change places.
    """
    model = VoteModel(0.8, [((0.4, 0.5, 0.1), (0.1, 0.5, 0.4))] * n_rules)
    total = sum(counts.values())
    for _ in range(steps):
        good = {v: model.posterior(v) * n for v, n in counts.items()}
        prior = min(0.98, max(0.5, (sum(good.values()) + 8) / (total + 10)))
        rates = []
        for k in range(n_rules):
            mass = [[4.0, 5.0, 1.0], [1.0, 5.0, 4.0]]
            for v, n in counts.items():
                mass[1][v[k] + 1] += good[v]
                mass[0][v[k] + 1] += n - good[v]
            bad_, good_ = ([x / sum(side) for x in side] for side in mass)
            rates.append(((max(bad_[0], 1.5 * good_[0]), bad_[1], min(bad_[2], good_[2] / 1.5)), tuple(good_)))
        model = VoteModel(prior, rates)
    return model


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text -> measures, votes, quality, base_failed, kept: one row for each row.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed,
    and posterior quality of `threshold` or more. Null and empty texts have no words and fail. Null and repeated ids are
    rows like others; texts are whole, of any length; other columns are ignored; an empty table gives an empty table.
    """
    own = rules()
    m = staged(measures(docs).withColumn("votes", F.array(*(r.vote() for r in own))), "votes")
    # at most 3 ** rules patterns, whatever the input
    counts = {tuple(x["votes"]): x["n"] for x in m.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = expectation_maximisation(counts, len(own))
    logit = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, (bad, good) in enumerate(model.rates):
        v = F.col("votes")[k]
        logit = logit + F.when(v == 1, math.log(good[2] / bad[2])).when(v == -1, math.log(good[0] / bad[0])).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = m.withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
