"""Weak labels from ordered rule packs, with where they come from. They are unvalidated: negation, history and family
mentions are known to mislead them, and the constant source and confidence must stay beside them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import rules as R
from .text import is_blank, let, norm_category, word_rule


#: Letters that a caseless pattern takes for s and i, though lower() leaves them or makes them two.
FOLDED = ("ſıİ", "sii")


def folded(c: Column) -> Column:
    """Lower case, for cheap tests of whether a plain part of a pattern is there at all."""
    return F.lower(F.translate(c, *FOLDED))


def _any_of(low: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(x) for x in sorted(set(parts))))


def severity_scan3(c: Column, low: Column | None = None) -> Column:
    """Struct of severity (critical > high > low > unknown), the winning tier's sorted distinct keywords, and confidence.

    A tier's pattern is tried only where a plain part of one of its keywords stands, and words are taken out for the winner alone.
    low is folded(c), where it stands in a column of its own, so that the rest is generated code.
    """
    told = lambda tier, keywords: F.struct(F.lit(tier).alias("severity"), keywords.alias("keywords"), F.lit(R.LABEL_CONFIDENCE).alias("confidence"))

    def scan(low: Column) -> Column:
        out = told("unknown", F.array().cast("array<string>"))
        for tier, words in reversed(R.KEYWORDS3.items()):
            rule = word_rule("|".join(words))
            found = F.array_sort(F.array_distinct(F.split(F.lower(F.array_join(F.regexp_extract_all(c, F.lit(rule), F.lit(0)), "\x1f")), "\x1f")))
            out = F.when(_any_of(low, [literal_of(w).strip() for w in words]) & c.rlike(rule), told(tier, found)).otherwise(out)
        return out

    return let(F.coalesce(folded(c), F.lit("")), scan) if low is None else scan(F.coalesce(low, F.lit("")))


def literal_of(pattern: str) -> str:
    """The longest plain lower-case stretch that any match of the pattern holds: a cheap test before the pattern itself."""
    plain = re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\{[^}]*\}|[?*+])*|\[[^\]]*\][?*+]?|\\.[?*+]?|\w\?", "\0", pattern)
    parts = [p for p in re.split(r"[^a-z ]+", plain)]
    return max(parts, key=len)


#: The five-tier patterns in order, with their tiers.
CASCADE = [(tier, p) for tier, patterns in R.TIERS5.items() for p in patterns]
#: Ranks beyond the patterns: nothing matches, nothing to match.
NO_MATCH, NO_INPUT = len(CASCADE), len(CASCADE) + 1


def edged(pattern: str) -> str:
    """A pattern with its word edges, as it is reported."""
    return rf"\b{pattern}" if pattern.endswith(r"\b)") else rf"\b{pattern}\b"


def cascade_rank(c: Column, low: Column | None = None) -> Column:
    """The number of the first pattern in order that matches, else NO_MATCH, or NO_INPUT for null and blank texts. low: as for severity_scan3()."""

    def first(low: Column) -> Column:
        out = F.when(low == "", NO_INPUT)
        for k, (_, p) in enumerate(CASCADE):
            part = literal_of(p).strip()
            out = out.when((low.contains(part) & c.rlike(word_rule(p))) if len(part) > 2 else c.rlike(word_rule(p)), k)
        return out.otherwise(NO_MATCH)

    if low is not None:
        return F.when(is_blank(c), NO_INPUT).otherwise(first(low))
    return let(F.when(is_blank(c), "").otherwise(folded(c)), first)


def severity_of_rank(rank: Column) -> Column:
    """Struct of severity, matched_tier, matched_pattern, source, confidence of a cascade_rank()."""
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), rank + 1)
    return F.struct(
        pick([*(t for t, _ in CASCADE), R.DEFAULT_TIER, R.DEFAULT_TIER]).alias("severity"),
        pick([*(t for t, _ in CASCADE), "default_no_match", "default_empty_input"]).alias("matched_tier"),
        pick([*(edged(p) for _, p in CASCADE), None, None]).alias("matched_pattern"),
        F.lit(R.LABEL_SOURCE).alias("label_source"),
        F.lit(R.LABEL_CONFIDENCE).alias("confidence"),
    )


def severity_cascade5(c: Column) -> Column:
    """Struct of severity, matched_tier, matched_pattern, source, confidence: the first pattern in order that matches.

    Nothing matches: S4 by default; null and blank: S4 as empty input.
    """
    return let(cascade_rank(c), severity_of_rank)


def category_map(df: DataFrame) -> DataFrame:
    """The 40 categories as a frame."""
    return df.sparkSession.createDataFrame(R.CATEGORIES, "raw_label string, department_code string, routing_confidence string")


def map_category(df: DataFrame, column: str = "raw_category", strict: bool = False) -> DataFrame:
    """Adds department_code and routing_confidence, null for unknown categories; strict: an unknown one is an error."""
    rules = category_map(df)
    out = df.withColumn("raw_label", norm_category(F.col(column))).join(F.broadcast(rules), "raw_label", "left")
    if strict:
        out = out.withColumn("department_code", F.coalesce("department_code", F.raise_error(F.concat(F.lit("unknown category: "), F.col("raw_label"))).cast("string")))
    return out


def provenance_cols(df: DataFrame) -> DataFrame:
    return df.withColumn("label_source", F.lit(R.LABEL_SOURCE)).withColumn("label_confidence", F.lit(R.LABEL_CONFIDENCE))
