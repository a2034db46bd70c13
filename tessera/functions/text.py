"""Text cleaning as column expressions, each step on its own and all in their fixed order."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from . import rules as R


def san_nfc(c: Column) -> Column:
    """Unicode NFC; the one step that Spark has no function for. Only texts with a character that it may change go to Python."""

    @pandas_udf(T.StringType())
    def san_nfc(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(san_nfc(F.when(c.rlike(R.NOT_NFC), c)), c)


def trim_u(c: Column) -> Column:
    """Strips Unicode white space; Spark's trim strips U+0020 only."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{R.WS}]+", ""), f"[{R.WS}]+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but white space."""
    return F.coalesce(~c.rlike(f"[^{R.WS}]"), F.lit(True))


def norm_category(c: Column) -> Column:
    """Null becomes empty; case stays."""
    return F.coalesce(trim_u(c), F.lit(""))


def san_emoji(c: Column) -> Column:
    return F.regexp_replace(c, rf"[\x{{2190}}-\x{{1FAFF}}&&{R.EMOJI[:-1]}]+", "")


def san_punct_runs(c: Column) -> Column:
    """Three or more of one mark become one; two stay."""
    return F.regexp_replace(c, f"([{R.PUNCT_RUN_CHARS}])\\1{{2,}}", "$1")


def san_junk_runs(c: Column) -> Column:
    return F.regexp_replace(c, R.JUNK_RUN, " ")


def san_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, rf"[\x{{200B}}-\x{{FEFF}}&&{R.ZERO_WIDTH}]", "")


def san_lower_latin(c: Column) -> Column:
    """A-Z only; other capitals stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def san_whitespace(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends. Runs of one space are left alone."""
    return F.trim(F.regexp_replace(c, f"[[^!-~]&&[{R.WS}]]{{2,}}|[[^ -~]&&[{R.WS}]]", " "))


def san_edge_junk(c: Column) -> Column:
    r"""Drops what isn't a word character at both ends, but sentence marks at the end stay."""
    inside = rf"\p{{L}}\p{{N}}_{R.PROTECTED}"
    return F.regexp_extract(c, rf"(?s)^[^{inside}]*+(.*[{inside}.,!?])?", 1)


def sanitize_text(c: Column) -> Column:
    """All steps in order; null becomes empty. White space isn't looked for again after the ends are cut: no run can be new, none is at an end."""
    for step in (san_nfc, san_emoji, san_punct_runs, san_junk_runs, san_zero_width, san_lower_latin, san_whitespace, san_edge_junk):
        c = step(c)
    return F.coalesce(c, F.lit(""))


def word_count(c: Column) -> Column:
    """Runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{R.WS}]+")), F.lit(0)).cast("bigint")


def fewer_words(c: Column, n: int) -> Column:
    """Whether there are fewer than n words (n from 1); reads no further than the n-th."""
    return ~F.coalesce(c.rlike(f"(?:[^{R.WS}]++[{R.WS}]++){{{n - 1}}}[^{R.WS}]"), F.lit(False))


def word_rule(pattern: str) -> str:
    """A case-insensitive pattern that stands alone, by one idea of a word in all scripts."""
    inner = pattern.replace(r"\b", R.EDGE_R).replace(r"\w", R.WORD).replace(r"\s", f"[{R.WS}]")
    return rf"(?iu){R.EDGE_L}(?:{inner}){R.EDGE_R}"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x with x computed once, however often body names it."""
    return F.element_at(F.transform(F.array(x), body), 1)
