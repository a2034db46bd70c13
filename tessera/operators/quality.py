"""Filters with counts of what they drop, quarantine, and expectations as small frames (check, passed, observed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R
from ..functions.label import category_map
from ..functions.text import fewer_words, is_blank, norm_category
from .summary import beside


def require(df: DataFrame, *columns: str) -> None:
    """Raises before any job if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def audit_reasons(text: Column, category: Column, min_words: int = R.MIN_WORDS) -> tuple[Column, Column]:
    """Why a row is dropped: no category, too few words. A row can have both."""
    return is_blank(category), fewer_words(text, min_words)


def audit_filter(df: DataFrame, text: str = "text", category: str = "raw_category", min_words: int = R.MIN_WORDS) -> DataFrame:
    require(df, text, category)
    no_category, short = audit_reasons(F.col(text), F.col(category), min_words)
    return df.where(~(no_category | short))


def audit_counts(df: DataFrame, text: str = "text", category: str = "raw_category", min_words: int = R.MIN_WORDS) -> DataFrame:
    """One row: rows in, kept, dropped, and dropped for each reason (which overlap)."""
    no_category, short = audit_reasons(F.col(text), F.col(category), min_words)
    dropped = F.count_if(no_category | short)
    return df.agg(F.count("*").alias("n_in"), (F.count("*") - dropped).alias("n_kept"), dropped.alias("n_dropped"), F.count_if(no_category).alias("n_no_category"), F.count_if(short).alias("n_short"))


def drop_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def confidence_weight(confidence: Column, low: float = 0.25) -> Column:
    """Down-weights low-confidence rows instead of dropping them."""
    return F.when(confidence == "low", low).otherwise(1.0)


def quarantine_unknown(df: DataFrame, category: str = "raw_category") -> DataFrame:
    """Rows whose category no rule knows: they go here, never to a default."""
    known = category_map(df).select("raw_label")
    return df.withColumn("raw_label", norm_category(F.col(category))).join(F.broadcast(known), "raw_label", "left_anti")


def check(name: str, passed: Column, observed: Column) -> list[Column]:
    return [F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), observed.cast("string").alias("observed")]


def expect_row_count(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(*check("row_count", F.col("n") == n, F.col("n")))


def expect_columns(df: DataFrame, expected: list[str]) -> bool:
    """Expected columns are a subset of the present ones."""
    return set(expected) <= set(df.columns)


def expect_labels_mapped(df: DataFrame, category: str = "raw_category") -> DataFrame:
    """Passes if every category that is there has a rule; observed is the number that have none."""
    labels = df.select(norm_category(F.col(category)).alias("raw_label")).distinct()
    lost = labels.join(F.broadcast(category_map(df)), "raw_label", "left_anti")
    return lost.agg(F.count("*").alias("n")).select(*check("labels_mapped", F.col("n") == 0, F.col("n")))


def expect_cardinality(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n")).select(*check(f"cardinality_{column}", F.col("n") == n, F.col("n")))


def expect_share_below(df: DataFrame, condition: Column, most: float, name: str) -> DataFrame:
    return df.agg(F.avg(condition.cast("int")).alias("x")).select(*check(name, F.col("x") < most, F.format_string("%.6f", F.round("x", 6))))


def expect_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, up to five, with their counts; empty if all are unique."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(5)


def set_difference(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """only_in and the rows that one of two frames of distinct rows has and the other lacks; empty if they are equal."""
    return a.exceptAll(b).select(F.lit(a_name).alias("only_in"), "*").unionAll(b.exceptAll(a).select(F.lit(b_name).alias("only_in"), "*"))


def digest(df: DataFrame) -> DataFrame:
    """One row: n, and digest, a sum of row hashes (of all columns as strings, by name). Equal for equal rows in whatever order and partitions."""
    cells = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in sorted(df.columns))
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 15), 16, 10)
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def expect_same(a: DataFrame, b: DataFrame, name: str = "deterministic") -> DataFrame:
    """check, n, digest_a, digest_b, same: two makings of a table by their digests. Lazy: nothing runs before the row is read."""
    one = digest(a).select("n", F.col("digest").alias("digest_a"))
    other = digest(b).select(F.col("n").alias("n_b"), F.col("digest").alias("digest_b"))
    same = (F.col("n") == F.col("n_b")) & (F.col("digest_a") == F.col("digest_b"))
    return beside(one, other).select(F.lit(name).alias("check"), "n", "digest_a", "digest_b", same.alias("same"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """True if two frames hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
