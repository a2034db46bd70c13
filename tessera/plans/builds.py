"""The two dataset builds: clean records with three tiers, and expanded variants with five tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import rules as R
from ..functions.label import folded, map_category, severity_scan3
from ..functions.text import norm_category, sanitize_text
from ..operators.expand import expand_variants
from ..operators.quality import audit_reasons
from ..operators.split import NAMES, numbered, row_surrogate_id, split_grouped_seeds, split_rank_rows, without_leaks
from ..sources.shared import written


def cleaned_notes(df: DataFrame, key: str, text: str = "text", category: str = "raw_category", seen: Observation | None = None) -> DataFrame:
    """key, specialty_label, cleaned_text, no_category, short: rows with a text, cleaned once, with the audit's reasons, and written.

    seen gets n_raw, n_kept, n_no_category and n_short from that pass.
    """
    x = df.where(F.col(text).isNotNull()).select(key, norm_category(F.col(category)).alias("specialty_label"), sanitize_text(F.col(text)).alias("cleaned_text"))
    no_category, short = audit_reasons(F.col("cleaned_text"), F.col("specialty_label"))
    x = x.withColumns({"no_category": no_category, "short": short})
    if seen is not None:
        x = x.observe(seen, F.count("*").alias("n_raw"), F.count_if(~(F.col("no_category") | F.col("short"))).alias("n_kept"), F.count_if("no_category").alias("n_no_category"), F.count_if("short").alias("n_short"))
    return written(x, "cleaned")


def clean_build(df: DataFrame, key: str, text: str = "text", category: str = "raw_category", seen: Observation | None = None) -> DataFrame:
    """Null text goes; text is cleaned, rows are audited, labelled by three tiers, numbered by key and split by row. seen: as for cleaned_notes()."""
    x = cleaned_notes(df, key, text, category, seen).where("not no_category and not short").select(key, "specialty_label", "cleaned_text")
    low, c = F.col("_low"), F.col("cleaned_text")
    x = numbered(x, key, lambda y: y.withColumn("_low", folded(c)).withColumn("scan", severity_scan3(c, low)).drop("_low"))
    x = x.withColumn("tracking_id", row_surrogate_id(F.col("number"), "MTA"))
    x = split_rank_rows(x, "tracking_id")
    return x.select("tracking_id", "specialty_label", "cleaned_text", F.col("scan.severity").alias("severity_label_heuristic"), F.col("scan.keywords").alias("matched_keywords"), F.col("scan.confidence").alias("heuristic_confidence"), F.col("split").alias("target_split"))


def build_summary(df: DataFrame, key: str, text: str = "text", category: str = "raw_category") -> DataFrame:
    """One row about a clean build: n_raw, n_dropped, n_no_category and n_short, observed while it is cleaned, and n_kept, n_train, n_val, n_test of its rows."""
    seen = Observation("cleaned")
    split = F.col("target_split")
    x = clean_build(df, key, text, category, seen).agg(F.count("*").alias("n_kept"), *(F.count_if(split == name).alias(f"n_{name}") for name in NAMES))
    told = seen.get
    return x.select(F.lit(told["n_raw"]).alias("n_raw"), "n_kept", F.lit(told["n_raw"] - told["n_kept"]).alias("n_dropped"), *(F.lit(told[c]).alias(c) for c in ("n_no_category", "n_short")), *(f"n_{name}" for name in NAMES))


def variant_build(df: DataFrame, rate: float | None = R.RATE, allow_empty: bool = False) -> DataFrame:
    """seed_id, text, raw_category -> the 13 columns of the expanded dataset, split by seed.

    The split is fixed by seed before the expansion; severity is that of the perturbed text. Rows of unknown category
    are left out: quarantine_unknown() has them. A seed in two splits is an error of whatever reads or writes the rows.
    """
    known = map_category(df).where("department_code is not null")
    x = expand_variants(without_leaks(split_grouped_seeds(known, "seed_id", allow_empty=allow_empty)), rate, with_severity=True)
    return x.select("tracking_id", "seed_id", "variant_index", "is_perturbed", "language", "text", F.col("raw_label").alias("raw_medical_specialty"), "department_code", "routing_confidence", F.col("severity.severity").alias("severity_heuristic"), F.col("severity.label_source").alias("severity_label_source"), F.col("severity.confidence").alias("severity_confidence"), "split")
