"""Documents -> packed training sequences, in five stages. Each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import language
from tessera.llm.common import staged, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.near_dedup import drop_near_copies
from tessera.llm.packing import pack_documents
from tessera.llm.substring_dedup import remove_repeats


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null and empty texts, those without a letter, and those in which no language has half of the letters.

    Rows are judged one by one, whatever their id; repeated rows stay or go together. An empty table stays empty.
    """
    found = language.identify(docs, language.fit(docs), with_spans=False, carry=tuple(docs.columns))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.5)).select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicate texts the row with the smallest id (and text hash), once.

    Texts without a word are in no group; of rows alike in id and text one stays; rows of a null id all stay.
    """
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a text without any stays as it is, null and empty ones too. No row goes."""
    x = remove_repeats(docs, carry=tuple(docs.columns))
    own = {c: F.col(f"carried.`{c}`") for c in docs.columns}
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(own["text"])
    own["text"] = text
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return x.select(*(own[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window stands. Rows are judged by their own text; null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a training sequence. Null ids and repeated rows are packed too, null and
    empty texts as their end id."""
    return pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
